"""Personal data: candidate spans scored by gradient boosted trees, in DataFrame functions only.

Validated matches (``KINDS``: email, ip, card, phone) always count. Generators with high recall propose further,
overlapping spans. Each candidate is described by small whole numbers for its format and its context, so all
candidates of the corpus are counted by pattern, exactly and with partial aggregation. Boosted trees learn from those counts how
likely a pattern is personal data; the label is whether a validated match of the kind covers the candidate, and
the validators themselves (Luhn, the range of address parts) are no features. Trees are fitted on one half of the texts
and the threshold is calibrated on the other: for each kind the lowest score at which at least ``PRECISION`` of all
candidates from there up are validated.
Candidates of the patterns above it are redacted too.

A pattern is a number below ``PATTERNS``, the product of the features' ranges, so the selected ones are a bitmap of at most
0.6 MB. Patterns are fitted and calibrated as tables; what the driver reads is sums by rounded score, and the bitmap's
bytes. Texts never leave their row: spans are arrays of it, and nothing but pattern counts is shuffled.

Defined results: null and empty texts have no spans; equal rows are reported as often as they come; a null doc_id is
kept; without candidates, or with labels of one kind only, nothing is added to the validated matches; an empty table gives
no rows; other columns are ignored or passed through. U+0001 in a text matches nothing, as in the original text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypact.llm.common import written
from tallypact.llm.quality_rules import let

#: Kind and its pattern, in the order in which spans of one start are listed.
KINDS: list[tuple[str, str]] = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
]
#: Generators of candidates, by the kind of their first guess.
GENERATORS: list[tuple[str, str]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[({]at[\])}] ?| at )[A-Za-z0-9-]++"
              r"(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9-]++)++"),
    ("number", r"(?<![0-9])\+?\(?[0-9][0-9 ().-]{5,30}[0-9](?![0-9])"),
    ("local", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]
#: Words before a candidate that speak for a kind or against all; the first that is found counts.
CONTEXTS: list[str] = [
    "(?i)mail|contact|write",
    "(?i)phone|tel|call|mobile|fax",
    "(?i)card|visa|master|amex|credit|pay",
    r"(?i)\bip\b|host|server|addr",
    "(?i)order|invoice|version|isbn|ref|serial|sku",
]
CONTEXT_CHARS = 24
PRECISION = 0.97
#: Patterns in a partition of the table that trees are fitted on.
FIT_ROWS = 20_000
#: So many selected patterns are listed in a plan; more are a bitmap.
MAX_LISTED = 2000
#: Scores are calibrated in so many steps.
SCORES = 10_000
TREES, DEPTH = 10, 4
MARK, OTHER = "\u0001", "\u0002"
#: How many values each feature has.
RANGES = [3, 9, 5, 4, 4, 2, 2, 2, 5, 6, 3, 3]
N_FEATURES = len(RANGES)
PATTERNS = math.prod(RANGES)


def _places(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and not overlapping: array of (start, text), in code points from 0."""
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), f"(?:{pattern})", f"{MARK}$0{MARK}")
    kind = "array<struct<start:int,text:string>>"

    def step(state, part):
        here = F.struct(state["at"].alias("start"), part.alias("text"))
        return F.struct((state["at"] + F.length(part)).alias("at"), (~state["inside"]).alias("inside"),
                        F.when(state["inside"], F.concat(state["found"], F.array(here))).otherwise(
                            state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(kind).alias("found"))
    return let(F.split(marked, MARK), lambda parts: F.when(F.size(parts) == 1, F.array().cast(kind)).otherwise(
        F.aggregate(parts, start, step, lambda state: state["found"])))


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: let(
        d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + x) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(14, 19) & _luhn(d))
    return F.length(_digits(match)).between(10, 15)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Validated spans of a kind: array of (start, kind number, end)."""
    number = [k for k, _ in KINDS].index(kind)
    found = F.filter(_places(text, pattern), lambda m: _valid(kind, m["text"]))
    spans = F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"), (m["start"] + F.length(m["text"])).alias("end")))
    needed = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
    return F.when(needed, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """All validated spans by start and kind."""
    return F.sort_array(F.concat(*[_spans(text, kind, pattern) for kind, pattern in KINDS]))


def _bucket(value: Column, limits: list[int]) -> Column:
    """How many of the limits a number reaches."""
    out = F.lit(0)
    for n, limit in enumerate(limits, 1):
        out = F.when(value >= limit, n).otherwise(out)
    return out


def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, ""))


def _edge(char: Column) -> Column:
    return F.when(F.coalesce(char, F.lit("")).isin("", " ", "\n"), 0).when(char.rlike(r"\p{L}"), 1).otherwise(2)


def _features(text: Column, generator: int, match: Column) -> Column:
    """Whole numbers that describe a candidate's format and context."""
    m = match["text"]
    start = match["start"]
    before = F.substr(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
    context = F.lit(0)
    for n in range(len(CONTEXTS), 0, -1):
        context = F.when(before.rlike(CONTEXTS[n - 1]), n).otherwise(context)
    lead = F.substring(_digits(m), 1, 1)
    return F.array(
        F.lit(generator), _bucket(F.length(_digits(m)), [1, 7, 10, 12, 14, 16, 17, 20]),
        _bucket(_count(m, r"[^.]+"), [1, 2, 3, 4]), _bucket(_count(m, "[^ ]+"), [1, 2, 3]),
        _bucket(_count(m, "[^-]+"), [1, 2, 3]), m.contains("+").cast("int"), m.contains("(").cast("int"),
        m.contains("@").cast("int"),
        F.when(lead.isin("3"), 1).when(lead.isin("4"), 2).when(lead.isin("5"), 3).when(lead.isin("6"), 4).otherwise(0),
        context, _edge(F.substr(text, start, F.lit(1))),
        _edge(F.substr(text, start + F.length(m) + 1, F.lit(1))))


def _kind_of(generator: int, match: Column) -> Column:
    """The kind a candidate would be: an email, or by its dots and digits an ip, a card or a phone number."""
    if generator == 0:
        return F.lit(0)
    if generator == 2:
        return F.lit(3)
    return F.when(match["text"].rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), 1).when(
        F.length(_digits(match["text"])) >= 13, 2).otherwise(3)


def candidates(text: Column, base: Column) -> Column:
    """All candidates: array of (start, kind, end, features, known); ``known``: a validated span covers it."""
    def describe(number):
        def of(m):
            end = m["start"] + F.length(m["text"])
            kind = _kind_of(number, m)
            known = F.exists(base, lambda s: (s["kind"] == kind) & (s["start"] < end) & (s["end"] > m["start"]))
            return F.struct(m["start"].alias("start"), kind.alias("kind"), end.alias("end"),
                            _features(text, number, m).alias("features"), known.alias("known"))

        return of

    groups = []
    for number, (name, pattern) in enumerate(GENERATORS):
        needed = text.rlike("@|[ \\[({]at[ \\])}]") if name == "email" else text.rlike("[0-9]{3}|[0-9][ ().-][0-9]")
        groups.append(F.when(needed, F.transform(_places(text, pattern), describe(number))).otherwise(
            F.array().cast("array<struct<start:int,kind:int,end:int,features:array<int>,known:boolean>>")))
    return F.concat(*groups)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def patterns(docs: DataFrame) -> DataFrame:
    """kind, features, and how many candidates of the corpus have them: n and n_known (validated) to fit, m and m_known
    to calibrate. Texts are dealt to the two halves by their hash, so copies stay together.
    """
    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")
    found = docs.select(half, let(_text(docs), lambda t: let(base_spans(t), lambda b: candidates(t, b))).alias("c"))
    each = found.select("half", F.explode("c").alias("c")).select("half", "c.kind", "c.features", "c.known")

    def total(condition, name):
        return F.count_if(condition).alias(name)

    fits, known = F.coalesce(F.col("half") == 0, F.lit(True)), F.col("known")
    return each.groupBy("kind", "features").agg(total(fits, "n"), total(fits & known, "n_known"), total(~fits, "m"),
                                        total(~fits & known, "m_known"))


def _code(features: Column) -> Column:
    """The number of a pattern."""
    code = F.lit(0)
    for i, size in enumerate(RANGES):
        code = code * size + F.get(features, F.lit(i))
    return code


def fit(docs: DataFrame, precision: float = PRECISION) -> bytes:
    """The patterns to redact, as a bitmap up to the last one; empty if there are none."""
    return select(written(patterns(docs), "patterns"), precision)


def select(counted: DataFrame, precision: float = PRECISION) -> bytes:
    """``fit`` of the patterns' counts."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    size, n, known = counted.agg(F.count("*"), F.sum("n"), F.sum("n_known")).first()
    if not n or known in (0, n):
        return b""
    names = [f"f{i}" for i in range(N_FEATURES)]
    wide = counted.select("*", *[F.get("features", F.lit(i)).cast("double").alias(f) for i, f in enumerate(names)])
    vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(wide.withColumn("code", _code(F.col("features"))))
    weighted = vectors.repartition(-(-size // FIT_ROWS), "code").sortWithinPartitions("code", "kind").select(
        "vector", F.inline(F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("n_known").cast("double").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("n_known")).cast("double").alias("weight")))))
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                          seed=7, maxBins=16).fit(weighted.filter("weight > 0"))
    scored = written(model.transform(vectors).select(
        "kind", "code", "m", "m_known",
        F.round(vector_to_array("probability")[1] * SCORES).cast("int").alias("score")), "scores")
    # At most SCORES + 1 sums a kind.
    sums = scored.groupBy("kind", "score").agg(F.sum("m").alias("m"), F.sum("m_known").alias("m_known")).collect()
    least = {k: _least([r for r in sums if r["kind"] == k], precision) for k in range(len(KINDS))}
    chosen = F.lit(False)
    for kind, score in least.items():
        if score is not None:
            chosen = chosen | ((F.col("kind") == kind) & (F.col("score") >= score))
    bits = (scored.filter(chosen).select("code").distinct().groupBy((F.col("code") / 8).cast("int").alias("byte"))
            .agg(F.sum(F.call_function("shiftleft", F.lit(1), F.col("code") % 8)).cast("int").alias("bits")))
    out = bytearray(-(-PATTERNS // 8))
    for row in bits.toLocalIterator():
        out[row["byte"]] = row["bits"]
    return bytes(out.rstrip(b"\0"))


def _least(rows: list, precision: float) -> int | None:
    """The lowest score of a kind at which enough of all that score as much are validated."""
    found, seen, right = None, 0, 0
    for row in sorted(rows, key=lambda r: -r["score"]):
        seen, right = seen + row["m"], right + row["m_known"]
        if seen and right >= precision * seen:
            found = row["score"]
    return found


def _selected(features: Column, selected: bytes) -> Column:
    """Whether a pattern's bit is set. Few bits are listed instead, which keeps plans small on the driver."""
    codes = [8 * at + bit for at, byte in enumerate(selected) if byte for bit in range(8) if byte >> bit & 1]
    if len(codes) <= MAX_LISTED:
        return _code(features).isin(codes)
    return let(_code(features), lambda code: F.coalesce(F.conv(F.hex(F.substring(
        F.lit(bytearray(selected)), (code / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0)).bitwiseAND(
            F.call_function("shiftleft", F.lit(1), code % 8)) != 0)


def find(docs: DataFrame, selected: bytes, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (start, kind number, end): validated ones, and those with the added ones.

    ``keep`` names columns that come through, with two underscores before their names.
    """
    def both(t):
        def more(b):
            added = F.filter(candidates(t, b), lambda c: ~c["known"] & _selected(c["features"], selected))
            plain = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"),
                                                          c["end"].alias("end")))
            every = F.sort_array(F.array_distinct(F.concat(b, plain))) if selected else b
            return F.struct(b.alias("base"), every.alias("spans"))

        return let(base_spans(t), more)

    kept = [F.col(f"`{c}`").alias(f"__{c}") for c in keep]
    return docs.select("doc_id", *kept, let(_text(docs), both).alias("found_")).select(
        "doc_id", *[f"`__{c}`" for c in keep], "found_.base", "found_.spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k, _ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows where there is one."""
    marked = find(docs, fit(docs), tuple(docs.columns))

    def cut(spans):
        # Overlapping spans become one, named by the first.
        merged = F.aggregate(spans, F.array().cast("array<struct<start:int,kind:int,end:int>>"), lambda done, s: let(
            F.get(done, F.size(done) - 1),
            lambda top: F.when(top["end"] > s["start"], F.concat(
                F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                    top["start"].alias("start"), top["kind"].alias("kind"),
                    F.greatest(top["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s)))))
        return merged

    text = F.col("__text")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k, _ in KINDS])

    def rewrite(spans):
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        pieces = F.zip_with(ends, spans, lambda a, s: F.concat(
            F.substr(text, a + 1, F.coalesce(s["start"], F.length(text)) - a),
            F.coalesce(F.get(tags, s["kind"]), F.lit(""))))
        return F.array_join(pieces, "")

    clean = F.col("redacted")
    marked = marked.withColumn("redacted", let(cut(F.col("spans")), rewrite))
    found = F.size("spans") > 0
    columns = []
    for field in docs.schema.fields:
        column = F.col(f"`__{field.name}`")
        if field.name == "text":
            column = F.when(found, clean).otherwise(column)
        elif field.name == "n_chars":
            column = F.when(found, F.length(clean).cast(field.dataType)).otherwise(column)
        columns.append(column.alias(field.name))
    return marked.select(*columns)


def _equal(number: int):
    return lambda kind: kind == number


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find(docs, fit(docs))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _equal(k))).cast("long").alias(f"n_{name}")
              for k, (name, _) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))

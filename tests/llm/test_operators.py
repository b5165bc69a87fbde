"""The operators against plain Python, on odd inputs: nulls, empty texts, ties, repeated rows, clashing names."""

import random

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallypact.llm import (
    chat,
    decontaminate,
    kneser_ney,
    packing,
    pii,
    quality_rules,
    repeats,
    simhash,
    substring_dedup,
    suffix_array,
    toxicity,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]


def prose(n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


PASSAGE, OTHER = prose(60), prose(40)
LONG = prose(30_000)
TEXTS = [
    (5, PASSAGE + "\n" + prose(30)), (3, prose(20) + "\t" + PASSAGE), (9, prose(5) + "  " + PASSAGE + " " + OTHER),
    (1, OTHER + " " + prose(9)), (2, None), (4, ""), (6, " \n\t \x0b"), (7, "one"), (8, "Ünï çode text  x"),
    (10, PASSAGE), (11, PASSAGE), (12, LONG), (13, LONG[1000:90_000]), (14, " ".join(PASSAGE.split()[:13])),
    (15, " ".join(PASSAGE.split()[20:32])), (16, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
    (17, "a a a a a a a a a a a a a a a a"), (18, "x" * 120), (19, "y" + "x" * 80 + "z"), (None, PASSAGE),
    (20, "same row " + OTHER), (20, "same row " + OTHER), (21, "<|endoftext|> a\u0001b <|im_start|> \\ <\\| <|"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("clash")).withColumn(
        "text_hash", F.lit(1)).withColumn("fp", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want):
    key = repr
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    assert got == want


def test_substring_dedup(docs):
    same(substring_dedup.digest(docs), brute.op1(TEXTS))


def test_few_slots_change_nothing(docs):
    """A bitmap that is nearly full lets more candidates through; results stay."""
    same(substring_dedup.digest(docs, fine_bits=14, slot_bits=11, parts=4), brute.op1(TEXTS))


def test_copies_that_go_the_long_way(docs):
    same(suffix_array.digest(docs, max_copies=0), brute.op4(TEXTS))
    same(substring_dedup.digest(docs, max_copies=0), brute.op1(TEXTS))


def test_substring_dedup_small_window(docs):
    same(substring_dedup.digest(docs, 5, 3), brute.op1(TEXTS, 5))


def test_kept_text(docs):
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert kept[10] == "" and kept[7] == "one" and kept[3].startswith(PASSAGE.split()[0]) is False


def test_window_classes_survive_a_hash_clash(monkeypatch):
    monkeypatch.setattr(repeats, "rolling", lambda units, n: np.zeros(len(units) - n + 1, np.uint64))
    codes = np.array([1, 2, 3, 1, 2, 4], np.uint32)
    of, sample = substring_dedup._window_classes(codes, np.arange(5), 2)
    assert of[0] == of[3] and len(set(of.tolist())) == 4


def test_suffix_array(docs):
    same(suffix_array.digest(docs), brute.op4(TEXTS))


def test_suffix_array_small_window(docs):
    short = [(i, (t or "")[:3000]) for i, t in TEXTS]
    cut = docs.withColumn("text", F.substring("text", 1, 3000))
    want = [(i, *rest) for i, *rest in brute.op4(short, 20)]
    same(suffix_array.digest(cut, 20, 9), want)


def test_ranks_order_suffixes():
    data = np.frombuffer(b"banana_bandana_banana", np.uint8)
    for depth in (3, 8, 12):
        starts = np.arange(len(data) - depth + 1)
        text = data.tobytes()
        got = suffix_array.ranks(data, starts, depth)
        want = [sorted({text[i:i + depth] for i in starts}).index(text[i:i + depth]) for i in starts]
        assert [sorted(set(got)).index(x) for x in got] == want


def test_quality_rules(docs):
    got = quality_rules.verdicts(docs).select("doc_id", *quality_rules.MEASURES[:5], "base_failed")
    same(got, [(i, *brute.op2_base(t)) for i, t in TEXTS])
    assert {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()}[1]


def test_ablation(docs):
    entries = quality_rules.ledger(docs)
    bits = [r["failed"] for r in entries.collect()]
    for r in quality_rules.ablation(entries).collect():
        mask = quality_rules.mask(r["policy"])
        bit = 1 << [n for n, _ in quality_rules.RULES].index(r["rule"])
        assert r["n_failed"] == sum(b & bit != 0 for b in bits)
        assert r["n_alone"] == sum(b & mask == bit for b in bits)
        assert r["n_kept"] == sum(b & mask == 0 for b in bits)
        assert r["n_kept_without"] == r["n_kept"] + r["n_alone"]


@pytest.mark.parametrize("longest", [2048, 1])
def test_simhash(docs, longest):
    same(simhash.digest(docs, longest), brute.op3(TEXTS))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs_cross_batches(size):
    """A run is compared or passed on whole, however its rows are cut into batches."""
    keys = np.repeat([1, 2, 3, 4], [1, 3, 9, 2])
    fps = np.array([5, 8, 9, 7 << 40, *range(100, 109), 7, 6], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + size]), pa.array(fps[i:i + size])], ["key", "fp"])
               for i in range(0, len(keys), size)]
    out = [r for b in simhash._compare(4)(batches) for r in b.to_pylist()]
    assert sorted(r["a"] for r in out if r["b"] is None) == list(range(100, 109))
    assert sorted((r["a"], r["b"]) for r in out if r["b"] is not None) == [(7, 6), (9, 8)]


def test_simhash_links(spark):
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base)
    for v in base[:30]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    want = {}
    for a in range(len(values)):
        want[a] = {b for b in range(len(values)) if (values[a] ^ values[b]).bit_count() <= 2}
    label = list(range(len(values)))
    for _ in values:
        label = [min(label[b] for b in want[a]) for a in range(len(values))]
    nodes = spark.createDataFrame(signed, "fp long")
    for longest in (2048, 2):
        root = {r["node"]: r["root"] for r in simhash.roots(simhash.links(nodes, longest)).collect()}
        groups = {}
        for k, (v,) in enumerate(signed):
            groups.setdefault(label[k], set()).add(root.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices(radius):
    values = np.array([rng.getrandbits(64) for _ in range(70)] + [5, 7, 4, 3, 12], np.uint64)
    rows = simhash.within(values, simhash.planes(values), radius)
    near = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")[:, :len(values)]
    want = [[(int(a) ^ int(b)).bit_count() <= radius for b in values] for a in values]
    assert (near.astype(bool) == np.array(want)).all()


def test_first_of_group(docs):
    kept = simhash.first_of_group(docs)
    assert kept.columns == docs.columns
    groups = {c for _, _, c in brute.op3(TEXTS)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)


def test_packing(docs):
    # Equal ids of two rows cannot be told apart by the checker.
    texts = [(i, t) for i, t in TEXTS if i not in (20, None)]
    rows = packing.digest(docs.filter("doc_id <> 20")).collect()
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert brute.check_packing(rows, texts, encode) == 0


def test_both_tokenizers_agree(spark):
    import public_tokenizers

    ranks, tokenizer = packing.encoder(), packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in TEXTS if t]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    alphabet = " \n\t'abzAZ09.,é ​中😀́ß<|endoftext|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert list(ranks(t)) == list(tokenizer(t))


def test_packing_limits(spark):
    rows = [(i, prose(rng.randrange(1, 60)), prose(rng.randrange(0, 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, asked string")
    out = packing.pack(df, max_tokens=256, max_segments=4, max_loss_tokens=100, prompt="asked").collect()
    by, seen = {}, {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert all(sum(p["length"] for p in ps) <= 256 and len(ps) <= 4 and sum(p["loss_tokens"] for p in ps) <= 100
               for ps in by.values())
    assert all(seen[r["doc_id"]] == r["doc_tokens"] for r in out)


BENCH = [(1, " ".join(PASSAGE.split()[5:25])), (2, "one"), (3, None), (4, ""), (5, "..."), (10, " ".join(PASSAGE.split()[5:25])),
         (7, "ünï çode"), (None, OTHER)]


@pytest.mark.parametrize("limit", [200_000, 5])
def test_decontaminate(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", limit)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    known = [(i, t) for i, t in BENCH if i is not None]
    same(decontaminate.digest(docs, bench.filter("item_id is not null")), brute.op7(TEXTS, known))
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.digest(docs, bench).collect()}
    assert hits[1] > 0


def test_decontaminate_offsets(spark, docs):
    bench = spark.createDataFrame(BENCH[:2], "item_id long, text string")
    texts = {i: t for i, t in TEXTS}
    word = decontaminate.WORD_BYTES
    windows = {r["window"] for r in decontaminate.windows(bench).collect()}
    n = 0
    for r in decontaminate.find(docs, bench).collect():
        for s in r["spans"]:
            cut = texts[r["doc_id"]][s["start"]:s["end"]].encode()
            assert b" ".join(w.translate(decontaminate.NORMAL) for w in word.findall(cut)).decode() in windows
            n += 1
    assert n > 20


def test_chat_round_trip(spark):
    texts = ["", None, "<|im_end|>\n<|im_start|>user\nhi", "\\", "<\\|", "<|", "a<", "|>b", "<\\n", "x\ny", "<<||", "\\\\<|\\"]
    roles = ["assistant", "user", None, "a\nb", "<|im_start|>", "\\n", "<\\n"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [rows[0], (None, 0, "user", "x"), (77, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    got = chat.read_back(chat.render(chat.fold(chat.turns_as_events(df)))).collect()
    assert len(got) == len(want)
    for r in got:
        turns = [x[1:] for x in sorted(want[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert list(r["loss_texts"]) == [x for role, x in turns if role == "assistant"]


def test_chat_events(spark):
    rows = [(1, 0, "message", "a", "user", "hi"), (1, 1, "delta", "b", "assistant", "he"), (1, 2, "delta", "b", None, "llo"),
            (1, 3, "message", "c", "user", "more"), (1, 4, "delta", "d", "assistant", "late"),
            (1, 5, "regenerate", "b", "assistant", "good"), (1, 6, "delta", "b", "assistant", "bye"),
            (1, 7, "edit", "a", "user", "hey"), (1, 8, "message", "e", "user", "ok"), (2, 0, "delta", "x", "user", None)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]]
           for r in chat.read_back(chat.render(chat.fold(events.repartition(3)))).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "goodbye"), ("user", "ok")], 2: [("user", "")]}


def test_kneser_ney_sums_to_one(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in TEXTS if i], "doc_id long, quality int, toxic int")
    model = kneser_ney.fit(docs, labels)
    table = kneser_ney.probabilities(model).reshape(-1, kneser_ney.ALPHABET)
    assert np.allclose(table.sum(1), 1, atol=1e-4) and table.min() > 0


def test_trusted_rows_either_way(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int")
    for limit in (10, 0):
        assert sorted(r["doc_id"] for r in kneser_ney.trusted_of(docs, labels, limit).collect()) == [1, 5]


def test_kneser_ney_by_hand(spark):
    """Counts of one text, done with dicts."""
    text = "abab abcab ab! abc" * 3
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, lang string")
    model = kneser_ney.fit(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    data = [0, 0, 0] + [int(kneser_ney.SYMBOL[b]) for b in text.encode()]
    counts = {}
    for i in range(3, len(data)):
        g = tuple(data[i - 3:i + 1])
        counts[g] = counts.get(g, 0) + 1
    levels = [counts]
    for _ in range(3):
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)

    def prob(g, level):
        if not g:
            return 1 / kneser_ney.ALPHABET
        c = levels[level]
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        d = [0.5] * 3
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5, 0.01), k - 0.01) for k in (1, 2, 3)]
        cut = lambda v: d[min(v, 3) - 1]
        inside = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        if not inside:
            return prob(g[1:], level + 1)
        total = sum(inside.values())
        own = max(inside.get(g, 0) - cut(inside[g]), 0) / total if g in inside else 0
        return own + sum(map(cut, inside.values())) / total * prob(g[1:], level + 1)

    table = kneser_ney.probabilities(model)
    for g in [*counts, (1, 2, 3, 4), (0, 0, 0, 9), (1, 2, 1, 5)]:
        code = sum(x << 6 * (3 - k) for k, x in enumerate(g))
        assert abs(table[code] - prob(g, 0)) < 1e-5


def test_classifier_on_labels(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {r["doc_id"]: r for r in kneser_ney.classify(d, labels).collect()}
    known = labels.collect()
    assert len(out) == d.count()
    assert all(out[r["doc_id"]]["kept"] for r in known if r["quality"] == 1)
    assert any(not out[r["doc_id"]]["kept"] for r in known if r["quality"] == 0)


def test_toxicity(spark):
    words = [f"t{i}" for i in range(8)]
    rows = [(i, prose(30) + (" " + rng.choice(words)) * (2 * (i % 4 == 0)) + " " + prose(20)) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    out = toxicity.digest(d, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 1200 and 150 < len(held) < 330
    right = sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_toxicity_without_labels(docs, empty):
    labels = empty.selectExpr("doc_id", "1 as quality", "1 as toxic")
    assert {r["score"] for r in toxicity.digest(docs, labels).collect()} == {0.5}


PII = ["a.b+c@d-e.co.uk, x@y @z.w a@b..c q@r.s_t@u.v", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 9.9.9",
       "4111 1111-1111 1111 4111111111111112 79927398713 5500005555555559-1", "+1 (415) 555-0100. +49 30 1234567 +1 2 +123456789012345 6",
       "é😀 +1 415 555 0100\u00014111111111111111 a@b.c", None, "", "1" * 5000, "a." * 3000 + "@b.c", "a@" + "b." * 4000 + "c",
       "tel 415-555-0100 order 1234567890123456"]


def test_pii(spark):
    rows = list(enumerate(PII)) + [(90, PII[0]), (90, PII[0]), (None, PII[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).repartition(2)
    got = pii.digest(df).collect()
    want = [(i, *brute.op10_base(t)) for i, t in rows]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)


def test_pii_learns_context(spark):
    def card(n, good):
        for _ in range(10_000):
            s = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if brute.luhn(s) == good:
                return s
    rows = [(i, f"{prose(3)} my visa {card(i, True)} {prose(3)}") for i in range(300)]
    rows += [(1000 + i, f"{prose(3)} order {card(i, False)} {prose(3)}") for i in range(300)]
    rows += [(2000, f"a visa {card(0, False)} here"), (2001, f"order {card(0, False)} here")]
    out = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2000]["spans"] == "card:7:23" and out[2000]["n_card"] == 0
    assert out[2001]["spans"] == "" and out[1000]["spans"] == ""


def test_redact(spark):
    rows = [(1, "x a@b.co y +1 (415) 555-0100", 1, "k"), (2, None, 2, "k"), (3, "4111111111111111", 3, "k"), (4, "plain", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in pii.redact(df).collect()}
    assert got == {1: ("x [EMAIL] y [PHONE]", 19, "k"), 2: (None, 2, "k"), 3: ("[CARD]", 6, "k"), 4: ("plain", 5, "k")}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (substring_dedup.digest(empty), quality_rules.verdicts(empty), simhash.digest(empty),
               suffix_array.digest(empty), packing.digest(empty), kneser_ney.classify(empty, labels),
               decontaminate.digest(empty, bench), chat.digest(turns), toxicity.digest(empty, labels), pii.digest(empty)):
        assert df.count() == 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_chat"])
def test_sql(spark, name):
    from tallypact.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    con.execute(ORACLES[name])
    got = con.execute(ORACLES[name]).fetchall()
    df = QUERIES[name](spark, SF)
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in df.collect())

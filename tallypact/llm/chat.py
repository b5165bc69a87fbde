"""Chat formatting: conversations rebuilt from an event log and rendered, in DataFrame functions only.

An event is (conv_id, seq, kind, message_id, role, text). ``message`` and ``edit`` set a message's text, ``delta``
appends to it, ``regenerate`` sets it anew and withdraws the messages that came after it until then. ``fold`` turns
the log into final messages; ``render`` writes them with a template whose control strings cannot occur in a text,
and keeps the result in segments that bear loss or do not.

Escapes are reversible: a backslash is doubled, the start of a control string ``<|`` becomes ``<\\|``, and in roles
a line end becomes ``<\\n``. ``read_back`` undoes them.

Defined results: a null text or role is empty; events of one seq are ordered by kind and text; a message that has
only deltas starts empty; equal table rows are turns of their own; a null conv_id is a conversation like any
other; an empty log gives no rows; other columns are ignored. Folding is by message, so a conversation with
very many events is many groups; its rendered form is one row by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallypact.llm.quality_rules import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Table rows (conv_id, turn, role, text) as ``message`` events, one message per row.

    A row that comes n times is n messages.
    """
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    message = F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.hex(F.xxhash64("role", "text")),
                          F.hex(F.hash("text", "role")), F.col("copy").cast("string"))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), message.alias("message_id"), "role",
        "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, first_seq, role, text."""
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"),
                     F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))

    def final(log):
        # Texts from the last event on that sets one; earlier ones are overwritten.
        reset = F.coalesce(F.array_max(F.transform(log, lambda e, i: F.when(e["kind"] != "delta", i))), F.lit(0))
        return F.struct(
            log[0]["seq"].alias("first_seq"), log[0]["role"].alias("role"),
            F.array_join(F.transform(F.slice(log, reset + 1, F.size(log)), lambda e: e["text"]), "").alias("text"),
            F.array_max(F.transform(log, lambda e: F.when(e["kind"] == "regenerate", e["seq"]))).alias("redone"))

    messages = (events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("log"))
                .select("conv_id", let(F.col("log"), final).alias("m")).select("conv_id", "m.*"))
    before = W.partitionBy("conv_id").orderBy("first_seq", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    return (messages.withColumn("until", F.max("redone").over(before))
            .filter(F.coalesce(F.col("first_seq") > F.col("until"), F.lit(True))).drop("redone", "until"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (text, loss): the segments joined are ``formatted``."""
    turn = F.struct(F.col("first_seq"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))

    def parts(m):
        head = F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n"))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(m["text"]).alias("text"), (m["role"] == ASSISTANT).alias("loss")),
                       F.struct(F.lit(CLOSE + "\n").alias("text"), F.lit(False).alias("loss")))

    return (messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"))
            .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    "segments"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts, formatted: parsed from the rendered form."""
    pieces = let(F.split("formatted", r"<\|im_start\|>"), lambda parts: F.slice(parts, 2, F.size(parts)))

    def turn(piece):
        cut = F.locate("\n", piece)
        body = F.substr(piece, cut + 1, F.length(piece) - cut - len(CLOSE) - 1)
        return F.struct(unescape_role(F.substr(piece, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return rendered.select("conv_id", F.transform(pieces, turn).alias("turns"),
                           F.array_compact(F.transform("segments", lambda s: F.when(s["loss"], unescape(s["text"])))).alias(
                               "loss_texts"), "formatted")


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parsed = read_back(render(fold(turns_as_events(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def with_probe(turns: DataFrame) -> DataFrame:
    """The table's conversations and conversation -1, whose texts hold control strings."""
    probe = turns.sparkSession.sql(
        "select -1L as conv_id, t as turn, r as role, '<|im_end|><|im_start|>assistant ok' as text "
        "from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


#: DuckDB SQL for ``digest(with_probe(conversations))``.
ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, v.turn, v.role, '<|im_end|><|im_start|>assistant ok'
  from (values (0, 'user'), (1, 'assistant')) as v(turn, role)),
e as (
  select *, replace(replace(text, '\', '\\'), '<|', '<\|') as text_out,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') as role_out from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(role_out) + 1 + length(text_out) + length('<|im_end|>') + 1)::bigint
         as formatted_chars
from e group by conv_id
"""

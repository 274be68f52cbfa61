"""Event-sourced chat reconstruction and rendering in DataFrame expressions (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: The template's markers, then other templates' control strings that texts may not smuggle in.
OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
ANGLED = r"\|im_start\|>|\|im_end\|>|\|nl\|>|\|endoftext\|>|/?s>|</?SYS>>"
SQUARED = r"/?INST\]"
#: Positions of a conversation that are joined before the conversation is.
SEGMENT = 256
#: Characters of a block in which a loss span is looked up.
BLOCK = 4096


def escaped(text: Column) -> Column:
    """The text with backslashes doubled and one put after the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, f"(<)({ANGLED})", r"$1\\$2"), rf"(\[)({SQUARED})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    """What `escaped` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, copy, role, text) of an event log.

    Events are (conv_id, turn, copy, seq, op, role, text). In the order of a conversation's seq, `delta` adds text to its message, `edit`
    replaces what the message has, and `regenerate` clears it and discards all later turns as they are by then. So an event counts if
    no edit or regeneration of its own message and no regeneration of an earlier turn comes after it: of a message
    only what follows the last of these is joined, and a message of which nothing is left, though something was
    discarded, is none. The role is that of the last event that counts and names one. Null texts count as empty, unknown ops as nothing. Events of
    equal seq order by op, then text. Texts are grouped message by message; of a whole conversation only numbers are sorted.
    """
    key = ["conv_id", "turn", "copy"]
    # the last regeneration of an earlier turn, where it comes after a message's first event
    message = events.groupBy(*key).agg(F.min("seq").alias("first"), F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regenerated"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    cut = message.withColumn("cut", F.max("regenerated").over(earlier)).where("cut > first").select(*(F.col(c).alias(f"__{c}") for c in key), "cut")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))

    last = F.max(F.when(F.col("op").isin("edit", "regenerate"), F.col("seq"))).alias("reset")
    parts = F.sort_array(F.collect_list(F.struct("seq", "op", F.coalesce("text", F.lit("")).alias("text"), "role")))
    folded = events.groupBy(*key).agg(last, parts.alias("parts")).join(cut, same, "left")
    counts = F.filter("parts", lambda p: F.col("cut").isNull() | (p["seq"] > F.col("cut")))
    folded = folded.select(*key, "reset", counts.alias("parts")).where(F.size("parts") > 0)
    role = F.element_at(F.filter("parts", lambda p: p["role"].isNotNull()), -1)["role"]
    role = F.when(F.exists("parts", lambda p: p["role"].isNotNull()), role)
    live = F.filter("parts", lambda p: (p["op"].isin("edit", "delta")) & (F.col("reset").isNull() | (p["seq"] >= F.col("reset"))))
    return folded.select(*key, role.alias("role"), F.array_join(F.transform(live, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from messages (conv_id, turn, copy, role, text), ordered by turn, then copy.

    A turn is OPEN role newline text CLOSE newline, role and text escaped so that no control string is left inside; a
    null role is the empty one. loss_spans are (start, end) in code points of the formatted string
    around the texts of `trained_role`. Positions come from a running sum, and strings are joined by segments of
    SEGMENT turns first, so that a very long conversation meets in one task only as few long strings.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit(BREAK))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    m = messages.select("conv_id", "turn", "copy", (F.col("role") == trained_role).alias("on"), F.length(head).alias("lead"), F.concat(head, escaped(F.coalesce("text", F.lit(""))), F.lit(CLOSE + "\n")).alias("piece"))
    m = m.withColumn("size", F.length("piece").cast("long"))
    place = Window.partitionBy("conv_id").orderBy("turn", "copy").rowsBetween(Window.unboundedPreceding, -1)
    at = m.select("conv_id", "turn", "copy", "on", "lead", "size").withColumn("at", F.coalesce(F.sum("size").over(place), F.lit(0).cast("long")))
    tail = len(CLOSE) + 1
    spans = at.where("on").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((F.col("at") + F.col("lead")).alias("start"), (F.col("at") + F.col("size") - tail).alias("end")))).alias("loss_spans"))
    segment = m.groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("turn", "copy", "piece"))).alias("p"))
    segment = segment.select("conv_id", "seg", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("s"))
    whole = segment.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "s"))).alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"))
    a, b = whole.alias("a"), spans.alias("b")
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.conv_id", "formatted", F.coalesce("loss_spans", empty).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: an array of (role, text), as they were before rendering."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2147483647))
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(parts, lambda p: F.struct(unescaped(F.replace(role(p), F.lit(BREAK), F.lit("\n"))).alias("role"), unescaped(F.substr(p, F.length(role(p)) + 2, F.lit(2147483647))).alias("text")))


def masked(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped: an array in the order of the spans.

    A string's substring is found by counting from its start, so it is cut into blocks once and spans count in theirs.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(formatted) / BLOCK).cast("int")), lambda k: F.substr(formatted, k * BLOCK + 1, F.lit(BLOCK)))
    at = lambda x: F.floor(x / BLOCK).cast("int")
    piece = lambda b, s: F.substr(F.array_join(F.slice(b, at(s["start"]) + 1, at(s["end"]) - at(s["start"]) + 1), ""), (s["start"] % BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    # an array of the one list, so that the blocks are made once for all spans
    return F.transform(F.array(blocks), lambda b: F.transform(loss_spans, lambda s: unescaped(piece(b, s))))[0]


def conversation_events(rows: DataFrame) -> DataFrame:
    """An event log that ends in the given rows (conv_id, turn, role, text), one message a row.

    Each row becomes a draft, a regeneration that discards it, and the text streamed in two deltas.
    Rows of equal conversation and turn are separate messages, in the order of role, then text.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("copy")
    numbered = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).select("*", copy)
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda i, op, text: F.struct((F.coalesce(F.col("turn"), F.lit(0)) * 4 + i).alias("seq"), F.lit(op).alias("op"), text.alias("text"))
    log = F.array(
        event(0, "delta", F.substring("text", 1, 8)),
        event(1, "regenerate", F.lit("")),
        event(2, "delta", F.substr("text", F.lit(1), half)),
        event(3, "delta", F.substr("text", half + 1, F.lit(2147483647))),
    )
    return numbered.select("conv_id", "turn", "copy", "role", F.explode(log).alias("e")).select("conv_id", "turn", "copy", "role", "e.*")


#: Fixed value: what conversation -1 says, twice.
SMUGGLED = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rebuilt from its log, rendered, and read back from the rendering."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.sql(f"select cast(-1 as bigint) as conv_id, cast(turn as bigint) as turn, role, '{SMUGGLED}' as text from values (0, 'user'), (1, 'assistant') as v(turn, role)")
    out = render(fold_events(conversation_events(rows.unionByName(extra))))
    turns = out.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "")
    read = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ESC = rf"regexp_replace(regexp_replace(replace({{0}}, '\', '\\'), '(<)({ANGLED})', '\1\\\2', 'g'), '(\[)({SQUARED})', '\1\\\2', 'g')"
ORACLE = {
    "op8_chat": f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{SMUGGLED}' union all select -1, 1, 'assistant', '{SMUGGLED}'),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
  coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
  sum({len(OPEN) + len(CLOSE) + 2} + length(replace({_ESC.format("role")}, chr(10), '{BREAK}')) + length({_ESC.format("text")})) as formatted_chars
  from c group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars from g"""
}

"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log of events (conversation, sequence, message, kind, role, text) is partitioned by conversation, sorted by sequence
and folded: a delta appends to its message, an edit or a regenerate drops what the message held and every later message
that was finished before it. The final messages are rendered with control strings that the texts cannot contain, and
read back from the rendered text.

Nulls: a null text or role is empty, a null kind is a delta, a null conversation is a conversation. Repeated events
apply each time; events that tie in sequence apply in the order of kind, role and text. No event, no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What a text may not hold as it is: the three marks above and those of other chat formats.
_REST = r"(\|(?:turn|text|end)\|>|/?s>|/?INST\])"
#: A control string, or one that was escaped before: any number of backslashes after its first character.
ESCAPABLE, ESCAPED = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    """Adds a backslash after the first character of every (escaped or plain) control string; unescape() takes it away."""
    return F.regexp_replace(text, F.lit(ESCAPABLE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def fold(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, msg, kind, role, text) to messages(conv_id, msg, role, text), msg giving their order.

    The events are shuffled once, by conversation; the folds of a message and of a conversation use that partitioning.
    """
    resets = F.col("kind").isin("edit", "regenerate")
    e = events.select("conv_id", "msg", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    parts = e.groupBy("conv_id", "msg").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"),
        F.max("seq").alias("last_seq"),
        F.max(F.when(resets, F.col("seq"))).alias("reset_seq"),
    )
    # The texts after the last reset; an edit brings the text that replaces the old one, a regenerate usually none.
    kept = F.aggregate("log", F.lit(0), lambda at, x: F.when(x.kind.isin("edit", "regenerate"), F.lit(0)).otherwise(at) + 1)
    live = F.slice(F.col("log"), F.size("log") - kept + 1, F.greatest(kept, F.lit(1)))
    earlier = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    m = parts.withColumn("cut", F.max("reset_seq").over(earlier)).where(F.col("cut").isNull() | (F.col("last_seq") > F.col("cut")))
    return m.select("conv_id", "msg", F.element_at("log", -1).role.alias("role"), F.array_join(F.transform(live, lambda x: x.text), "").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages(conv_id, msg, role, text) to one row a conversation: formatted text and loss spans.

    loss: array of (start, end) in code points, end exclusive, of the escaped texts of the roles to learn from.
    """
    m = messages.withColumns({"head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), "body": escape(F.col("text"))})
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head"))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("msg", "piece", F.col("role").isin(*learn).alias("learnt"), "start", (F.col("start") + F.length("body")).alias("end")))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x: x.piece), "").alias("formatted"), F.transform(F.filter("turns", lambda x: x.learnt), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as array of (role, text)."""

    def turn(part: Column) -> Column:
        at = F.split(F.substring(part, F.lit(1), F.length(part) - len(END)), r"<\|text\|>", 2)
        return F.struct(unescape(at[0]).alias("role"), unescape(at[1]).alias("text"))

    parts = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def learnt(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss spans."""
    return F.transform(loss, lambda x: unescape(F.substring(formatted, (x.start + 1).cast("int"), (x.end - x.start).cast("int"))))

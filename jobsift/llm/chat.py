"""Chat formatting by quotation linking (DataFrame functions only).

``link_quotes(messages)`` reads each message's lines, counts the quote level
of every line (leading ``>`` marks), hashes the normalised quoted passages
(a passage is a quoted line; lower case, blanks collapsed), and joins them to
the message of the same conversation that first said the passage as its own
text.  A message replies to the original that most of its level-1 passages
come from (ties: the later one).  Reply trees are closed by pointer jumping
(log2 of the depth rounds), each message ending with its thread's root and
its depth, so ``orderBy(conv, thread_root, depth, turn)`` reads a conversation
in reply order without gathering it in one task.

Every quoted passage meets one original at most (the first), so a line that
all messages repeat makes no pairs.

Defined cases: a null text has no lines (body null); a quote of nothing said
before stays unlinked; messages with a null conversation or turn link to
nothing and are their own root; repeated (conversation, turn) rows are each
returned, and count as one original (their passages together); an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import materialise

MARKS = r"^((?:[ \t]*>)*)"


def quote_lines(text: Column) -> Column:
    """array<struct<level, line, norm>> of a message's lines."""
    def parse(line):
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        rest = F.when(level > 0, F.substring(line, F.length(marks) + 1, F.length(line))).otherwise(line)
        norm = F.lower(F.trim(F.regexp_replace(rest, r"[ \t\r]+", " ")))
        return F.struct(level.alias("level"), rest.alias("line"), norm.alias("norm"))
    return F.transform(F.split(text, "\n"), parse)


def own_text(lines: Column) -> Column:
    """The lines of level 0, as they were."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """-> the rows of ``messages`` as (conv, turn, body, n_quotes, max_level,
    n_linked, parent_turn, thread_root, depth)."""
    parsed = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), quote_lines(F.col(text)).alias("_l"))
    parsed = materialise(parsed.select("conv", "turn", own_text(F.col("_l")).alias("body"), "_l"))
    lines = parsed.select("conv", "turn", F.explode("_l").alias("x")).select(
        "conv", "turn", F.col("x.level").alias("level"), F.xxhash64("x.norm").alias("passage"),
        (F.col("x.norm") != "").alias("said")).where("said").drop("said")
    quoted = lines.where("level > 0").distinct()
    first = lines.where("level = 0").groupBy("conv", "passage").agg(F.min("turn").alias("origin"))
    linked = materialise(quoted.join(first, ["conv", "passage"], "left").withColumn(
        "origin", F.when(F.col("origin") < F.col("turn"), F.col("origin"))))
    per_message = linked.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.max("level").alias("max_level"),
        F.count("origin").alias("n_linked"))
    votes = (linked.where("level = 1 and origin is not null").groupBy("conv", "turn", "origin")
             .agg(F.count(F.lit(1)).alias("votes")).groupBy("conv", "turn")
             .agg(F.max(F.struct("votes", "origin"))["origin"].alias("parent_turn")))
    nodes = (parsed.select("conv", "turn").where("conv is not null and turn is not null").distinct()
             .join(votes, ["conv", "turn"], "left"))
    threads = close_threads(nodes)
    k, t = F.col("conv"), F.col("turn")
    out = (parsed.drop("_l")
           .join(per_message.select(k.alias("_c1"), t.alias("_t1"), "n_quotes", "max_level", "n_linked"),
                 k.eqNullSafe(F.col("_c1")) & t.eqNullSafe(F.col("_t1")), "left")
           .join(threads.withColumnsRenamed({"conv": "_c2", "turn": "_t2"}),
                 (k == F.col("_c2")) & (t == F.col("_t2")), "left"))
    zero = F.lit(0).cast("long")
    return out.select(k, t, "body", F.coalesce("n_quotes", zero).alias("n_quotes"),
                      F.coalesce(F.col("max_level").cast("long"), zero).alias("max_level"),
                      F.coalesce("n_linked", zero).alias("n_linked"), "parent_turn",
                      F.coalesce("thread_root", t).alias("thread_root"), F.coalesce("depth", zero).alias("depth"))


def close_threads(nodes: DataFrame) -> DataFrame:
    """nodes(conv, turn, parent_turn) -> with thread_root and depth, by
    pointer jumping; only messages whose pointer is open are joined again."""
    state = materialise(nodes.withColumns({
        "ptr": F.col("parent_turn"), "thread_root": F.coalesce("parent_turn", "turn"),
        "depth": F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("long")}))
    closed = None
    while True:
        done = state.where("ptr is null")
        closed = done if closed is None else closed.unionByName(done)
        open_ = state.where("ptr is not null")
        if not open_.limit(1).count():
            return closed.drop("ptr")
        # what a pointer leads to is either open in this round or closed before
        up = closed.unionByName(open_).select(
            F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("ptr").alias("_ptr"),
            F.col("thread_root").alias("_root"), F.col("depth").alias("_depth"))
        state = materialise(
            open_.join(up, (F.col("conv") == F.col("_c")) & (F.col("ptr") == F.col("_t")), "left")
            .select("conv", "turn", "parent_turn", F.col("_ptr").alias("ptr"),
                    F.coalesce("_root", "thread_root").alias("thread_root"),
                    (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))

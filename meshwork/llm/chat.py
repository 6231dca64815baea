"""Chat formatting: reply trees to conversations with a loss mask.

Messages form trees by their parent. Iterative self-joins enumerate the paths from the root to
every leaf: pointer doubling first joins each message to its 1st, 2nd, 4th, ... ancestor, then
each leaf walks up by falling powers of two, so a path of d messages takes 2 log2(d) joins and
only rows of real paths are made. The paths of a tree are ranked by score, and the best ``top``
become one text each by the template

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

In roles and texts a backslash is doubled, and one is put inside whatever could be read as a
control string (<|, <s>, </s>, <<SYS>>, [INST], [/INST]); dropping one backslash before any character
undoes it. The loss mask is the list of [start, end) code points of the assistant texts.

Defined results: null texts and roles are empty; a null tree id is a tree of its own; a message
whose parent is missing is a root; messages on a cycle, or that only lead to one, belong to no path, nor does one
without a node id; rows of a tree that share a node are one message (the least by parent, role,
text and score counts); turns of a conversation that share a turn are messages of their own, in a fixed
order; an empty table gives no rows; other columns are ignored.
Turns of a conversation are collected per path, as one output row holds them anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import cut, text_or_empty

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_SPECIAL = r"(<(?=\||/?s>|</?SYS>)|\[(?=/?INST\]))"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def chains(conversations: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations: every turn replies to the one before it. Columns tree, node, parent, role, text, score."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), text_or_empty(F.col(role)).alias("role"), text_or_empty(F.col(text)).alias("text"))
    node = F.row_number().over(order).cast("bigint")
    return rows.withColumn("node", node).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """tree, leaf, node, depth (from 0 at the root), score (sum along the path), rank (1: the best of its tree), for the best ``top`` paths of each tree."""
    nodes = messages.select("tree", "node", "parent", "score")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p")).distinct()
    nodes = nodes.join(known, _same("tree", "t") & (F.col("parent") == F.col("p")), "left")
    nodes = cut(nodes.select("tree", "node", F.col("p").alias("up"), "score"), "nodes")
    jumps = [nodes.where("up is not null").select("tree", "node", "up")]
    left = jumps[0].count()
    while left:
        last = jumps[-1]
        ahead = last.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"))
        further = cut(last.join(ahead, _same("tree", "t") & (F.col("up") == F.col("n"))).select("tree", "node", F.col("far").alias("up")), "jumps")
        before, left = left, further.count()
        if left == before:
            # while some message of a tree is that deep, another one is as deep as this jump and drops out: all that are left lead into a cycle
            lost = further.select(F.col("tree").alias("t"), F.col("node").alias("n"))
            whole = lambda df: cut(df.join(lost, _same("tree", "t") & (F.col("node") == F.col("n")), "left_anti"), "nodes")
            nodes, jumps = whole(nodes), [whole(x) for x in jumps]
            break
        if left:
            jumps.append(further)
    parents = nodes.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = nodes.join(parents, _same("tree", "t") & (F.col("node") == F.col("n")), "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up_by"))
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = walk.join(step, _same("tree", "t") & (F.col("node") == F.col("n")))
        walk = walk.unionByName(more.select("tree", "leaf", F.col("up").alias("node"), (F.col("up_by") + (1 << k)).alias("up_by")))
        walk = cut(walk, "paths")
    scored = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    walk = walk.join(scored, _same("tree", "t") & (F.col("node") == F.col("n"))).drop("t", "n")
    totals = walk.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("up_by").alias("length"))
    best = Window.partitionBy("tree").orderBy(F.col("total").desc(), "leaf")
    totals = totals.withColumn("rank", F.row_number().over(best))
    if top is not None:
        totals = totals.where(F.col("rank") <= top)
    totals = totals.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), F.col("total").alias("path_score"), "length", "rank")
    return walk.join(totals, _same("tree", "t") & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "node", (F.col("length") - F.col("up_by")).alias("depth"), F.col("path_score").alias("score"), "rank")


def once(messages: DataFrame) -> DataFrame:
    """One message for each node of a tree, with empty texts and roles for null ones."""
    rest = F.struct("parent", text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"), "score")
    return messages.where("node is not null").groupBy("tree", "node").agg(F.min(rest).alias("m")).select("tree", "node", "m.*")


def formatted(messages: DataFrame, top: int | None = None, distinct: bool = False) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, formatted (text), loss (array of start, end). distinct: no two messages share a node, and no text or role is null."""
    messages = messages if distinct else cut(once(messages), "messages")
    chosen = paths(messages, top).select(F.col("tree").alias("t"), "leaf", F.col("node").alias("n"), "depth", F.col("score").alias("path_score"), "rank")
    turns = messages.select("tree", "node", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == LOSS_ROLE).alias("learn"))
    turns = turns.join(chosen, _same("tree", "t") & (F.col("node") == F.col("n")))
    turns = turns.withColumn("n", F.length("text")).withColumn("turn", F.concat(F.lit(OPEN), "role", F.lit(SEP), "text", F.lit(CLOSE)))
    upto = Window.partitionBy("tree", "leaf", "rank", "path_score").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("end", F.sum(F.length("turn")).over(upto) - len(CLOSE))
    one = F.struct("depth", "turn", F.struct((F.col("end") - F.col("n")).cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("span"), "learn")
    lists = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(one)).alias("turns")).withColumnRenamed("path_score", "score")
    sums = F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: x["span"])
    return lists.select("tree", "leaf", "rank", "score", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), sums.alias("loss"))


def parsed(formatted_text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    turns = F.slice(F.split(formatted_text, r"\Q" + OPEN + r"\E", -1), 2, 1 << 30)
    part = lambda x, i: F.get(F.split(F.regexp_replace(x, r"\Q" + CLOSE + r"\E\z", ""), r"\Q" + SEP + r"\E", -1), i)
    return F.transform(turns, lambda x: F.struct(unescape(part(x, F.lit(0))).alias("role"), unescape(part(x, F.lit(1))).alias("text")))


def masked(formatted_text: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted_text, x["start"] + 1, x["end"] - x["start"]))), "")


def probe(conversations: DataFrame) -> DataFrame:
    """conversations with one more, -7, whose texts look like control strings."""
    says = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{says}'), (-7L, 1L, '{LOSS_ROLE}', '{says}') AS t (conv_id, turn, role, text)")
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(more)


def report(conversations: DataFrame) -> DataFrame:
    """The digest columns of the query op6, read back from the formatted texts."""
    out = cut(formatted(chains(probe(conversations)), top=1, distinct=True), "formatted")
    turns = parsed(F.col("formatted"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.withColumn("turns", turns).withColumn("masked", masked(F.col("formatted"), F.col("loss")))
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )

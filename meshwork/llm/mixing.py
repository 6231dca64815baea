"""Mixing sources to target weights: how often each document is taken so that sources come near their shares.

Every document of a source may be taken target / size-of-source times; the whole part is certain,
the fraction is rounded by pivotal dependent rounding. Two fractional documents are paired and
words ("mass") move from one to the other, in either direction by chance, until one has a whole
number of copies; the other goes on. The chances keep each document's expected copies, and moving
words instead of copies keeps the pair's words, so a source ends within a small document of
its target. Pairs are formed in blocks of about ``BLOCK`` documents; what a block leaves over (at
most one fractional document) goes up a reduction tree in groups of ``BLOCK``. The tree's last
document is rounded by chance; the words this adds or takes are spread over a pool of about
``POOL`` / 2 documents of at most mean size, which is rounded last. All of it is DataFrame
functions; chance is a hash of the documents, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
sources are ordered by code point and weigh 5, 2, 1, 5, ...; documents of size 0 take no words (copies is the whole part
of their source's ratio), sources of size 0 nothing; repeated rows (same doc_id, source and size) share one decision; an empty
table gives no rows; other columns are ignored. The sources (one row each) are ranked in one
window, as an order over all of them is asked for; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import WORD, cut, text_or_empty

BLOCK = 128
#: About twice as many documents of each source as its pool has.
POOL = 256
WEIGHTS = (5, 2, 1)
MOST = 3
_ITEM = "struct<h:bigint,doc:{doc},size:bigint,mult:bigint,w:double,x:double,base:bigint>"


def words(text: str) -> Column:
    return F.regexp_count(text_or_empty(F.col(text)), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source of sizes (source, size, mult): source_size, items, target. The targets fill up like water: a level times the weight, but at most ``most`` times the size."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("mult")).alias("source_size"), F.count("*").alias("items"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("full", F.col("cap") / F.col("weight"))
    up = Window.orderBy("full", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everything))
    return per.select("source", "source_size", "items", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _meet(seed: int):
    """The reduction of a sorted block: state (cur: the fractional document so far, done: documents with whole copies)."""

    def step(state: Column, b: Column) -> Column:
        a = state["cur"]
        up = F.least((1 - a["x"]) * a["w"], b["x"] * b["w"])  # words that a can get from b
        down = F.least(a["x"] * a["w"], (1 - b["x"]) * b["w"])
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["h"], b["h"]), 11) / F.lit(float(1 << 53))
        rises = chance * (up + down) < down
        a_full, b_empty = up >= (1 - a["x"]) * a["w"], up >= b["x"] * b["w"]
        a_empty = down >= a["x"] * a["w"]
        moved = F.when(rises, up).otherwise(-down)
        a_done = F.when(rises, a_full).otherwise(a_empty)
        new_a = F.when(rises & a_full, 1.0).when(~rises & a_empty, 0.0).otherwise(_unit(a["x"] + moved / a["w"]))
        new_b = F.when(rises & b_empty, 0.0).when(~rises & (down >= (1 - b["x"]) * b["w"]), 1.0).otherwise(_unit(b["x"] - moved / b["w"]))
        left, ready = a.withField("x", new_a), b.withField("x", new_b)
        met = F.struct(
            F.when(a_done, ready).otherwise(left).alias("cur"),
            F.concat(state["done"], F.array(F.when(a_done, left).otherwise(ready))).alias("done"),
        )
        return F.when(a.isNull(), F.struct(b.alias("cur"), state["done"].alias("done"))).otherwise(met)

    return step


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _reduce(rows: DataFrame, item: str, seed: int) -> DataFrame:
    """rows (source, block, item) to one row per source and block: done, cur."""
    nothing = F.struct(F.lit(None).cast(item).alias("cur"), F.array().cast(f"array<{item}>").alias("done"))
    blocks = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list("item")).alias("all"))
    return blocks.select("source", "block", F.aggregate("all", nothing, _meet(seed)).alias("r")).select("source", "block", "r.cur", "r.done")


def _settled(pool: DataFrame, last: DataFrame, item: str, seed: int) -> DataFrame:
    """Per source: the pool's documents rounded, after their fractions have made up for what rounding the tree's last document (last: source, d, up) added or took."""
    lists = pool.groupBy("source").agg(F.sort_array(F.collect_list("item")).alias("all"))
    errors = last.select(F.col("source").alias("of"), (F.col("d.w") * (F.col("up").cast("double") - F.col("d.x"))).alias("error"))
    rows = lists.join(errors, F.col("source").eqNullSafe(F.col("of")), "left")
    words = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda s, x: s + of(x))
    rows = rows.withColumn("aim", words("all", lambda x: x["w"] * x["x"]) - F.coalesce("error", F.lit(0.0))).withColumn("mass", words("all", lambda x: x["w"]))
    for _ in range(3):  # fractions stay between 0 and 1, so what some can't take goes to the others
        short = (F.col("aim") - words("all", lambda x: x["w"] * x["x"])) / F.col("mass")
        rows = rows.withColumn("short", short).withColumn("all", F.transform("all", lambda x: x.withField("x", _unit(x["x"] + F.col("short")))))
    nothing = F.struct(F.lit(None).cast(item).alias("cur"), F.array().cast(f"array<{item}>").alias("done"))
    return rows.select("source", F.aggregate("all", nothing, _meet(seed - 1)).alias("r")).select("source", "r.cur", "r.done")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per distinct (doc, source, size): mult (rows that are alike), source_size, target, copies."""
    item = _ITEM.format(doc=docs.schema[doc_id].dataType.simpleString())
    sizes = docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), words(text).alias("size"))
    sizes = cut(sizes.groupBy("doc", "source", "size").agg(F.count("*").alias("mult")), "sizes")
    targets = cut(source_targets(sizes, weights, most), "targets")
    to = targets.withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(to, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("ratio", ratio)
    rows = rows.withColumn("base", F.floor("ratio")).withColumn("x", F.col("ratio") - F.col("base"))
    rows = rows.withColumn("w", (F.col("size") * F.col("mult")).cast("double")).withColumn("h", F.xxhash64(F.lit(seed), "doc", "source", "size"))
    open_ = (F.col("x") > 0) & (F.col("w") > 0)
    pool = open_ & (F.col("w") * F.col("items") <= F.col("source_size")) & (F.pmod(F.col("h"), F.ceil(F.col("items") / POOL)) == 0)
    one = F.struct("h", "doc", "size", "mult", "w", "x", "base").cast(item).alias("item")
    first = rows.where(open_ & ~pool).select("source", F.pmod(F.col("h"), F.ceil(F.col("items") / BLOCK)).alias("block"), one)
    most_items = targets.agg(F.max("items")).first()[0] or 0
    levels, blocks = [cut(_reduce(first, item, seed), "blocks")], -(-most_items // BLOCK)
    while blocks > 1:
        up = levels[-1].where("cur is not null").select("source", F.floor(F.col("block") / BLOCK).alias("block"), F.col("cur").alias("item"))
        levels.append(cut(_reduce(up, item, seed + len(levels)), "blocks"))
        blocks = -(-blocks // BLOCK)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("d.h"), F.lit(-1)), 11) / F.lit(float(1 << 53))
    last = levels[-1].where("cur is not null").select("source", F.col("cur").alias("d")).withColumn("up", chance < F.col("d.x"))
    ended = cut(_settled(rows.where(pool).select("source", one), last, item, seed), "pools")
    decided = last.unionByName(ended.where("cur is not null").select("source", F.col("cur").alias("d")).withColumn("up", chance < F.col("d.x")))
    levels.append(ended)
    for level in levels:
        decided = decided.unionByName(level.select("source", F.explode("done").alias("d")).withColumn("up", F.col("d.x") >= 0.5))
    decided = decided.select("source", F.col("d.doc").alias("doc"), F.col("d.size").alias("size"), F.col("d.mult").alias("mult"), (F.col("d.base") + F.col("up").cast("bigint")).alias("copies"))
    decided = decided.join(to, F.col("source").eqNullSafe(F.col("of"))).drop("of", "items")
    whole = rows.where(~open_).select("source", "doc", "size", "mult", F.col("base").alias("copies"), "source_size", "target")
    return decided.unionByName(whole)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, copies."""
    doc_id = options.get("doc_id", "doc_id")
    out = copies(docs, **options).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("mult"))))
    return out.select(F.col("doc").alias(doc_id), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    made = copies(docs, **options).where("copies > 0").select(F.col("doc").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    doc_id, source, text = (options.get(k, k) for k in ("doc_id", "source", "text"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), words(text).alias("_words"))  # columns of any name
    row = F.col("_row")
    both = packed.join(made, row[doc_id].eqNullSafe(F.col("_doc")) & row[source].eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")))
    return both.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")

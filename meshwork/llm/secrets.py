"""Secret scans: strong secrets by pattern, weak ones by linking the parts of a credential.

A credential has several parts: an access identifier, a secret and an endpoint. Strong secrets
(assignments of a long value, access key ids, long hexadecimal runs) are reported on their own.
Weak candidates (identifiers, short or loosely named secrets, endpoints) are reported only where
complementary parts stand together: an interval join within the document links parts whose gap is
at most ``SCOPE`` code points. The join is on (document, stretch of SCOPE code points), so the
candidates of one key are bounded by the length of a stretch, however long the document is.

Text is only read in one narrow projection: for each kind it keeps the lengths of the matches and
of what lies between; positions are running sums over those. DataFrame functions throughout.

Defined results: a null text is empty and has no spans; a null doc_id is a document like others;
repeated rows are each reported with the same spans; an empty table gives no rows; other columns
are ignored. Positions are code points, end exclusive; spans of one kind don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import cut, text_or_empty

SCOPE = 200
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
ASSIGN, ACCESS, HEX, IDENT, WEAK, ENDPOINT = range(len(KINDS))

#: Fixed patterns of the strong kinds; (?i) folds ASCII letters only.
ASSIGN_PATTERN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_PATTERN = r"AKIA[A-Z0-9]+"
HEX_PATTERN = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: A match of these patterns is a weak candidate.
IDENT_PATTERN = r"""(?i)\b(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
WEAK_PATTERN = r"""(?i)\b(?:pass|pwd|passphrase|credentials?|auth|private_?key|(?:access|secret|shared)_?key|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%-]{4,}"""
SHORT_HEX_PATTERN = r"(?<![0-9a-zA-Z])[0-9a-f]{16,31}(?![0-9a-zA-Z])"
ENDPOINT_PATTERN = r"""(?i)\b(?:(?:https?|s?ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+|(?:host(?:_?name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,})"""
#: Short values of strong names are weak candidates from this length on.
SHORT_LEAST = 4

_FOUND = "array<struct<kind:int,scan:int,i:int,gap:int,n:int,use:int>>"


def _scan(text: Column, scan: int, pattern: str, able: Column, kind: Column | int, use=None) -> Column:
    """Every match of pattern in order: the code points before it (since the last), its length, and whether and as what it counts (use: -1 none, else kind)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    one = lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"))
    rows = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, one)
    if use is None:
        use = lambda x, i: F.lit(kind)
    made = F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(scan).alias("scan"), i.cast("int").alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), use(x, i).cast("int").alias("use")))
    return F.when(able & text.rlike(pattern), made).otherwise(F.array().cast(_FOUND)).cast(_FOUND)


def found_parts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text) and every match in the text, without positions yet."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    t = F.col("text")
    paired = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    values = F.regexp_extract_all(t, F.lit(ASSIGN_PATTERN), F.lit(2))
    long_enough = lambda x, i: F.when(F.length(F.get(values, i)) >= ASSIGN_LEAST, ASSIGN).when(F.length(F.get(values, i)) >= SHORT_LEAST, WEAK).otherwise(-1)
    scans = [
        _scan(t, 0, ASSIGN_PATTERN, paired, ASSIGN, long_enough),
        # of these two only long matches count, and asking for them at once finds the same ones
        _scan(t, 1, ACCESS_PATTERN[:-1] + f"{{{ACCESS_LEAST - 4},}}", F.contains(t, F.lit("AKIA")), ACCESS),
        _scan(t, 2, HEX_PATTERN[:-1] + f"{{{HEX_LEAST},}}", F.lit(True), HEX),
        _scan(t, 3, IDENT_PATTERN, paired, IDENT),
        _scan(t, 4, WEAK_PATTERN, paired, WEAK),
        _scan(t, 5, SHORT_HEX_PATTERN, F.lit(True), WEAK),
        _scan(t, 6, ENDPOINT_PATTERN, paired, ENDPOINT),
    ]
    return rows.select("doc_id", F.xxhash64("text").alias("h"), F.concat(*scans).alias("found"))


def positioned(found: DataFrame) -> DataFrame:
    """One row per part that may count: doc_id, h, kind, start, end."""
    one = found.where(F.size("found") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode("found").alias("x")).select("doc_id", "h", "x.*")
    upto = Window.partitionBy("doc_id", "h", "scan").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    return one.withColumn("end", end).where("use >= 0").select("doc_id", "h", F.col("use").alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates that stand within scope of a complementary part: secrets by an identifier or endpoint, those by a secret."""
    key = [F.col("doc_id").alias("d"), F.col("h").alias("g")]
    sides = {True: parts.where(F.col("kind").isin(ASSIGN, HEX, WEAK)), False: parts.where(F.col("kind").isin(ACCESS, IDENT, ENDPOINT))}
    out = None
    for is_secret, mine in sides.items():
        weak = mine.where(F.col("kind").isin(IDENT, WEAK, ENDPOINT))
        left = weak.withColumn("at", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
        right = sides[not is_secret].select(*key, F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("b"))
        near = (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope)
        met = left.join(right, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("at") == F.col("b")) & near, "left_semi").drop("at").distinct()
        out = met if out is None else out.unionByName(met)
    return out


def scan(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, spans (array of start, kind, end; strong ones and linked weak ones, by start, then kind)."""
    found = cut(found_parts(docs, doc_id, text), "secret-parts")
    parts = cut(positioned(found), "secret-spans")
    every = parts.where(F.col("kind").isin(ASSIGN, ACCESS, HEX)).unionByName(linked(parts, scope))
    span = F.struct("start", F.col("kind"), "end")
    lists = every.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    some = found.where(F.size("found") > 0).join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    rest = found.where(F.size("found") == 0)
    return some.select("doc_id", F.coalesce("spans", none).alias("spans")).unionByName(rest.select("doc_id", none.alias("spans"))).withColumnRenamed("doc_id", doc_id)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query op1."""
    out = scan(docs)
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"] <= HEX)
    return out.select("doc_id", count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

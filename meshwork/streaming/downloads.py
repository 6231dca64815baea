"""From attempts to fetch files to the state of each file: in a batch, or keyed state with timers as attempts arrive.

An attempt is (id, at, code, policy, size): code is null where nothing answered, policy tells that the own network forbade it, and
a size without code is a file that was there already. A file that is there is ok; predicted models are skipped, as another source
has them; a 404 (not_found) and a policy's 403 (denied) end it too. Anything else is tried again, up to ``TRIES`` times in all,
each time ``WAIT`` seconds longer after the attempt before; then it has failed. What comes after an end changes nothing.

In the stream, files are dealt to ``BUCKETS`` by their id, and a bucket is one key: its files' states are one Arrow table, and all its
attempts of a batch are worked on at once. (A state and a timer of its own for each file took several calls between processes a file.)
The number of buckets is part of a checkpoint.

Defined results: attempts at one time count in order of outcome; a null id takes no part; attempts that are late in the stream
count in order of arrival; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meshwork.sources.tables import predicted

#: Tries of a file, and seconds to wait after the first (the second waits twice that).
TRIES, WAIT = 3, 1.5
BUCKETS = 1024
STATES = "id string, status string, tries int, due timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def outcome() -> Column:
    """What one attempt means: skipped, ok, not_found, denied, or again."""
    there = (F.col("size") > 0) & (F.col("code").isNull() | F.col("code").between(200, 299))
    ends = F.when(predicted(), "skipped").when(there, "ok").when(F.col("code") == 404, "not_found")
    return ends.when((F.col("code") == 403) & F.coalesce("policy", F.lit(False)), "denied").otherwise("again")


def states(attempts: DataFrame) -> DataFrame:
    """id, status (ok, skipped, not_found, denied, failed, waiting), tries, due (of the next try, where it waits)."""
    rows = attempts.where("id is not null").select("id", "at", outcome().alias("outcome"))
    order = Window.partitionBy("id").orderBy("at", "outcome")
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRIES)  # the first tries of a key are kept before the shuffle
    ended = F.min(F.when(F.col("outcome") != "again", F.struct("k", "outcome"))).alias("ended")
    some = first.groupBy("id").agg(ended, F.max(F.struct("k", "at")).alias("last"))
    waits = F.col("ended").isNull() & (F.col("last.k") < TRIES)
    due = F.timestamp_micros(F.unix_micros("last.at") + (F.col("last.k") * WAIT * 1_000_000).cast("bigint"))
    status = F.when(F.col("ended").isNotNull(), F.col("ended.outcome")).when(waits, "waiting").otherwise("failed")
    return some.select("id", status.alias("status"), F.coalesce("ended.k", "last.k").alias("tries"), F.when(waits, due).alias("due"))


_KEPT = pa.schema([("id", pa.string()), ("tries", pa.int32()), ("ended", pa.bool_()), ("due", pa.int64())])


class Tries(StatefulProcessor):
    """Per bucket: how many tries each of its files had, whether it has ended, and when (ms) its next try is due. One timer a bucket stands at the least of these."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "files binary, timer bigint")

    def _load(self) -> tuple[pd.DataFrame, int | None]:
        """The files' states (due: -1 for none), and the timer."""
        files, timer = self.kept.get() if self.kept.exists() else (None, None)
        table = pa.ipc.open_stream(files).read_all() if files is not None else _KEPT.empty_table()
        return pd.DataFrame({"id": table["id"].to_numpy(zero_copy_only=False), "tries": table["tries"].to_numpy(), "ended": table["ended"].to_numpy(), "due": table["due"].to_numpy()}), timer

    def _store(self, files: pd.DataFrame, timer: int | None) -> None:
        waits = files["due"].to_numpy()
        waits = waits[waits >= 0]
        least = int(waits.min()) if len(waits) else None
        if timer is not None and timer != least:
            self.handle.deleteTimer(timer)
        if least is not None and timer != least:
            self.handle.registerTimer(least)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _KEPT) as out:
            out.write_table(pa.Table.from_arrays([pa.array(files[f.name].to_numpy(), f.type) for f in _KEPT], schema=_KEPT))
        self.kept.update((sink.getvalue().to_pybytes(), least))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([r[["id", "micros", "outcome"]] for r in rows], ignore_index=True)
        code, ids = pd.factorize(new["id"])
        outcome, micros = new["outcome"].to_numpy(object).astype(str), new["micros"].to_numpy(np.int64)
        order = np.lexsort((outcome, micros, code))
        code, outcome, micros = code[order], outcome[order], micros[order]
        count = np.bincount(code, minlength=len(ids))
        start = np.cumsum(count) - count
        files, timer = self._load()
        at = pd.Index(files["id"]).get_indexer(pd.Index(ids))
        known = at >= 0
        before, over = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        before[known], over[known] = files["tries"].to_numpy()[at[known]], files["ended"].to_numpy()[at[known]]
        nth = np.arange(len(code)) - start[code] + 1
        stops = np.where((outcome != "again") | (before[code] + nth >= TRIES), nth, len(code) + 1)
        used = np.minimum(np.minimum.reduceat(stops, start), count)  # attempts of each file that count
        last = start + used - 1
        tries, ended = before + used, (outcome[last] != "again") | (before + used >= TRIES)
        due = micros[last] + (tries * WAIT * 1_000_000).astype(np.int64)
        change = pd.DataFrame({"id": ids, "tries": tries.astype(np.int32), "ended": ended, "due": np.where(ended, -1, -(-due // 1000))})
        here = known & ~over
        for c in ("tries", "ended", "due"):
            column = files[c].to_numpy(copy=True)
            column[at[here]] = change[c].to_numpy()[here]
            files[c] = column
        self._store(pd.concat([files, change[~known]], ignore_index=True) if (~known).any() else files, timer)
        status = np.where(~ended, "waiting", np.where(outcome[last] == "again", "failed", outcome[last]))
        out = pd.DataFrame({"id": ids, "status": status, "tries": tries.astype(np.int32), "due": pd.array(np.where(ended, 0, due), "Int64")})
        out.loc[ended, "due"] = pd.NA
        yield out[~over]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        files, _ = self._load()
        due = files["due"].to_numpy(copy=True)
        come = (due >= 0) & (due <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        out = pd.DataFrame({"id": files["id"][come], "status": "due", "tries": files["tries"][come], "due": due[come] * 1000})
        due[come] = -1
        files["due"] = due
        self._store(files, None)  # the timer that came is gone
        yield out

    def close(self) -> None:
        pass


def tracked(attempts: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """From a stream of attempts: a row (id, status, tries, due) at each change, and one of status due when the time of a waiting file's next try has come."""
    rows = attempts.where("id is not null").withWatermark("at", delay).select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket"), "id", "at", F.unix_micros("at").alias("micros"), outcome().alias("outcome"))
    made = rows.groupBy("bucket").transformWithStateInPandas(Tries(), "id string, status string, tries int, due bigint", "Append", "EventTime")
    return made.select("id", "status", "tries", F.timestamp_micros("due").alias("due"))


def track(attempts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs ``tracked`` over what a stream of attempts has at present, appending changes to Parquet files in folder, each once also over restarts from the checkpoint."""
    spark = attempts.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return tracked(attempts).writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)


def latest(changes: DataFrame) -> DataFrame:
    """Each id's last change, as ``states`` gives it."""
    some = changes.where("status <> 'due'").groupBy("id").agg(F.max(F.struct("tries", "status", "due")).alias("s"))
    return some.select("id", "s.status", "s.tries", "s.due")

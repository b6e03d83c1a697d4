"""Activity streams: new items, dedup, windows and sessions, incremental upsert."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

SEEN = 50


def event_key(*parts: str) -> Column:
    """The parts joined by a bar; it does not depend on when an event is read."""
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def recent_activity(items: DataFrame, ident: str, ts: str, k: int = 60) -> DataFrame:
    """The k latest distinct items."""
    return items.groupBy(ident).agg(F.max(ts).alias(ts)).orderBy(F.desc(ts), ident).limit(k)


def read_events(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """A file stream over a folder of parquet files, event times in UTC."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


class NewItems(StatefulProcessor):
    """One followed key's state: whether its first batch came, and the newest ``keep`` markers seen, oldest first.

    The first batch fills the list silently; markers of later ones that are not in it come out, each once for a step, in the order of time. Arrow batches are
    taken one by one: what is held besides is the list, the step's new markers and the newest rows. With ``expire_days`` a key that had no
    event for so long, by the watermark, is forgotten by a timer and seeds anew.
    """

    def __init__(self, keep: int = SEEN, expire_days: float | None = None) -> None:
        self.keep, self.expire_days = keep, expire_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "marker string")
        self.seeded = handle.getValueState("seeded", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a call of the state goes to the JVM and back, and a key has few rows: state that stays as it is isn't written, rows are taken as plain lists
        seeded, dated = self.seeded.exists(), self.expire_days is not None
        last = int(self.seeded.get()[0]) if seeded and dated else 0
        seen = [r[0] for r in self.seen.get()] if seeded else []
        known, done, newest = set(seen), set(), {}
        for batch in rows:
            at = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            last = max([last, *[t // 1000 for t in at]]) if dated else last
            new: dict[str, int] = {}
            for m, t in zip(batch["marker"].tolist(), at):
                if m not in known and t < new.get(m, t + 1):
                    new[m] = t
            for m, t in new.items():
                newest[m] = min(t, newest.get(m, t))
            newest = dict(sorted(newest.items(), key=lambda x: (x[1], x[0]))[-self.keep :])
            out = sorted(((t, m) for m, t in new.items() if m not in done)) if seeded else []
            if out:
                done.update(m for _, m in out)
                yield pd.DataFrame({"key": key[0], "marker": [m for _, m in out], "ts": np.array([t for t, _ in out], dtype="datetime64[us]")})
        kept = [*seen, *newest][-self.keep :]
        if kept != seen:
            self.seen.put([(m,) for m in kept])
        if dated or not seeded:
            self.seeded.update((last,))
        if dated:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + int(self.expire_days * 86_400_000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.seeded.clear()
        return iter(())

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_items(events: DataFrame, key: str, marker: str, keep: int = SEEN, expire_days: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """(key, marker, ts) of items not seen before at a followed key, by list and value state of bounded size. events: a stream with ``ts``; rows with a null key,
    marker or time are left out. The session's state store must be RocksDB (``STATE_STORE``, ``ROCKS``) when the stream starts. With ``expire_days`` rows later than ``delay`` are dropped."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(marker).cast("string").alias("marker"), "ts").dropna()
    rows = rows if expire_days is None else rows.withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(NewItems(keep, expire_days), "key string, marker string, ts timestamp", "Append", "None" if expire_days is None else "EventTime")


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators dropped because they came after the watermark, by query id. Add it to ``spark.streams`` before the query starts."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def once_across(events: DataFrame, marker: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each marker once, whatever subscriptions brought it, within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([marker])


def category_match(events: DataFrame, followed: DataFrame) -> DataFrame:
    """Events of followed categories: by id where both have one, else by name without case. Stream-static joins by equality on either."""
    f = followed.select(F.col("category_id").cast("string").alias("__id"), F.lower("category").alias("__name"))
    key = lambda tag, c: F.concat(F.lit(tag), c)
    known = f.filter("__id IS NOT NULL").select(key("i", F.col("__id")).alias("__f")).union(f.select(key("n", F.col("__name")))).union(f.filter("__id IS NULL").select(key("m", F.col("__name")))).filter("__f IS NOT NULL").distinct()
    ident, name = F.col("category_id").cast("string"), F.lower("category")
    keyed = events.withColumns({"__k": F.when(ident.isNotNull(), key("i", ident)).otherwise(key("n", name)), "__m": F.when(ident.isNotNull(), key("m", name))})
    by = lambda df, k, c: df.join(known.select(F.col("__f").alias(k), F.lit(True).alias(c)), k, "left")
    return by(by(keyed, "__k", "__a"), "__m", "__b").filter("__a OR __b").drop("__k", "__m", "__a", "__b")


def daily_counts(events: DataFrame, level: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows per day and level; batch and stream alike."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), level).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), level, "n")


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events of a key at most ``gap`` apart as one session."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sliding_sums(events: DataFrame, key: str, value: str, size: str = "24 hours", step: str = "1 hour", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Sums over windows of ``size`` every ``step``."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size, step), key).agg(F.round(F.sum(value), 4).alias("total"), F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "total", "n")


def upsert_batches(path: str, key: list[str], part: Column):
    """A foreachBatch function that appends the rows whose key the table at ``path`` doesn't have; a batch that comes again adds nothing.

    ``part`` is made of key columns, with few values in a batch, as the month of a date. The table is partitioned by it, as ``part``, and a batch reads its own parts only.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key).withColumn("part", F.coalesce(part.cast("string"), F.lit("none")))
        try:
            have = spark.read.schema(rows.schema).parquet(path)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows.write.mode("append").partitionBy("part").parquet(path)
            return
        parts = [r["part"] for r in rows.select("part").distinct().collect()]  # the batch's months
        known = have.filter(F.col("part").isin(parts)).select(*key).distinct()
        rows.join(known, key, "left_anti").select(*batch.columns, "part").write.mode("append").partitionBy("part").parquet(path)

    return put


def route(events: DataFrame, parsed: Column, ident: str, delay: str = "1 day") -> DataFrame:
    """A stream's rows with ``parsed`` (a time) and ``quality``: "uncertain" without one, kept apart, not dropped; else "dated", each id once within the watermark.
    Dated rows later than ``delay`` are dropped and counted row by row, as no aggregate comes before the state that drops them: see ``LateRows``."""
    rows = events.withColumn("parsed", parsed.cast("timestamp"))
    dated = rows.filter("parsed IS NOT NULL").withWatermark("parsed", delay).dropDuplicatesWithinWatermark([ident]).withColumn("quality", F.lit("dated"))
    return dated.unionByName(rows.filter("parsed IS NULL").withColumn("quality", F.lit("uncertain")))


def split_uncertain(batch: DataFrame, parsed: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a date, and the others apart, marked uncertain."""
    rows = batch.withColumn("__p", parsed)
    return rows.filter("__p IS NOT NULL").withColumnRenamed("__p", "parsed"), rows.filter("__p IS NULL").drop("__p").withColumn("quality", F.lit("uncertain"))

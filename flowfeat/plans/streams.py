"""Queries of the activity operators: streams over the events table run until it is read, batch forms where both give the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.plans._base import query
from flowfeat.sources.bindings import ev
from flowfeat.sources.shared import cut, shared_dir
from flowfeat.streaming import activity as A


PER_FILE = 250_000
PARTITIONS, CLOSING = "spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled"
PER_CORE, LEAST_STORES = 2, 16


def source(spark: SparkSession, d: str, parts: int = 4) -> DataFrame:
    """The events in order of time, as a folder of files that a stream reads window by window."""
    return replayed(spark, ev(spark, d), parts)


def replayed(spark: SparkSession, e: DataFrame, parts: int = 4, per_file: int = PER_FILE, late: str | None = None, closing_days: int = 0) -> DataFrame:
    """All rows of e as a stream: ``parts`` windows of equal length from the first to the last time, rows without a time in the first.

    Each window is one batch, whatever its size: a stream takes files in the order of their time of writing, and those that tasks write side by side have no order of
    their own. So all windows have the same number of files, about ``per_file`` rows each in the largest one, and a batch takes as many; a window with fewer rows than
    files is filled up with empty ones. Rows for which ``late`` holds come in a window of their own after all others. With ``closing_days`` a last file holds one row
    with a time so long after all others, and no other value: it moves the watermark past the last windows, whose rows come out then.
    """
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = e.agg(F.min(at), F.max(at)).first()
    width = ((high or 0) - (low or 0)) // parts + 1
    part = F.coalesce(F.floor((at - F.lit(low or 0)) / F.lit(width)), F.lit(0))
    part = part if late is None else F.when(F.expr(late), F.lit(parts)).otherwise(part)
    sizes = {r["part"]: r["n"] for r in e.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    files = -(-max(sizes.values(), default=1) // per_file)
    empty = spark.createDataFrame([], e.schema).coalesce(1)
    for k, window in enumerate(sorted(sizes), 1):
        rows = e.filter(part == window).withColumn("__file", (F.monotonically_increasing_id() % files).cast("int"))
        rows.repartitionById(files, F.col("__file")).drop("__file").write.mode("append").parquet(path)
        for _ in range(k * files - len(spark.read.schema(e.schema).parquet(path).inputFiles())):
            empty.write.mode("append").parquet(path)
    if not sizes:
        e.write.parquet(path)
    elif closing_days:
        end = F.timestamp_micros(F.lit(high + closing_days * 86_400_000_000)).cast(e.schema["ts"].dataType)
        spark.range(1).select(*[(end if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in e.schema]).write.mode("append").parquet(path)
    return A.read_events(spark, path, e.schema, files)


def run(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", closing: bool = True) -> DataFrame:
    """Runs a stream over what there is and returns its rows, written by batch to the shared folder.

    A state store is loaded, written and synchronised in every batch, however few its rows: so there are ``PER_CORE`` for each core, ``LEAST_STORES`` at
    least, and never more than shuffles have partitions. Without ``closing`` no batch without rows follows the last one: for streams whose rows all come out at once.
    """
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    work = f"{shared_dir(spark)}/{name}-state-{uuid.uuid4().hex}"
    stores = min(int(spark.conf.get(PARTITIONS)), max(LEAST_STORES, PER_CORE * spark.sparkContext.defaultParallelism))
    wanted = {A.STATE_STORE: A.ROCKS, PARTITIONS: str(stores), CLOSING: str(closing).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", work).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out)


@query("j1_new_items", """WITH b AS (SELECT user_id::VARCHAR AS key, event_type || ':' || day(ts) % 5 AS marker, ts, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) // 4 + 1) AS part FROM events),
  f AS (SELECT *, min(part) OVER (PARTITION BY key) AS seed, min(part) OVER (PARTITION BY key, marker) AS first FROM b)
  SELECT key, marker, min(ts)::TIMESTAMP AS ts FROM f WHERE part = first AND first > seed GROUP BY 1, 2""")
def j1(spark, d):
    s = source(spark, d).withColumn("marker", F.concat("event_type", F.lit(":"), (F.dayofmonth("ts") % 5).cast("string")))
    return run(spark, A.new_items(s, "user_id", "marker"), "new-items")


@query("j2_once_across", "SELECT DISTINCT user_id || ':' || event_type || ':' || epoch_us(ts) // 3600000000 AS marker FROM events")
def j2(spark, d):
    s = source(spark, d).withColumn("marker", F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor(F.unix_timestamp("ts") / 3600).cast("string")))
    return run(spark, A.once_across(s, "marker", delay="60 days"), "once", closing=False).select("marker")


@query("j5_category_match", "SELECT event_id FROM events WHERE CASE WHEN user_id % 3 = 0 THEN user_id % 5 IN (1, 2) OR lower(event_type) = 'error' ELSE lower(event_type) IN ('click', 'error') END")
def j5(spark, d):
    s = source(spark, d).withColumns({"category_id": F.when(F.col("user_id") % 3 == 0, F.col("user_id") % 5), "category": F.initcap("event_type")})
    followed = ev(spark, d).select((F.col("user_id") % 5).alias("category_id"), F.lit("Click").alias("category")).filter("category_id IN (1, 2)").distinct().union(ev(spark, d).filter("event_type = 'error'").select(F.lit(None).cast("long"), "event_type").distinct())
    return run(spark, A.category_match(s, followed).select("event_id"), "category")


@query("j6_incremental_upsert", "SELECT DISTINCT user_id AS target, CAST(ts AS DATE) AS date FROM events")
def j6(spark, d):
    path, work = f"{shared_dir(spark)}/series-{uuid.uuid4().hex}", f"{shared_dir(spark)}/series-state-{uuid.uuid4().hex}"
    s = source(spark, d).select(F.col("user_id").alias("target"), F.to_date("ts").alias("date"))
    s.writeStream.foreachBatch(A.upsert_batches(path, ["target", "date"], F.date_format("date", "yyyy-MM"))).option("checkpointLocation", work).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema.add("part", "string")).parquet(path).drop("part")


@query("j7_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def j7(spark, d):
    return run(spark, A.daily_counts(replayed(spark, ev(spark, d), closing_days=9), "event_type"), "daily")


@query("j8_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def j8(spark, d):
    return run(spark, A.sessions(replayed(spark, ev(spark, d), closing_days=9), "user_id", "6 hours"), "sessions")


@query("j9_sliding_sums", "WITH w AS (SELECT user_id, value, unnest(range(24)) AS k, date_trunc('hour', ts) AS h FROM events) SELECT user_id, (h - to_hours(k))::TIMESTAMP AS start, round(sum(value), 4) AS total, count(*) AS n FROM w GROUP BY 1, 2")
def j9(spark, d):
    return run(spark, A.sliding_sums(replayed(spark, ev(spark, d), closing_days=9), "user_id", "value"), "sliding")


LATE = "event_id % 97 = 5"
# A batch drops what is late by the watermark that the batch before it began with: the last, late batch goes by the first three of the four windows.


@query("j10_routing", f"""WITH e AS (SELECT *, event_id % 7 = 0 AS vague, {LATE} AS held FROM events), r AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e, r WHERE NOT held AND NOT vague AND (epoch_us(ts) - low) // ((high - low) // 4 + 1) < 3),
  q AS (SELECT CASE WHEN vague THEN 'uncertain' WHEN held AND ts <= mark THEN 'late' ELSE 'dated' END AS quality FROM e, w) SELECT quality, count(*) AS n FROM q GROUP BY 1""")
def j10(spark, d):
    s = replayed(spark, ev(spark, d), late=LATE).withColumn("raw", F.when(F.col("event_id") % 7 == 0, "hier").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    late = A.LateRows()
    spark.streams.addListener(late)
    try:
        got = cut(run(spark, A.route(s, F.try_to_timestamp("raw", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), "event_id").select("event_id", "quality"), "routed").groupBy("quality").agg(F.count("*").alias("n")), "routed")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(late)
    dropped = sum(late.dropped.values())
    return got.union(spark.range(1).select(F.lit("late"), F.lit(dropped).cast("long"))) if dropped else got


@query("a1_a2_records", "SELECT doc_id, md5(text) AS md5 FROM documents")
def a1(spark, d):
    from flowfeat.sources.bindings import table
    from flowfeat.sources.records import read_records, write_records

    docs = table(spark, d, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(docs, path)
    return read_records(spark, path, docs.schema).select("doc_id", F.md5("text").alias("md5"))


@query("a8_shards", "SELECT count(*) AS rows, true AS small_files FROM orders")
def a8(spark, d):
    from flowfeat.sources.bindings import table
    from flowfeat.sources.records import write_shards

    m = write_shards(table(spark, d, "orders"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", 1000)
    return m.agg(F.sum("rows").alias("rows"), (F.max("rows") <= 1000).alias("small_files"))

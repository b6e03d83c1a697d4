"""Streams: bounded seen lists, restarts, forgetting by timer, late rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from flowfeat.streaming import activity as A

SCHEMA = "user_id string, event_id string, ts timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(A.STATE_STORE)
    spark.conf.set(A.STATE_STORE, A.ROCKS)
    yield spark
    spark.conf.set(A.STATE_STORE, before)


def land(spark, folder, k, rows):
    """rows as the k-th file of a folder."""
    tmp = f"{folder}-{k}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    name = next(n for n in os.listdir(tmp) if n.endswith(".parquet"))
    os.rename(f"{tmp}/{name}", f"{folder}/batch{k}.parquet")
    os.utime(f"{folder}/batch{k}.parquet", (1000 + k, 1000 + k))


def drain(spark, stream, at):
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").collect()


def replay(batches, keep):
    """What each key emits, by a plain loop."""
    seen, out = {}, []
    for rows in batches:
        for key in {r[0] for r in rows}:
            mine = {}
            for _, m, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
                mine.setdefault(m, t)
            new = [m for m in mine if m not in seen.get(key, [])]
            if key in seen:
                out += [(key, m) for m in new]
            seen[key] = [*seen.get(key, []), *new][-keep:]
    return sorted(out)


def test_seen_lists_are_bounded_and_survive_a_restart(rocks, tmp_path):
    rng = random.Random(3)
    batches = [[(rng.choice("ab"), f"m{rng.randrange(14)}", dt.datetime(2024, 1, 1 + k, rng.randrange(24), rng.randrange(60))) for _ in range(12)] for k in range(5)]
    src, empty = f"{tmp_path}/src", rocks.createDataFrame([], SCHEMA).schema
    stream = lambda: A.new_items(A.read_events(rocks, src, empty), "user_id", "event_id", keep=4)
    for k in range(2):
        land(rocks, src, k, batches[k])
    drain(rocks, stream(), tmp_path)
    for k in range(2, 5):  # a new query takes the state up from the checkpoint
        land(rocks, src, k, batches[k])
    got = drain(rocks, stream(), tmp_path)
    want = replay(batches, 4)
    assert sorted((r["key"], r["marker"]) for r in got) == want and len(want) > 20
    assert want != replay(batches, 50)  # the bound matters here


def test_a_silent_key_is_forgotten_by_its_timer(rocks, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    batches = [[("a", "1", day(1)), ("b", "1", day(1))], [("a", "2", day(2))], [("b", "2", day(20))], [("b", "3", day(21))], [("a", "3", day(22))], [("a", "4", day(23)), (None, "5", day(23)), ("a", None, day(23))]]
    src = f"{tmp_path}/src"
    for k, rows in enumerate(batches):
        land(rocks, src, k, rows)
    got = drain(rocks, A.new_items(A.read_events(rocks, src, rocks.createDataFrame([], SCHEMA).schema), "user_id", "event_id", expire_days=5), tmp_path)
    # a is forgotten between the 2nd and the 22nd, so its item of the 22nd seeds anew
    assert {(r["key"], r["marker"]) for r in got} - {("b", "2")} == {("a", "2"), ("b", "3"), ("a", "4")}


def test_late_rows_are_counted_and_undated_ones_kept(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    src = f"{tmp_path}/src"
    for k, rows in enumerate([[("a", str(10 * k + i), day(1 + 4 * k)) for i in range(5)] for k in range(4)] + [[("a", "90", day(2)), ("a", "91", day(3)), ("a", "92", day(12)), ("a", "93", None)]]):
        land(spark, src, k, rows)
    late = A.LateRows()
    spark.streams.addListener(late)
    try:
        got = drain(spark, A.route(A.read_events(spark, src, spark.createDataFrame([], SCHEMA).schema), F.col("ts"), "event_id"), tmp_path)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(late)
    assert sorted(r["event_id"] for r in got if r["quality"] == "uncertain") == ["93"]
    assert {"90", "91"}.isdisjoint(r["event_id"] for r in got) and "92" in {r["event_id"] for r in got}
    assert sum(late.dropped.values()) == 2 and len(got) == 20 + 2


def test_a_window_is_one_batch_whatever_its_files(spark):
    """Windows of many files, with fewer rows than files, and of late rows: batches are windows, in order."""
    from flowfeat.plans.streams import replayed

    days = [i // 30 for i in range(90)] + [9, 9]
    e = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + n)) for i, n in enumerate(days)], "event_id long, ts timestamp_ntz")
    s, seen = replayed(spark, e, per_file=4, late="event_id % 30 = 7", closing_days=9), []

    def take(batch, _):
        seen.append(sorted(r["event_id"] if r["event_id"] is not None else -1 for r in batch.select("event_id").collect()))

    s.writeStream.foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
    assert seen == [[i for i in range(90) if i % 30 != 7], [90, 91], [7, 37, 67], [-1]]


def test_state_that_stays_is_not_written():
    import pandas as pd

    class Held:
        def __init__(self, rows):
            self.rows, self.calls = rows, 0

        def exists(self):
            return True

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.calls += 1

        update = put

    step = A.NewItems()
    step.seen, step.seeded = Held([("m1",), ("m2",)]), Held([(0,)])
    assert not list(step.handleInputRows(("u",), iter([pd.DataFrame({"marker": ["m2", "m1"], "ts": pd.to_datetime(["2024-01-02", "2024-01-01"])})]), None))
    assert step.seen.calls == step.seeded.calls == 0


def test_stores_go_by_cores_and_no_empty_batch_follows(spark):
    """64 shuffle partitions are not 64 stores to write in each batch, and what comes out at once needs no batch after the last."""
    from pathlib import Path

    from flowfeat.plans.streams import replayed, run
    from flowfeat.sources.shared import shared_dir

    e = spark.createDataFrame([(i % 30, dt.datetime(2024, 1, 1 + i % 20)) for i in range(90)], "marker long, ts timestamp_ntz")
    home, partitions = Path(shared_dir(spark).removeprefix("file://")), spark.conf.get("spark.sql.shuffle.partitions")
    old = set(home.glob("few-state-*"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = run(spark, A.once_across(replayed(spark, e), "marker", delay="60 days"), "few", closing=False)
        assert sorted(r["marker"] for r in got.collect()) == list(range(30)) and spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    (work,) = set(home.glob("few-state-*")) - old
    assert len([p for p in (work / "state/0").iterdir() if p.name.isdigit()]) == 16
    assert len([p for p in (work / "commits").iterdir() if p.name.isdigit()]) == 4

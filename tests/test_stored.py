"""Versioned upserts, batch sink, deep pages, bitmaps, percentiles and VARIANT payloads."""

import glob
import json
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislelens.operators import bitmaps, ingest, metrics, ranks
from aislelens.functions import columns as C
from aislelens.sources import batches, pages, versioned

T0 = datetime(2024, 1, 1, 10)
ROW = "k string, day string, value double"


@pytest.fixture
def table(spark, tmp_path):
    return versioned.VersionedTable(spark, f"file://{tmp_path}/t", ["k"], "day")


def rows(spark, *r):
    return spark.createDataFrame(r, ROW)


def told(df):
    return sorted(((r["k"], r["day"], r["value"]) for r in df.collect()), key=str)


# ------------------------------------------------------------ versions
def test_upsert_touches_only_its_partitions(spark, table):
    assert table.upsert(rows(spark, ("a", "1", 1.0), ("b", "2", 2.0), (None, None, 3.0)), "s", 0)
    before = table.manifest()["parts"]
    assert table.upsert(rows(spark, ("a", "1", 9.0), ("c", "1", 4.0)), "s", 1)
    after = table.manifest()["parts"]
    assert told(table.read()) == sorted([("a", "1", 9.0), ("b", "2", 2.0), ("c", "1", 4.0), (None, None, 3.0)], key=str)
    assert [p for p in before if before[p] != after[p]] == ["p31"] and len(after) == 3
    assert told(table.read(1)) == sorted([("a", "1", 1.0), ("b", "2", 2.0), (None, None, 3.0)], key=str)
    assert table.upsert(rows(spark, (None, None, 5.0), ("it's/odd %", "x/y=z %41", 6.0)), "s", 2) and len(told(table.read())) == 5
    assert table.upsert(rows(spark).where("false"), "s", 3) and len(told(table.read())) == 5


def test_last_loaded_wins(spark, table):
    new = spark.createDataFrame([("a", "1", 1.0, 5), ("a", "1", 2.0, 7), ("a", "1", 3.0, 6)], ROW + ", load_no long")
    table.upsert(new, "s", 0)
    assert told(table.read()) == [("a", "1", 2.0)]
    table.upsert(new.where("load_no = 6"), "s", 1)  # of two deliveries the later one counts
    assert told(table.read()) == [("a", "1", 3.0)]
    with pytest.raises(ValueError, match="other columns"):
        table.upsert(new.withColumn("more", F.lit(1)), "s", 2)


def test_a_replayed_batch_changes_nothing(spark, table):
    assert table.upsert(rows(spark, ("a", "1", 1.0)), "s", 4) and not table.upsert(rows(spark, ("a", "1", 9.0)), "s", 4) and not table.upsert(rows(spark, ("a", "1", 9.0)), "s", 3)
    assert table.upsert(rows(spark, ("a", "1", 2.0)), "other", 0)
    assert told(table.read()) == [("a", "1", 2.0)] and table.manifest()["epochs"] == {"s": 4, "other": 0}


def test_a_crash_before_the_manifest_leaves_the_version(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", "1", 1.0)), "s", 0)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="crash"):
        m.setattr(table, "_commit", lambda manifest: (_ for _ in ()).throw(RuntimeError("crash")))
        table.upsert(rows(spark, ("a", "1", 7.0)), "s", 1)
    assert told(table.read()) == [("a", "1", 1.0)] and table.manifest()["epochs"] == {"s": 0}
    folder = table.folder.removeprefix("file://")
    with open(f"{folder}/manifests/000000000002", "w") as f:
        f.write('{"version": 2, "parts"')  # a manifest that a crash left half written
    assert table.manifest()["version"] == 1 and told(table.read()) == [("a", "1", 1.0)]
    assert table.upsert(rows(spark, ("a", "1", 8.0)), "s", 1) and told(table.read()) == [("a", "1", 8.0)] and table.manifest()["version"] == 3
    assert table.vacuum() == 2 and told(table.read()) == [("a", "1", 8.0)] and len(glob.glob(f"{folder}/data/*/part_=*")) == 1


def test_two_writers(spark, table, monkeypatch):
    table.upsert(rows(spark, ("a", "1", 1.0)), "s", 0)
    late = versioned.VersionedTable(spark, table.folder, ["k"], "day")
    commit = late._commit

    def overtaken(manifest):
        table.upsert(rows(spark, ("b", "1", 2.0)), "other", 0)
        commit(manifest)

    monkeypatch.setattr(late, "_commit", overtaken)
    with pytest.raises(versioned.Conflict):
        late.upsert(rows(spark, ("c", "1", 3.0)), "s", 1)
    monkeypatch.setattr(late, "_commit", commit)
    assert late.upsert(rows(spark, ("c", "1", 3.0)), "s", 1)
    assert told(table.read()) == [("a", "1", 1.0), ("b", "1", 2.0), ("c", "1", 3.0)]


def test_stream_delivers_once(spark, table, tmp_path):
    src, schema = str(tmp_path / "in"), rows(spark).schema
    for k in range(3):
        rows(spark, ("a", "1", float(k)), (f"n{k}", str(k), 1.0)).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []

    def each(df, epoch):
        seen.append(epoch)
        table.each_batch("q")(df, epoch)
        table.each_batch("q")(df.withColumn("value", F.lit(-1.0)), epoch)  # delivered again

    stream().writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    assert seen == [0, 1, 2] and told(table.read()) == [("a", "1", 2.0), ("n0", "0", 1.0), ("n1", "1", 1.0), ("n2", "2", 1.0)]


def test_late_events_are_projected_again(spark, tmp_path):
    table = versioned.VersionedTable(spark, f"file://{tmp_path}/m", ["store_id", "metric_name", "bucket_start", "granularity"], "day")
    event = lambda h, store="s": (store, C.ENTERED, T0 + timedelta(hours=h), "browse", "visitor")
    frame = lambda r: spark.createDataFrame(r, "store_id string, event_type string, occurred_at timestamp_ntz, zone_type string, class_label string")
    series = lambda e: metrics.rollup(metrics.footfall(e), "footfall").withColumn("day", F.to_date("bucket_start"))
    first = [event(-30), event(-23.5), event(-1), event(-0.5), event(-1, "t")]
    assert versioned.refresh(table, frame(first), frame(first[:1]), series, "2024-01-01 10:00:00", "ingest", 0)
    values = lambda: {(r["store_id"], (r["bucket_start"] - T0).total_seconds() / 3600): r["value"] for r in table.read().collect()}
    assert values() == {("s", -24.0): 1.0, ("s", -1.0): 2.0}  # not the other store, nor what is older
    late = [*first, event(-0.9), event(0.5)]
    assert versioned.refresh(table, frame(late), frame(late[-1:]), series, "2024-01-01 11:00:00", "ingest", 1)
    assert values() == {("s", -24.0): 1.0, ("s", -1.0): 3.0, ("s", 0.0): 1.0}
    assert not versioned.refresh(table, frame(late[:1]), frame(late[:1]), series, "2024-01-01 11:00:00", "ingest", 1) and values()["s", -1.0] == 3.0


# ------------------------------------------------------------ batches
def sent(path):
    tallies = [json.loads(x) for f in glob.glob(f"{path}/tallies/*.json") for x in open(f)]
    files = {os.path.basename(f): json.load(open(f))["events"] for f in glob.glob(f"{path}/batches/*.json")}
    assert {t["batch"] for t in tallies} == set(files) and not glob.glob(f"{path}/_staging/*")
    return tallies, files


def test_batches_and_tallies(spark, tmp_path):
    batches.register(spark)
    df = spark.range(1234).select(F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 10 == 0, "rejected").when(F.col("id") % 10 == 1, "duplicate").otherwise("accepted").alias("status"), F.struct(F.lit(1).alias("a")).alias("inner")).repartition(3)
    df.write.format("event_batches").mode("append").option("batch_size", 100).save(str(tmp_path / "o"))
    tallies, files = sent(tmp_path / "o")
    assert max(t["events"] for t in tallies) == 100 and sum(t["events"] for t in tallies) == 1234 and [sum(t[k] for t in tallies) for k in ("accepted", "duplicate", "rejected")] == [986, 124, 124]
    assert sorted(int(e["event_id"]) for f in files.values() for e in f) == [i for i in range(1234) if i % 10 > 1] and all(e["inner"] == {"a": 1} for f in files.values() for e in f)
    df.limit(10).write.format("event_batches").mode("append").option("batch_size", 9999).save(str(tmp_path / "o"))
    assert sum(t["events"] for t in sent(tmp_path / "o")[0]) == 1244
    df.where("false").write.format("event_batches").mode("append").save(str(tmp_path / "none"))
    assert sent(tmp_path / "none") == ([], {})


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    batches.register(spark)
    bad = spark.range(100).repartition(2).select(F.when(F.col("id") == 77, F.raise_error(F.lit("bad row")).cast("string")).otherwise("x").alias("event_id"), F.lit("accepted").alias("status"))
    with pytest.raises(Exception, match="bad row"):
        bad.write.format("event_batches").mode("append").option("batch_size", 5).save(str(tmp_path / "o"))
    assert not glob.glob(f"{tmp_path}/o/batches/*") and not glob.glob(f"{tmp_path}/o/_staging/*")


def test_of_two_attempts_one_counts(tmp_path, monkeypatch):
    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    from pyspark.sql import Row

    writer = batches.BatchWriter(str(tmp_path / "o"), 2)
    data = [Row(event_id=str(k), status="accepted") for k in range(3)]
    messages = []
    for attempt in (1, 2):  # the first one is lost after it has written
        monkeypatch.setattr(batches.TaskContext, "get", classmethod(lambda cls, a=attempt: Task(a)))
        messages.append(writer.write(iter(data)))
    writer.commit([messages[1], None])
    tallies, files = sent(tmp_path / "o")
    assert sorted(e["event_id"] for f in files.values() for e in f) == ["0", "1", "2"] and sum(t["events"] for t in tallies) == 3


# ------------------------------------------------------------ pages
def test_deep_pages(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(int(i), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), int(rng.integers(0, 50))) for i in range(6000)]
    t = pages.PagedTable(spark, str(tmp_path / "p"), "s", [("v", True), ("i", False)])
    t.write(spark.createDataFrame(data, "i long, s string, v int"), 40)
    for group in "abc":
        want = sorted((r for r in data if r[1] == group), key=lambda r: (-r[2], r[0]))
        for offset, limit in ((0, 10), (37, 100), (len(want) - 5, 50), (len(want) + 10, 5), (100, 500), (0, 0), (-5, 3)):
            got = [tuple(r) for r in t.page(group, offset, limit).collect()]
            assert got == want[max(0, offset) : max(0, offset) + limit]
    assert len(t.page("a", 1000, 9999).collect()) == 500
    # A deep page reads a range or two of forty.
    assert 1 <= len(t.ranges_of("a", 4000, 20)) <= 2
    plan = t.page("a", 4000, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range_no" in plan.replace("PartitionFilters: [isnotnull(range_no", "PartitionFilters: [range_no")
    assert t.page("none", 0, 10).collect() == []


# ------------------------------------------------------------ bitmaps, percentiles, payloads
def test_bitmaps_add_up(spark):
    rng = np.random.default_rng(1)
    hour = lambda h: T0.replace(hour=0) + timedelta(hours=int(h))
    seen = [(str(rng.choice(["s", "t"])), hour(rng.integers(0, 72)), f"v{rng.integers(0, 300)}") for _ in range(3000)] + [("s", hour(1), None)]
    frame = lambda r: spark.createDataFrame(r, "store_id string, bucket_start timestamp_ntz, track string")
    first, later = frame(seen[:1500]), frame(seen[1500:])
    numbers = bitmaps.numbers_of(first)
    known = bitmaps.numbers_of(later, numbers)
    by = {(r["store_id"], r["track"]): r["visitor_no"] for r in known.collect()}
    for store in "st":
        mine = sorted(n for (s, _), n in by.items() if s == store)
        assert mine == list(range(1, len(mine) + 1))
    assert all(by[r["store_id"], r["track"]] == r["visitor_no"] for r in numbers.collect())
    stored = bitmaps.merged_bitmaps(bitmaps.hourly_bitmaps(first, numbers), bitmaps.hourly_bitmaps(later, known))
    for period, key in (("hour", lambda h: h), ("day", lambda h: h.replace(hour=0)), (None, lambda h: None)):
        want = {}
        for s, h, v in seen:
            if v:
                want.setdefault((s, key(h)), set()).add(v)
        assert {(r["store_id"], r["period_start"]): r["visitors"] for r in bitmaps.visitors_by(stored, period).collect()} == {k: len(v) for k, v in want.items()}


def test_bitmaps_of_many_blocks(spark):
    seen = spark.range(70_000).select(F.lit("s").alias("store_id"), F.lit(T0).cast("timestamp_ntz").alias("bucket_start"), F.col("id").cast("string").alias("track"))
    stored = bitmaps.hourly_bitmaps(seen, bitmaps.numbers_of(seen))
    assert stored.count() == 3 and bitmaps.visitors_by(stored).first()["visitors"] == 70_000


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(v)) for g, n in (("one", 1), ("few", 7), ("many", 3000), ("same", 500)) for v in (rng.normal(0, 9, n) if g != "same" else np.r_[np.full(n - 1, 2.5), 9])] + [("none", None), (None, 4.0), (None, 6.0), ("few", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in ranks.percentiles(df, ["g"], "v", shares).collect()}
    assert len(got) == 6 and all(got["none"][p] is None for p in shares)
    for g in ("one", "few", "many", "same", None):
        values = [v for k, v in data if k == g and v is not None]
        assert np.allclose([got[g][p] for p in shares], [np.percentile(values, 100 * s) for s in shares.values()])
    assert ranks.percentiles(df.where("false"), ["g"], "v", shares).count() == 0
    assert "percentile" not in metrics.value_stats(df, "g", "v")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_payload_is_parsed_once(spark):
    texts = ['{"a": {"b": 7}, "l": [1, {"x": 2}], "t": "9", "n": null, "f": 1.5}', '{"a": 3, "l": "no list"}', "not json", None, "[]", '{"l": []}', '{"t": "x"}']
    df = ingest.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string"))
    got = df.select("i", ingest.payload_field("$.a.b", "int").alias("b"), ingest.payload_items("$.l").alias("l"), ingest.payload_field("$.t", "int").alias("t"), ingest.payload_field("$.f", "double").alias("f"), ingest.payload_field("$.n", "string").alias("n")).orderBy("i")
    assert [tuple(r)[1:] for r in got.collect()] == [(7, 2, 9, 1.5, None), (None, 0, None, None, None), (None, 0, None, None, None), (None, 0, None, None, None), (None, 0, None, None, None), (None, 0, None, None, None), (None, 0, None, None, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parse_json") + got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1


# ------------------------------------------------------------ key filters
def test_key_filters_leave_partitions_out(spark, tmp_path):
    from aislelens.sources import keyindex, readers

    store = keyindex.EventStore(spark, f"file://{tmp_path}/e", "day")
    batch = lambda ids, **more: spark.createDataFrame([(k, more.get("id", "e{}").format(i) if i is not None else None, f"k{i}" if i is not None else None) for k, i in enumerate(ids)], "idx long, event_id string, idempotency_key string")
    first = batch(range(5))
    assert {r["outcome"] for r in store.outcomes(first).collect()} == {"created"}
    days = spark.range(12_000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.concat(F.lit("k"), "id").alias("idempotency_key"), F.floor(F.col("id") / 300).cast("string").alias("day"))
    store.append(days.where("cast(day as int) < 30"))
    store.append(days.where("cast(day as int) >= 30"))
    few = batch([7, 299, 11_999, 50_000, None, 60_000])
    parts = store.parts_of(few)
    assert {p for p, _ in parts} >= {"p0", "p39"} and len(parts) <= 5  # of forty
    for b in (few, batch([7, 7, 99_999]), batch([12], id="other{}"), batch(range(100_000, 100_400)), batch(range(0, 12_000, 500))):
        want = {r["idx"]: r["outcome"] for r in readers.split_new_events(b, days).collect()}
        assert {r["idx"]: r["outcome"] for r in store.outcomes(b).collect()} == want
    assert len(store.parts_of(batch(range(100_000, 100_400)))) <= 12  # false alarms are few
    plan = store.candidates(few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    # A load whose filters were not written may hold any key.
    days.limit(1).withColumn("part_", F.lit("x")).withColumn("load", F.lit("crashed")).write.mode("append").partitionBy("part_", "load").parquet(f"{tmp_path}/e/rows")
    assert ("x", "crashed") in store.parts_of(few)


def test_deletes(spark, table):
    table.upsert(rows(spark, ("a", "1", 1.0), ("b", "1", 2.0), (None, None, 3.0), ("c", "2", 4.0)), "s", 0)
    assert table.delete(rows(spark, ("a", "1", 0.0), (None, None, 0.0), ("c", "9", 0.0), ("zz", "1", 0.0)), "d", 0) and not table.delete(rows(spark, ("b", "1", 0.0)), "d", 0)
    assert told(table.read()) == [("b", "1", 2.0), ("c", "2", 4.0)] and set(table.manifest()["parts"]) == {"p31", "p32"}
    assert table.upsert(rows(spark, (None, None, 8.0)), "s", 1) and len(told(table.read())) == 3

"""Upserts that touch few files, and streams that are stopped and go on."""

import datetime as dt
import glob
import os
import random

import pytest
from larder import sources, streaming
from larder.operators import upserts
from pyspark.sql import functions as F


def files(path):
    return {f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, key = str(tmp_path / "t"), F.col("k")
    sources.write_buckets(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).alias("n")), path, key, 8)
    before = files(path)
    delta = spark.createDataFrame([(7, "a", 1), (7, "b", 2), (5000, "new", 1)], "k long, v string, n int")
    touched = sources.upsert_buckets(path, delta, key, 8, lambda current, more: sources.upsert_by_key(current, more, "k", "n"))
    after = files(path)
    bucket = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert 1 <= len(touched) <= 2
    assert {f for f in before if bucket(f) not in touched} == {f for f in after if bucket(f) not in touched}
    assert not {f for f in before if bucket(f) in touched} & after
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 1001 and got[7] == "b" and got[5000] == "new" and got[8] == "old"
    assert sources.upsert_buckets(path, delta.limit(0), key, 8, None) == []


def write_events(spark, folder, rows):
    """One file per call; the names order the files."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/../part-{len(glob.glob(f'{folder}/*.parquet'))}"
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double").coalesce(1).write.parquet(part)
    os.rename(glob.glob(f"{part}/*.parquet")[0], f"{folder}/{os.path.basename(part)}.parquet")


START = dt.datetime(2024, 1, 1)


def alias_events(spark, folder):
    stream = streaming.event_stream(spark, folder, "*.parquet", spark.createDataFrame([], "user_id long, event_id long, ts timestamp, value double").schema, files=1)
    return stream.select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("alias_text"), F.col("user_id").alias("ingredient_id"), F.lit(0.5).alias("confidence"), "ts", F.lit(1).cast("long").alias("n"))


def test_alias_upsert_goes_on_after_a_stop(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.randrange(9), rng.randrange(6), START + dt.timedelta(hours=k), 1.0) for _ in range(20)] for k in range(5)]
    base = spark.createDataFrame([("a1", 77, 0.9, 3, None), ("z", 1, 0.9, 3, None)], "alias_text string, ingredient_id long, confidence double, usage_count long, last_used timestamp")
    results = []
    for name, stops in (("stopped", True), ("whole", False)):
        folder, root = str(tmp_path / name / "in"), str(tmp_path / name / "table")
        for k, rows in enumerate(batches):
            write_events(spark, folder, rows)
            if stops or k == len(batches) - 1:  # each run starts with nothing but what is stored
                out = streaming.upsert_versions(alias_events(spark, folder), root, f"{root}-checkpoint", upserts.learn_aliases, base)
        results.append(sorted((r.alias_text, r.ingredient_id, r.usage_count) for r in out.collect()))
        assert len(streaming.versions(spark, root)) <= 2
    assert results[0] == results[1]
    total = sum(n for *_, n in results[0])
    assert total == 100 + 6


def test_a_batch_that_is_run_again_replaces_its_version(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "table")
    base = spark.createDataFrame([("a1", 77, 0.9, 3, None)], "alias_text string, ingredient_id long, confidence double, usage_count long, last_used timestamp")
    write_events(spark, folder, [(1, 1, START, 1.0)])
    streaming.upsert_versions(alias_events(spark, folder), root, str(tmp_path / "c1"), upserts.learn_aliases, base)
    # the first checkpoint is lost after the version was written: batch 0 comes again
    again = streaming.upsert_versions(alias_events(spark, folder), root, str(tmp_path / "c2"), upserts.learn_aliases, base)
    assert [(r.alias_text, r.usage_count) for r in again.collect()] == [("a1", 4)]
    # a version without its mark isn't one
    os.remove(f"{root}/{streaming.VERSION.format(1)}/_SUCCESS")
    assert streaming.versions(spark, root) == [0]


def test_counters_after_two_stops_equal_one_run(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(k, n, START, rng.random()) for n in range(rng.randrange(1, 30))] for k in range(4)]
    schema = spark.createDataFrame([], "user_id long, event_id long, ts timestamp, value double").schema
    totals = []
    for name, stops in (("stopped", {0, 2, 3}), ("whole", {3})):
        at = lambda x: str(tmp_path / name / x)  # noqa: B023, E731
        for k, rows in enumerate(batches):
            write_events(spark, at("in"), rows)
            if k in stops:
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at("in"))
                streaming.ingest_counted(stream, at("out"), at("progress"), at("checkpoint"), {"n": F.count(F.lit(1)), "total": F.sum("value")})
        seen = spark.read.parquet(at("progress")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("batches"), F.sum("total").alias("t")).first()
        assert seen.batches == 4 and spark.read.parquet(at("out")).count() == seen.n
        totals.append((seen.n, round(seen.t, 9)))
    assert totals[0] == totals[1] == (sum(map(len, batches)), round(sum(r[3] for b in batches for r in b), 9))


@pytest.mark.parametrize("limit", [2])
def test_rate_limit_forgets_idle_users(spark, tmp_path, limit):
    folder = str(tmp_path / "in")
    # user k comes in hour 10 k only; the window is one hour, the watermark's delay one minute
    batches = [[(k, 10 * k + n, START + dt.timedelta(hours=10 * k, minutes=n), 1.0) for n in range(4)] for k in range(6)]
    for rows in batches:
        write_events(spark, folder, rows)
    schema = spark.createDataFrame([], "user_id long, event_id long, ts timestamp, value double").schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with streaming.state_store(spark):
        stream = streaming.event_stream(spark, folder, "*.parquet", schema, "1 minute", files=1)
        out = streaming.rate_limit_stream(stream, limit, 3600)
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    got = {r.event_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {10 * k + n: n < limit for k in range(6) for n in range(4)}
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(rows) <= 2 * rows[0] and len(batches) * rows[0] > max(rows)

"""The first phase on a stream ends in the rows of the batch, whatever the order of its batches."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewire.operators import dedupe
from tidewire.streaming import dedupe as streaming

SCHEMA = """id string, canonical_url string, url string, title string, excerpt string, source_id string, source_name string, source_role string, source_weight int,
  published_at timestamp, category_hint string, is_official_source boolean, discovery_verified boolean"""


def items(seed, n=60):
    """Rows whose addresses and titles tie them into groups that only late rows join, with nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = f"https://h{rng.randrange(3)}.org/{rng.randrange(14)}"
        title = rng.choice([f"title {rng.randrange(9)}", f"Title {rng.randrange(9)}"])
        when = None if rng.random() < 0.1 else dt.datetime(2026, 7, 25, rng.randrange(20), rng.randrange(3))
        text = rng.choice([None, "", "  x ", "longer text"])
        rows.append((f"i{rng.randrange(99)}", url, url, title, text, f"s{rng.randrange(3)}", "S", rng.choice(["primary", "trusted_media", "discovery"]), rng.randrange(4), when, rng.choice([None, "a"]), rng.random() < 0.5, rng.choice([None, True, False])))
    return rows + rows[:5]


@pytest.fixture
def state_store(spark):
    for k, v in streaming.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in streaming.STATE_STORE:
        spark.conf.unset(k)


def changes(spark, batches, where, ttl=None):
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")
    read = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    d = streaming.exact_changes(read, F.lower("title"), ttl)
    w = d.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append")
    if ttl is None:
        w.trigger(availableNow=True).start().awaitTermination()
    else:  # a stream whose state expires goes on with empty batches, so it is stopped when all rows are in
        q, n = w.start(), sum(map(len, batches))
        until = time.monotonic() + 60
        while sum(x.numInputRows for x in q.recentProgress) < n and time.monotonic() < until:
            time.sleep(0.3)
        q.stop()
    return spark.read.schema(d.schema).parquet(f"{where}/out")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_order_of_batches_ends_in_the_batch_winners(spark, tmp_path, state_store, seed):
    rows = items(seed)
    want = dedupe.exact_winners(spark.createDataFrame(rows, SCHEMA), F.lower("title")).distinct()
    random.Random(seed).shuffle(rows)
    cut = [0, 1, 9, 30, len(rows)]
    found = changes(spark, [rows[a:b] for a, b in zip(cut, cut[1:])], str(tmp_path))
    got = streaming.settled_changes(found)
    assert found.where("change < 0").count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_the_order_as_numbers_and_texts_is_the_order_of_preference(spark):
    df = spark.createDataFrame(items(5, 200), SCHEMA).distinct()
    as_columns = [r.id + str(r) for r in df.orderBy(*dedupe.preference()).collect()]
    keyed = df.withColumn("k", dedupe.preference_key()).collect()
    as_keys = [r.id + str(r) for r in df.withColumn("k", dedupe.preference_key()).orderBy("k").drop("k").collect()]
    assert as_columns == as_keys and len(keyed) == len(as_columns)


def test_a_stream_that_is_resumed_and_forgets(spark, tmp_path, state_store):
    rows = items(4, 20)
    first = changes(spark, [rows[:8]], str(tmp_path), ttl=24)
    assert first.count() > 0
    both = changes(spark, [rows[8:]], str(tmp_path), ttl=24)
    want = dedupe.exact_winners(spark.createDataFrame(rows, SCHEMA), F.lower("title")).distinct()
    assert sorted(map(str, streaming.settled_changes(both).collect())) == sorted(map(str, want.collect()))


def test_titles_of_rows_without_times(spark, tmp_path):
    rows = [("i1", "https://h.org/1", "t", 3, None), ("i2", "https://h.org/2", "t", 5, None)]
    df = spark.createDataFrame(rows, "id string, canonical_url string, folded string, source_weight int, published_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    d = streaming.first_titles(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    d.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(d.schema).parquet(f"{tmp_path}/out").agg(F.max("source_weight")).first()[0] == 5


def test_no_fixed_number_of_files_holds_the_stream_of_winners(spark, sf, tmp_path, monkeypatch):
    from tidewire.plans import registry_sources

    spark.read.parquet(f"{sf}/documents.parquet").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def stop(spark, source, build, out, files=None):
        seen.append((len(source.df.inputFiles()), files))
        raise InterruptedError

    monkeypatch.setattr(registry_sources, "_streamed", stop)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        for d in (str(tmp_path), sf):
            with pytest.raises(InterruptedError):
                registry_sources.stream_winners(spark, d)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0][0] >= 9 and all(4 * files >= n > files for n, files in seen)


def test_titles_of_one_state_keep_their_own_weights(spark, tmp_path):
    at = dt.datetime(2026, 7, 25)
    batches = [
        [("i2", "https://h.org/1", "t", 3, at), ("i1", "https://h.org/2", "t", 3, at), ("i3", "https://h.org/3", None, 1, at), ("i4", "https://h.org/4", "v", None, at)],
        [("i5", "https://h.org/5", "t", 2, at), ("i6", "https://h.org/6", "u", 1, None), ("i7", "https://h.org/7", "v", 4, at), ("i8", "https://h.org/8", None, 2, at)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, canonical_url string, folded string, source_weight int, published_at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        w = streaming.first_titles(read, parts=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("id", "folded", "source_weight").collect()]
    assert sorted(got, key=str) == sorted([("i1", "t", 3), ("i3", None, 1), ("i4", "v", None), ("i6", "u", 1), ("i7", "v", 4), ("i8", None, 2)], key=str)

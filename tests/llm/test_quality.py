import numpy as np

from tidewire.llm import quality


def test_flat_trees_equal_walking(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = quality.Forest.fit(x, y, trees=30, depth=3)
    bins = f.bins(x)
    for i in range(0, 400, 37):
        total = f.base
        for feature, cut, value in zip(f.feature, f.cut, f.value, strict=True):
            at = 0
            while at < 7:
                at = 2 * at + 1 + int(bins[i, feature[at]] > cut[at])
            total += value[at - 7]
        assert abs(1 / (1 + np.exp(-total)) - f.score(x[i : i + 1])[0]) < 1e-9
    assert ((f.score(x) > 0.5) == y).mean() > 0.95


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op8_quality(spark, sf)
    assert got.count() == 10_000
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (3, ""), (4, "word " * 30000), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    x, y = quality.training_set(docs, none, "quality")
    f = quality.Forest.fit(x, y)
    assert {round(r.score, 6) for r in quality.score(docs, f).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    x, y = quality.training_set(docs, one, "quality")
    assert len(y) == 2
    assert quality.score(docs, quality.Forest.fit(x, y)).where("score < 0.9").count() == 0
    assert quality.score(docs.limit(0), f).count() == 0


def test_query_equals_walking_each_document(spark, sf):
    import zlib

    from pyspark.sql import functions as F

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in docs and r.quality is not None)
    narrow = lambda t: np.array(quality.statistics(t), "<f4").astype(float)
    f = quality.Forest.fit(np.array([narrow(docs[i]) for i, _ in known]), np.array([float(q) for _, q in known]))
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        x, total = narrow(text), f.base
        for feature, cut, value in zip(f.feature, f.cut, f.value, strict=True):
            at = 0
            while at < len(feature):
                j = feature[at]
                at = 2 * at + 1 + int((f.edges[j] <= x[j]).sum() > cut[at])
            total += value[at - len(feature)]
        want = 1 / (1 + np.exp(-total))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    clash = spark.read.parquet(f"{sf}/documents.parquet").select("*", F.lit(1).alias("y"), F.lit("q").alias("x"), F.lit(0.5).alias("score"), F.lit(9).alias("quality"))
    again = quality.score(clash, quality.Forest.fit(*quality.training_set(clash, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "quality")))
    assert {r.doc_id: round(r.score, 9) for r in again.collect()} == {i: round(r.score, 9) for i, r in got.items()}

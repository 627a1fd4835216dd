import numpy as np
import pytest

from tidewire.llm import embeddings


def brute(vectors, threshold=0.95):
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    n, label = {i: 0 for i in range(len(vectors))}, {i: i for i in range(len(vectors))}
    link = []
    for a in good:
        for b in good:
            if a != b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a] += 1
                    link.append((a, b))
    for _ in vectors:
        for a, b in link:
            label[a] = label[b] = min(label[a], label[b])
    return n, label


def test_links_and_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(40):
        base = rng.normal(size=16)
        vectors += [(base + rng.normal(size=16) * s).astype(np.float32).tolist() for s in rng.choice([0.0, 0.05, 0.12, 0.2], size=rng.integers(1, 9))]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1e-30] * 16, [2e-30] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, "l", 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, rep int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    n, label = brute(vectors)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert found >= 0.9 * sum(n.values()) and all(got[i].n_links <= n[i] for i in got)
    if found == sum(n.values()):
        assert {i: r.component for i, r in got.items()} == label
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_benchmark_table(spark):
    sf = "/root/testdata/sf0.1"
    got = embeddings.op7_embeddings(spark, sf).toPandas().set_index("vec_id").sort_index()
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().set_index("vec_id").sort_index()
    v = np.stack(pdf.embedding).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    n = ((v @ v.T) >= 0.95).sum(1) - 1
    assert got.n_links.sum() >= 0.9 * n.sum() and (got.n_links.values <= n).all()


def test_rare_lengths_and_equal_ids(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, [0.0, 1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3), (4, 0, 4)]


def test_work_for_each_vector_grows_slower_than_the_table(spark):
    from pyspark.sql import functions as F

    met = []
    for n in (20_000, 80_000):
        vector = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.randn(seed=3) * 0 + (F.pmod(F.xxhash64("rep", i), F.lit(20001)) - 10000) / 10000.0)
        classes = spark.range(n).select(F.col("id").alias("rep"), F.col("id").alias("cls"), F.lit(1).cast("long").alias("copies"), F.lit(16).alias("dim"))
        classes = classes.withColumn("vector", vector)
        where = embeddings.meetings(embeddings.describe(classes, embeddings.fit_pivots(classes)))
        filed = where.groupBy("list").agg(F.count_if("filed").alias("home"), F.count("*").alias("looks"))
        met.append(filed.agg(F.sum(F.col("home") * F.col("looks"))).first()[0] / n)
    assert met[1] < 2 * met[0]


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def partners(v, cosine, rng):
    side = rng.normal(size=v.shape)
    side = unit(side - (side * v).sum(1, keepdims=True) * v)
    return cosine * v + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("dim", [16, 64, 768])
@pytest.mark.parametrize("n", [200, 3_000, 300_000, 30_000_000, 3_000_000_000])
def test_recall_does_not_fall_with_the_table(n, dim, clustered):
    """Planted pairs under the plan of a table of n vectors: depths 1 to 5 are asked for."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(40, dim))
    sample = unit(rng.normal(size=(1024, dim)) if not clustered else centres[rng.integers(0, 40, 1024)] + 0.6 * rng.normal(size=(1024, dim)))
    pivots = embeddings._spread(sample, 256)
    depth, width, least = embeddings.plan_lists(n, pivots, sample)
    v = unit(rng.normal(size=(1500, dim)) if not clustered else centres[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, dim)))
    for cosine in (0.951, 0.97, 0.99):
        a, b = (np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : max(embeddings.PREFIX, width)] for x in (v, partners(v, cosine, rng)))
        one, two = (embeddings._lists(x, depth, width, dim) for x in (a, b))
        met = (one[:, :1] == two).any(1) | (two[:, :1] == one).any(1)
        common = (a[:, : embeddings.PREFIX, None] == b[:, None, : embeddings.PREFIX]).any(2).sum(1)
        assert (met & (common >= least)).mean() >= 0.92


def test_planted_pairs_of_a_table_of_two_depths(spark):
    rng = np.random.default_rng(11)
    v = unit(rng.normal(size=(1500, 32)))
    both = np.concatenate([v, partners(v, 0.955, rng)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component for r in embeddings.near_duplicates(df).collect()}
    assert sum(got[1500 + i] == i for i in range(1500)) >= 0.93 * 1500


def test_rows_that_travel_hold_little_beside_the_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i, 1, 16, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 16)))]
    classes = spark.createDataFrame(rows, "rep long, cls long, copies long, dim int, vector array<float>").cache()
    described = embeddings.describe(classes, embeddings.fit_pivots(classes))
    widths = [sum(len(x) * (8 if isinstance(x, list) else 1) for x in r if hasattr(x, "__len__")) for r in described.collect()]
    assert max(widths) <= 16 * 4 + 64
    every, full = (embeddings._looks(described, False, s) for s in (None, embeddings._full_slots(described)))
    assert every.where("filed").count() == full.where("filed").count() == 3000
    assert embeddings.meetings(described).join(full, ["cls", "list", "filed"]).count() == embeddings.meetings(described).count()

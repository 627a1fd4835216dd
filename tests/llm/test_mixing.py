import duckdb
import pytest

from tidewire.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Share by weight, cap, and share the excess again, until nothing is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50}, {"a": 1, "b": 1, "c": 1, "d": 900}, {"a": 0, "b": 5}, {"x": 7}])
def test_targets_match_rounds(spark, sizes):
    df = spark.createDataFrame([("0" + k, v) for k, v in sizes.items()], "tag string, source_size long")
    got = {r.tag[1:]: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_edges_and_sql(spark):
    rows = [(i, "w " * (i % 9), s) for i, s in enumerate(["é", "a", None, "a", "B", "a"] * 30)]
    rows += [(500, None, "a"), (501, "", None), (502, "x y", "a"), (502, "x y", "a")]
    df = spark.createDataFrame([(*r, "k", 1, "t") for r in rows], "doc_id long, text string, source string, key string, size int, tag string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toPandas()
    con.register("documents", documents)
    want = con.execute(mixing.OP3_SQL).fetchall()
    mine = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got]
    assert sorted(mine) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in want)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_buckets_are_even_whatever_the_weights(spark):
    digits = spark.range(20_000).selectExpr("id AS doc_id", "repeat('12 ', 3) AS text", "'a' AS source")
    prose = spark.range(20_000).selectExpr("id AS doc_id", "repeat('ab ', 3) AS text", "'a' AS source")
    for df in (digits, prose):
        most = mixing.sized(df).groupBy("bucket").count().agg({"count": "max"}).first()[0]
        assert most < 20


def test_rows_of_one_id_have_an_order(spark):
    rows = [(i % 2 or None, " ".join(["ab"] * (1 + i % 7)) + " " * (i % 3), "s") for i in range(60)] + [(5, "ab " * 200_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda d: sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(d).collect())
    assert key(df) == key(df.orderBy(df.text.desc()).repartition(5))

import random

from tidewire.llm import tokens


def test_pieces_equal_whole_texts(spark, sf):
    c = tokens.PieceCounter(tokens._model_path(), keep=50)
    assert c.cuts
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice('ab <s></s>  ▁\n\té中🙂.  1"́') for _ in range(rng.randint(0, 14)))
        assert c.count(t) == c.whole(t), t
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert c.count(r.text) == c.whole(r.text)


def test_cache_is_used_and_appended(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    rows = [(1, "one two"), (2, "one two"), (3, None), (4, ""), (4, ""), (None, "null id"), (6, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, "c", 9) for i, t in rows], "doc_id long, text string, content string, n_tokens int")
    first = tokens.count_tokens(df, cache).collect()
    whole = tokens.PieceCounter(tokens._model_path()).whole
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in first) == sorted((i or 0, len((t or "").encode()), whole(t or "")) for i, t in rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == 4
    more = df.select("doc_id", "text").unionByName(spark.createDataFrame([(7, "brand new")], "doc_id long, text string"))
    second = tokens.count_tokens(more, cache).collect()
    assert len(second) == len(rows) + 1
    assert spark.read.parquet(cache).count() == 5
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), cache).count() == 0
    assert spark.read.parquet(cache).count() == 5


def test_rows_of_one_content_are_encoded_once():
    import pyarrow as pa

    seen = []
    b = pa.RecordBatch.from_arrays([pa.array([b"a", b"a", b"b", b"b"]), pa.array(["x", "x", "yy", "yy"])], ["content", "text"])
    out = list(tokens.encoded(iter([b, b.slice(2)]), lambda t: seen.append(t) or len(t)))
    assert seen == ["x", "yy"] and [x for o in out for x in o.column(1).to_pylist()] == [1, 1, 2, 2, 2, 2]


def test_query_keeps_its_counts(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "cache_dir", lambda *_: str(tmp_path / "counts"))
    first = tokens.op5_tokens(spark, sf).collect()
    n = spark.read.parquet(str(tmp_path / "counts")).count()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert n == len(set(texts.values()))
    whole = tokens.PieceCounter(tokens._model_path()).whole
    assert all(r.n_tokens == whole(texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096) for r in first)
    again = tokens.op5_tokens(spark, sf).collect()
    assert sorted(again) == sorted(first) and spark.read.parquet(str(tmp_path / "counts")).count() == n  # nothing was encoded

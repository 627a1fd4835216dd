import random
import re

import corpus_pipeline
import duckdb

from tests.llm.test_decontaminate import brute as brute_overlap
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_nearcopies import brute_components
from tidewire.llm import decontaminate, langid, linededup, mixing, registry


def test_stages_keep_columns_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = left.count()
        left = stage(spark, left, sf).cache()
        assert left.columns == docs.columns and 0.5 * before < left.count() <= before
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.report(left, bench).where("contaminated").count() == 0
    mixed = corpus_pipeline.run(spark, sf)
    assert mixed.count() == left.count()


def test_registered():
    assert sorted(registry.QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate(["pii", "simhash", "mixing", "licenses", "tokens", "language", "embeddings", "quality", "decontaminate", "lines", "pages", "spelling", "conversations"], 1))


def fixture_rows():
    """Documents in two languages with junk, copied passages, copies, edited copies, benchmark passages and odd rows."""
    rng = random.Random(21)
    words = {"en": [f"{a}{b}" for a in ("the", "wor", "stre", "ing") for b in ("th", "er", "ly", "ness", "ow")], "de": [f"{a}{b}" for a in ("sch", "über", "ver", "ein") for b in ("ung", "heit", "pfen", "ßen", "ch")]}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))
    passage = [line("en", 20), "", line("en", 25)]
    items = [(1, line("de", 14)), (2, line("en", 30)), (3, "five words are too few"), (4, None)]
    docs = []
    for i in range(70):
        lang = "de" if i % 3 == 0 else "en"
        text = [line(lang, rng.randrange(4, 14)) for _ in range(rng.randrange(1, 9))]
        if i % 9 == 4:
            text[rng.randrange(len(text)) : 0] = passage
        if i % 13 == 7:
            text.append("so " + items[i % 2][1])
        docs.append([i, "\n".join(text), lang, f"s{i % 5}"])
    for k in range(10):
        w = docs[k * 5][1].split(" ")
        w[len(w) // 2] = f"edit{k}"
        docs.append([100 + k, docs[k * 5][1] if k % 2 else " ".join(w), docs[k * 5][2], None])
    docs += [[200, None, "en", "s1"], [201, "", None, "s2"], [202, "12 34 !!", "en", "s0"], [203, docs[3][1], "de", "s0"], [203, docs[3][1], "de", "s0"], [204, "½ ①", "de", None]]
    return docs, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items = fixture_rows()
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    coders = langid.Coders(langid.train_dictionaries(df.where(langid.fold(4) != 2)))
    left = [(i, t, s) for i, t, _, s in docs if not coders.predict(t, langid.MARGIN)[2]]
    assert 0 < len(docs) - len(left) < 20
    gone = {i: {int(x) for x in v.split(",") if x} for i, v in brute_lines([(i, t) for i, t, _ in left], linededup.MIN_WORDS).items()}
    cut = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), s) for i, t, s in left]
    kept = [(i, t, s) for i, t, s in cut if not gone[i] or re.search(r"[^\x20\x09-\x0D]", t)]
    assert any(gone.values()) and len(kept) < len(cut)
    label = brute_components([(i, t) for i, t, _ in kept])
    unique = [x for x in kept if label[x[0]] == x[0]]
    assert len(unique) < len(kept)
    hit = {r[0] for r in brute_overlap([(i, t) for i, t, _ in unique], items) if r[-1]}
    assert hit
    clean = [(i, t, s) for i, t, s in unique if i not in hit]
    documents = spark.createDataFrame(clean, "doc_id long, text string, source string").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(mixing.OP3_SQL).fetchall())
    assert got == want


def test_stages_on_empty_tables_and_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [f"'x' AS {c}" for c in ("row_key", "_gone", "fp", "component", "id", "_hit", "_items", "keys")]
    clash = docs.limit(40).selectExpr("*", *extra)
    for table in (docs.limit(0), clash):
        left = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, sf)
            assert left.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, left, sf).count() == left.count() <= table.count()

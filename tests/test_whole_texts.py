"""Queries read whole texts, not their beginnings."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewire.functions import text
from tidewire.operators import dedupe


def test_text_beyond_a_prefix_counts(spark, tmp_path):
    rows = [(1, "word " * 100 + "ＦＵＬＬ Width", "src1"), (2, "a" + " " * 400 + "Tail", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    folded = {r.doc_id: r.folded for r in entry.queries()["search_text_nfkc"](spark, str(tmp_path)).collect()}
    assert folded == {1: "word " * 100 + "full width\nsrc1", 2: "a" + " " * 400 + "tail\nsrc2"}
    titles = {r.doc_id: r.title for r in entry.queries()["analysis_normalize"](spark, str(tmp_path)).collect()}
    assert titles[2] == "a Tail"


def test_search_text_has_no_white_space_at_its_ends(spark, tmp_path):
    rows = [(1, None, "src1"), (2, "", "src2"), (3, "\t\r\n Über\n", None), (4, " \n\f", None), (5, None, None), (6, "\x0bends\x1f", None), (7, "\x85ΑΣ İ", "src3"), (8, "\nPlain", "S\t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.folded for r in entry.queries()["search_text_nfkc"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(con.execute(entry.oracle_sql()["search_text_nfkc"]).fetchall())
    assert got[1] == "src1" and got[4] == ""


def test_search_text_of_entries_is_stripped_in_any_script(spark):
    d = spark.createDataFrame([("\n\x1fA\t",), ("\x85Ä\u2003",)], "t string").select(text.search_text(F.col("t")).alias("t"))
    assert [r.t for r in d.collect()] == ["a", "ä"]


def test_long_titles_are_compared_whole(spark):
    rng = random.Random(7)
    letters = [chr(x) for x in range(0x4E00, 0x5600)]
    long = "".join(rng.choice(letters) for _ in range(600))
    titles = [long[:300], long[:256] + long[400:], long[:299] + "x", long]
    cols = "id string, url string, title string, excerpt string, source_id string, source_name string, source_role string, source_weight int, published_at timestamp, category_hint string, is_official_source boolean, discovery_verified boolean"
    df = spark.createDataFrame([(f"{i}", f"https://e.org/{i}", t, "", "s", "S", "primary", 5, None, None, True, True) for i, t in enumerate(titles)], cols)
    assert sorted(r.id for r in dedupe.fuzzy_winners(df).collect()) == ["0", "1", "3"]


def test_pairs_of_titles_of_any_length_in_small_blocks(spark, monkeypatch):
    rng = random.Random(3)
    letters = [chr(x) for x in range(0x4E00, 0x5600)]
    titles = []
    for n in (1, 6, 13, 60, 108, 110, 126, 127, 128, 129, 149, 220, 255, 256, 257, 511, 512, 600, 1100):
        base = [rng.choice(letters[:40] if n < 150 else letters) for _ in range(n)]
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randint(0, n // 16)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "b", "yz"])
            titles.append("".join(t))
    titles = [t for t in dict.fromkeys(titles) if t]
    monkeypatch.setattr(dedupe, "BLOCK_ROWS", 16)
    monkeypatch.setattr(dedupe, "LEAST_ROWS", 4)
    got = dedupe.similar_pairs(spark.createDataFrame(list(enumerate(titles)), "node long, value string")).collect()
    want = {(i, j) for j, y in enumerate(titles) for i, x in enumerate(titles[:j]) if dedupe.similar(x, y)}
    assert sorted((r.a, r.b) for r in got) == sorted(want) and len(want) > 30
    assert max(len(titles[j]) for _, j in want) > 1000

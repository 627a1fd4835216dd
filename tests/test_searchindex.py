import random

import pytest

from tidewire.plans import readmodels, searchindex

SCHEMA = "id string, title string, summary string, why_it_matters string, tags array<string>, display_category string, source string, published_at string, report_date string, gram string"


def made(spark, n):
    rng = random.Random(3)
    words = ["ＧＰＴ", "models", "大模型", "releases", "agent", "50%", "a_b", "naïve", "𝒳yz", "x"] + [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        text = lambda k: " ".join(rng.choice(words) for _ in range(k))
        day = f"2026-{rng.randrange(5, 8):02}-{rng.randrange(1, 29):02}"
        rows.append((f"e{i}", text(6), text(20) if i % 9 else None, "common phrase of all", [text(1)] if i % 5 else None, rng.choice(["Agent", "大模型"]), f"S{i % 4}", f"{day}T08:00:00Z", day, "clash"))
    rows += [("long", "needle " + "z" * 20_000, "", "", [], "Agent", "S1", "2026-07-20T08:00:00Z", "2026-07-20", "x"), ("bare", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    entries = made(spark, 600)
    path = f"{tmp_path_factory.mktemp('search')}/index"
    searchindex.write(entries, path, buckets=16)
    return entries, path


@pytest.mark.parametrize(
    ("query", "filters"),
    [
        ("gpt", {}), (" GPT MODELS ", {"recent_window": False}), ("大模型", {"recent_window": False}), ("w17", {"channel_": "agent"}), ("w17\nw", {"recent_window": False}), ("50% ", {}), ("a_b", {"source": "s2"}),
        ("no such text", {}), ("common phrase of all", {"start": "2026-06-01", "end": "2026-06-09"}), ("zzzz", {}), ("NAÏVE", {"recent_window": False}), ("𝒳yz", {"recent_window": False}), ("xy", {}), ("x", {}), ("", {}),
    ],
)
def test_equals_a_scan(spark, index, query, filters):
    entries, path = index
    want = [tuple(r) for r in readmodels.search(entries, query, **filters).collect()]
    got = searchindex.search(spark, path, query, **filters)
    assert got.columns == entries.columns
    assert [tuple(r) for r in got.collect()] == want


def test_reads_a_share(spark, index):
    entries, path = index
    whole = spark.read.parquet(f"{path}/postings")
    found = searchindex.postings(spark, path, "releases", 16)
    assert 0 < found.count() < whole.count() / 20
    assert len(found.inputFiles()) <= len(whole.inputFiles())
    plan = searchindex.search(spark, path, "w17 agent", recent_window=False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "dynamicpruning" in plan
    pruned = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in pruned and "PushedFilters: [In(gram" in pruned


def test_grams_and_empty_index(spark, tmp_path):
    d = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("a𝒳b大",)], "t string")
    assert [sorted(r[0] or []) for r in d.select(searchindex.grams(d.t)).collect()] == [["abc", "bca", "cab"], [], [], [], ["a𝒳b", "𝒳b大"]]
    searchindex.write(made(spark, 0).limit(0), f"{tmp_path}/none")
    assert searchindex.search(spark, f"{tmp_path}/none", "anything").count() == 0
    assert searchindex.search(spark, f"{tmp_path}/none", "").count() == 0

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewire import schema
from tidewire.plans import analysis, integrity, readmodels, sinks
from tidewire.streaming import dedupe as streaming

D = dt.date
OK = {
    "id": "0" * 16, "title": "A title", "category": "Agent", "editorial_lane": "产品与应用", "summary": "s" * 30, "importance": 7, "why_it_matters": "w" * 12,
    "tags": ["a"], "is_official": True, "marketing_risk": "low", "tracking_signal": "watch",
}


def test_salvage():
    rows = [{"id": "1"}]
    body = json.dumps(rows)
    for text in (body, f"```json\n{body}\n```", f"Here: {body} bye", json.dumps({"data": rows}), f"bad [ {{x {body}"):
        assert analysis.salvage(text) == rows
    assert analysis.salvage("nothing") is None and analysis.salvage('{"other": 1}') is None and analysis.salvage(None) is None


def test_response_errors_by_kind(spark):
    r = spark.createDataFrame([("nothing",), ('{"x": 1}',), ("[]",)], "text string")
    assert [x.error for x in analysis.response_rows(r).collect()] == ["json", "schema", None]


def response(spark, *rows):
    return analysis.normalize_drift(spark.createDataFrame([(i, json.dumps(OK | r)) for i, r in enumerate(rows)], "pos int, row string"))


def selected(spark, *ids):
    return spark.createDataFrame([(f"{i:016x}", f"s{i % 2}") for i in ids], "id string, source_id string")


def test_drift_and_strict_rows(spark):
    d = response(spark, {"title": " " + "t" * 99, "importance": " 8 ", "is_official": "TRUE", "tags": [" a ", "a", "b", "x" * 51, "c", "d"]}, {"importance": "many"}, {"tags": []}, {"marketing_risk": "odd"})
    rows = d.withColumn("ok", analysis.strict_row()).orderBy("pos").collect()
    assert (rows[0].title, rows[0].importance, rows[0].is_official, rows[0].tags) == ("t" * 80, 8, True, ["a", "b", "c"])
    assert [r.ok for r in rows] == [True, False, False, False]


def test_response_integrity_order(spark):
    two = selected(spark, 0, 1)
    err = lambda *rows: analysis.response_error(response(spark, *rows), two).first()[0]
    one = {"id": f"{1:016x}"}
    assert err({}, one) is None
    assert err({}, {}) == "duplicate"
    assert err({"id": "f" * 16}) == "unknown"
    assert err({}, {}, {"summary": "short"}) == "schema"


def test_quota_in_response_order(spark):
    sel = selected(spark, *range(20))
    d = response(spark, *[{"id": f"{i:016x}"} for i in (8, 6, 4, 2, 1, 3, 5)])
    got = [int(r.id, 16) for r in analysis.within_quota(d, sel).orderBy("pos").collect()]
    assert got == [8, 6, 1, 3]


def test_items(spark):
    cand = spark.createDataFrame(
        [(f"{i:016x}", f"https://e.org/{i}", "T", "S", f"s{i}", role, False, dt.datetime(2026, 7, 1), official) for i, role, official in ((0, "primary", True), (1, "discovery", False), (2, "trusted_media", False), (3, "primary", True))],
        "id string, canonical_url string, title string, source_name string, source_id string, source_role string, discovery_verified boolean, published_at timestamp, is_official_source boolean",
    )
    rows = [OK | {"id": f"{i:016x}", "marketing_risk": "high" if i < 2 else "low", "summary": "short" if i == 3 else OK["summary"]} for i in range(4)]
    an = spark.createDataFrame([tuple(r[f] for f in schema.ANALYSES.names) for r in rows], schema.ANALYSES)
    items = analysis.build_items(cand, an)
    assert {(r.source_id, r.is_official) for r in items.collect()} == {("s0", True), ("s2", False)}
    assert analysis.publishable(items).count() == 0
    assert {r.reason for r in analysis.publishable(items.limit(0)).collect()} == {"publication_threshold"}
    assert analysis.unknown_ids(an, cand.limit(2)).count() == 2
    assert analysis.has_secrets(items.withColumn("summary", F.lit("api_key=abcdefgh1"))).count() == 2
    body = spark.createDataFrame([('{"choices":[{"message":{"content":"hi"}}]}', '{"content":[{"type":"text","text":"ho"}]}', '{"content":[{"type":"x"},{"type":"text","text":"no"}]}')], "a string, b string, c string")
    got = body.select(analysis.response_text(F.col("a"), "chat"), analysis.response_text(F.col("b"), "blocks"), analysis.response_text(F.col("c"), "blocks")).first()
    assert tuple(got) == ("hi", "ho", None)


def dates(spark, *days):
    return spark.createDataFrame([(D(2026, 7, d),) for d in days], "date date")


def test_archive_fills_gaps(spark):
    records = spark.createDataFrame([(D(2026, 7, d), s) for d, s in ((2, "no_eligible_content"), (3, "failed_before_publish"), (4, "failed_before_publish"), (6, "published"), (7, "published"))], "date date, status string")
    got = {r.date.day: r.status for r in readmodels.archive(dates(spark, 1, 2, 4, 6), records).collect()}
    assert got == {1: "published", 2: "no_eligible_content", 3: "failed_before_publish", 4: "published", 5: "never_run", 6: "published", 7: "missing_report"}
    assert [(r.date.day, r.code) for r in readmodels.archive_violations(dates(spark, 1, 1), records.limit(0)).collect()] == [(1, "duplicate_report")]
    assert readmodels.archive(dates(spark).limit(0), records.limit(0)).count() == 0


def test_roll_up(spark):
    rows = []
    for d in range(1, 9):
        rows += [(D(2026, 7, d), "a", d != 8, d, 1, None), (D(2026, 7, d), "b", True, d, None, dt.datetime(2026, 7, d))]
    runs = spark.createDataFrame(rows, "date date, source_id string, success boolean, item_count int, recent_count int, latest_published_at timestamp")
    for c in readmodels.COUNTERS[1:]:
        runs = runs.withColumn(c, F.lit(None).cast("int"))
    specs = spark.createDataFrame([("a", "A", "primary", True), ("b", "B", "primary", True), ("c", "C", "discovery", True), ("d", "D", "primary", False)], "id string, name string, role string, enabled boolean")
    got = {r.source_id: r for r in readmodels.source_statuses(specs, runs).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].request_status, got["a"].recent_count, got["a"].new_count, got["a"].diagnostic_label) == ("failed", 7, None, None)
    assert (got["b"].request_status, got["b"].item_count, got["b"].diagnostic_label) == ("ok", 8, readmodels.NO_DIAGNOSTICS_LABEL)
    assert (got["c"].request_status, got["c"].diagnostic_label) == ("never_run", readmodels.NEVER_RUN_LABEL)


def entries(spark):
    row = lambda i, title, cat, src, day, tags=(): (i, title, "sum", "why", list(tags), cat, src, f"{day}T08:00:00Z", day)
    return spark.createDataFrame(
        [row("a", "GPT ＮＥＷＳ", "Agent", "S1", "2026-07-25"), row("b", "Other", "大模型", "S2", "2026-07-01", ["gpt"]), row("c", "Old gpt", "Agent", "S1", "2026-05-01")],
        "id string, title string, summary string, why_it_matters string, tags array<string>, display_category string, source string, published_at string, report_date string",
    )


@pytest.mark.parametrize(
    ("filters", "want"),
    [({}, ["a", "b"]), ({"recent_window": False}, ["a", "b", "c"]), ({"query": " gpt "}, ["a", "b"]), ({"query": "news"}, ["a"]), ({"channel_": "AGENT"}, ["a"]), ({"source": "s1", "start": "2026-01-01"}, ["a", "c"]), ({"end": "2026-06-01"}, ["c"]), ({"query": "none"}, [])],
)
def test_search(spark, filters, want):
    assert [r.id for r in readmodels.search(entries(spark), **filters).collect()] == want


def test_parse_index(spark):
    d = spark.createDataFrame([('[{"id":"a","page_url":"/x"}]',), ('{"id":"a"}',), ('[{"id":"a"}]',), ("[",)], "text string")
    assert [r.status for r in readmodels.parse_search_index(d).collect()] == ["success", "invalid-json", "invalid-json", "invalid-json"]


@pytest.mark.parametrize(("role", "age", "want"), [("primary", 90, "fresh"), ("primary", 91, "stale"), ("trusted_media", 7, "fresh"), ("trusted_media", 8, "stale"), ("discovery", 8, "stale")])
def test_health_thresholds(spark, role, age, want):
    specs = spark.createDataFrame([("a", " A\n x", role, True), ("b", "B", "discovery", True)], "id string, name string, role string, enabled boolean")
    items = spark.createDataFrame([("a", dt.datetime(2026, 7, 26) - dt.timedelta(days=age))], "source_id string, published_at timestamp")
    none = spark.createDataFrame([], "source_id string, error_type string")
    h = readmodels.source_health(specs, items, none, F.lit("2026-07-26").cast("date"))
    got = {r.source_id: r.status for r in h.collect()}
    assert got == {"a": want, "b": "empty"}
    assert readmodels.health_gate(h).first().ok == (role != "discovery")
    assert any(r.line.startswith(f"a A x {role} {want} 1 ") for r in readmodels.health_lines(h).collect())


def report(spark, *days):
    item = {k: None for k in schema.NEWS_ITEM.names}
    make = lambda d, i: tuple((item | OK | {"id": f"{i:016x}", "canonical_url": f"https://e.org/({i})", "source": "S<1>", "published_at": dt.datetime(2026, 7, d), "title": f"T*{i}", "importance": i})[k] for k in schema.NEWS_ITEM.names)
    return spark.createDataFrame([("1.3", D(2026, 7, d), dt.datetime(2026, 7, d), "m", False, 9, [make(d, i) for i in (1, 2, 3, 4, 5)], []) for d in days], schema.REPORTS)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "reports")
    sinks.upsert_by_date(report(spark, 1, 2), path)
    sinks.upsert_by_date(report(spark, 2, 3).withColumn("model", F.lit("new")), path)
    d = sinks.read_by_date(spark, path)
    assert {(r.date.day, r.model) for r in d.collect()} == {(1, "m"), (2, "new"), (3, "new")}
    assert sinks.read_by_date(spark, path, "2026-07-03").count() == 1
    items = readmodels.report_items(report(spark, 1, 2))
    text = {r.report_date.day: r.markdown for r in sinks.markdown(items).collect()}[1]
    assert text.index("5\\. T") if "5\\. T" in text else "T\\*5" in text
    assert text.count("T\\*5") == 2 and text.count("T\\*1") == 1 and "%281%29" in text
    feed = readmodels.rss_items(items, "https://d.example/")
    assert feed.count() == 5
    import xml.etree.ElementTree as ET

    for r in sinks.rss_elements(feed).collect():
        assert ET.fromstring(r.xml).find("link").text.startswith("https://d.example/days/2026-07-02/#item-")
    sinks.write_search_index(readmodels.search_index(items), str(tmp_path / "search"))
    assert spark.read.json(str(tmp_path / "search")).count() == 5
    pages = readmodels.channel_timelines(items, 2)
    assert sinks.sitemap_urls(report(spark, 1), pages, "https://d.example/").count() == 4 + 1 + 5
    records = spark.createDataFrame([(D(2026, 7, 1), dt.datetime(2026, 7, 1), "published", [], "none")], schema.RUN_RECORDS)
    assert schema.publication_violations(report(spark, 1), records).count() == 0
    assert {r.code for r in schema.publication_violations(report(spark, 2), records).collect()} == {"record_missing"}
    index = spark.createDataFrame([(D(2026, 7, 1), 5, "data/2026/07/2026-07-01.json"), (D(2026, 7, 2), 4, "x")], "date date, item_count int, path string")
    assert {r.code for r in schema.index_violations(index, report(spark, 1, 2)).collect()} == {"path", "item_count"}


def test_site_integrity(spark):
    pages = spark.createDataFrame(
        [("index.html", '<a href="a.html#top">x</a><a href="/site/b/">y</a><a href="/other/">z</a><img src="no.png"><a href="https://e.org">e</a><i id="q"></i><i id="q"></i><a href="#q">q</a>'), ("a.html", '<a href="#gone">x</a><a href="index.html?x=1">x</a>')],
        "path string, html string",
    )
    files = spark.createDataFrame([("index.html",), ("a.html",), ("b/index.html",)], "path string")
    need = spark.createDataFrame([("feed.xml",), ("index.html",)], "path string")
    got = {(r.path, r.code, r.message) for r in integrity.issues(pages, files, need, "/site/").collect()}
    assert got == {
        ("index.html", "missing_fragment", "a.html#top"), ("index.html", "outside_base", "/other/"), ("index.html", "missing_target", "no.png"),
        ("index.html", "duplicate_id", "q"), ("a.html", "missing_fragment", "#gone"), ("feed.xml", "missing_file", "feed.xml"),
    }


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"i{n}", f"https://h{n % 3}.org/{n % 7}", f"title {n % 5}", n % 4, dt.datetime(2026, 7, 25, n % 20)) for n in range(40)]
    df = spark.createDataFrame(rows, "id string, canonical_url string, folded string, source_weight int, published_at timestamp")
    src = str(tmp_path / "in")
    for part in range(4):
        df.where(F.substring("id", 2, 9).cast("int") % 4 == part).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def drain(stream, name, mode="append"):
        w = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
        w.start().awaitTermination()
        return spark.table(name)

    assert drain(streaming.admit(read()), "admitted").select("canonical_url").distinct().count() == drain(streaming.admit(read()), "again").count() == df.select("canonical_url").distinct().count()
    best = drain(streaming.first_titles(read()), "titles").groupBy("host", "folded").agg(F.max("source_weight").alias("w"))
    want = df.groupBy(F.regexp_extract("canonical_url", "//([^/]+)", 1).alias("host"), "folded").agg(F.max("source_weight").alias("w"))
    assert best.exceptAll(want).count() == 0 and want.exceptAll(best).count() == 0
    seen = spark.createDataFrame([("https://h0.org/0",)], "canonical_url string")
    assert drain(streaming.against_history(read(), seen), "fresh").where("canonical_url = 'https://h0.org/0'").count() == 0
    out = str(tmp_path / "funnel")
    read().withColumn("source_id", F.lit("s")).writeStream.foreachBatch(streaming.funnel_to(out)).option("checkpointLocation", str(tmp_path / "fc")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("new_count")).first()[0] == 40


def test_numbers_neighbors_and_small_sinks(spark, tmp_path):
    from tidewire.plans import readmodels, sinks
    from tidewire.streaming.dedupe import funnel_to

    got = spark.createDataFrame([(1,), (9,), (10,), (100,)], "position int").select(readmodels.two_digits(F.col("position"))).collect()
    assert [r[0] for r in got] == ["01", "09", "10", "100"]
    reports = spark.sql("SELECT date'2024-01-01' AS date UNION ALL SELECT date'2024-01-03'")
    assert readmodels.neighbors_of(reports, "2024-01-03")[0].isoformat() == "2024-01-01"
    with pytest.raises(ValueError):
        readmodels.neighbors_of(reports, "2024-01-02")
    assert "https://x.org/sitemap.xml" in sinks.robots("https://x.org/")
    info = sinks.build_info(reports, F.lit("2024-02-01 00:00:00").cast("timestamp"), "abc").first()
    assert info.reports == 2 and info.latest.isoformat() == "2024-01-03" and info.revision == "abc"
    batch = spark.createDataFrame([("a", "2024-01-01")] * 3, "source_id string, published_at string")
    write = funnel_to(str(tmp_path / "counts"))
    write(batch, 4), write(batch, 4), write(batch, 5)
    assert sorted((r.batch, r.new_count) for r in spark.read.parquet(str(tmp_path / "counts")).collect()) == [(4, 3), (5, 3)]

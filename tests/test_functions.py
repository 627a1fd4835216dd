import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewire.functions import rules, text, times, urls


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column).collect()]


GOOD = {
    "https://Example.com/post/?utm_source=x&ref=home&id=7#section": "https://example.com/post?id=7",
    "https://EXAMPLE.com/items/?b=two words&a=2&a=1&A=0&empty=": "https://example.com/items?A=0&a=1&a=2&b=two+words&empty=",
    "HTTPS://example.com": "https://example.com/",
    "https://example.com:443/a//": "https://example.com/a",
    "https://example.com:8443/a": "https://example.com:8443/a",
    "https://example.com./a/../b/./c": "https://example.com/b/c",
    "https://example.com/%7euser/%e4": "https://example.com/%7Euser/%E4",
    "https://example.com/é": "https://example.com/%C3%A9",
    "https://bücher.example/x": "https://xn--bcher-kva.example/x",
    "https://[2001:DB8::0:1]/x": "https://[2001:db8::1]/x",
    "https://example.com/?x": "https://example.com/?x=",
    "https://example.com/?UTM_Source=a&&b=*~": "https://example.com/?b=%2A~",
}
BAD = ["http://example.com/", "ftp://example.com", "", " https://example.com", "https://u:p@example.com/", "https:///x", "https://example.com/%zz", "https://exa mple.com/", "https://example.com/\x01", "nonsense", None]


def test_canonical_url(spark):
    got = one(spark, urls.canonical_url(F.col("x")), *GOOD, *BAD)
    assert got == [*GOOD.values(), *[None] * len(BAD)]


def test_native_and_python_forms_agree(spark):
    values = [f"https://H{i}.Example.com{p}{q}" for i in range(3) for p in ("", "/", "/a/b//", "/x.y,z") for q in ("", "?", "?b=1&a=2", "?ref=1", "?a", "?a=&a=b=c", "?q=a+b#f", "#f?x=1", "?&&x=1")]
    native = one(spark, urls.canonical_simple(F.col("x")), *values)
    assert [v for v, n in zip(values, native, strict=True) if n is None] == [v for v in values if "b=c" in v]
    assert one(spark, urls.canonical_url(F.col("x")), *values) == [urls.canonical(v) for v in values]
    assert all(n in (None, urls.canonical(v)) for v, n in zip(values, native, strict=True))


def test_id_and_hosts(spark):
    assert one(spark, urls.url_id(F.col("x")), "https://example.com/post?id=7") == ["8810464c45f302f7"]
    assert one(spark, urls.host(F.col("x")), "https://u@EXAMPLE.com:1/x") == ["example.com"]
    cases = [("www.a.com", "a.com", True), ("b.a.com", "A.com.", True), ("ba.com", "a.com", False), ("a.com", "www.a.com", True)]
    df = spark.createDataFrame(cases, "h string, d string, want boolean")
    assert df.where(urls.domain_matches(F.col("h"), F.col("d")) != F.col("want")).count() == 0
    assert urls.allowed_url("/x#f", "https://a.com/b", {"A.com"}) == "https://a.com/x"
    assert urls.allowed_url("http://a.com/x", "https://a.com", {"a.com"}) is None and urls.allowed_url("https://a.com:8/x", "https://a.com", {"a.com"}) is None
    assert one(spark, urls.releases_url(F.col("x")), "a b/c~d") == ["https://api.github.com/repos/a%20b/c~d/releases?per_page=10"]


@pytest.mark.parametrize(("hours", "score"), [(-5, 20), (0, 20), (6, 20), (6.01, 16), (12, 16), (12.01, 12), (24, 12), (24.01, 8), (36, 8), (36.01, 4), (72, 4), (72.01, 2), (96, 2), (96.01, 1), (120, 1), (120.01, 0)])
def test_recency(spark, hours, score):
    now = dt.datetime(2026, 7, 26, 12)
    at = F.lit((now - dt.timedelta(hours=hours)).isoformat()).cast("timestamp")
    assert spark.range(1).select(times.recency_score(at, F.lit(now.isoformat()).cast("timestamp"))).first()[0] == score


def test_feed_times(spark):
    got = one(
        spark, F.date_format(times.feed_timestamp(F.col("x")), "yyyy-MM-dd HH:mm:ss.SSS"),
        "Sat, 25 Jul 2026 10:00:00 GMT", "25 Jul 2026 10:00:00 +0800", "2026-07-25T18:30:00+08:00", "2026-07-25T18:30:00Z", "2026-07-25T18:30:00.250Z", "2026-07-25T18:30:00", "25 Jul 2026 10:00:00", "", "x", "2026-07-25 18:30:00 +0000",
    )
    assert got == ["2026-07-25 10:00:00.000", "2026-07-25 02:00:00.000", "2026-07-25 10:30:00.000", "2026-07-25 18:30:00.000", "2026-07-25 18:30:00.250", None, None, None, None, "2026-07-25 18:30:00.000"]
    assert one(spark, times.strict_timestamp(F.col("x")).isNotNull(), "2026-07-25T18:30:00Z", "2026-07-25 18:30:00Z", "Sat, 25 Jul 2026 10:00:00 GMT") == [True, False, False]


def test_cutoff(spark):
    got = spark.range(1).select(F.date_format(times.run_cutoff(F.lit("2026-07-25").cast("date")), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    assert got == "2026-07-25 15:59:59.999999"


def test_titles(spark):
    values = ["  A\t b　c ", "ＦＵＬＬ Ｗidth", "Straße", "İx", "   ", "ﬁne", "plain Title"]
    assert one(spark, text.normalize_title(F.col("x")), *values) == ["A b c", "FULL Width", "Straße", "İx", None, "fine", "plain Title"]
    assert one(spark, text.fold_title(F.col("x")), *values) == ["a b c", "full width", "strasse", "i̇x", None, "fine", "plain title"]


def test_markup():
    assert text.clean_text("<p>A &amp;amp; <b>b</b>\n c</p>") == "A & b c"
    assert text.clean_markup("&lt;script&gt;x()&lt;/script&gt;A &amp;amp;amp; b") == "A & b"
    assert text.clean_text(None) == "" and text.clean_text("abc", 2) == "ab"


EVENTS = {
    "acme launches nova-5 today": "launch|nova-5",
    "nova 5 and nova-5 released": "launch|nova-5",
    "meta launches 5 tools": "launch|launches-5",
    "gpt5 pricing": "price|gpt5",
    "orion update v1.2": "update|orion|update",
    "new model launch": None,
    "nothing happens here": None,
    "zeta beta alpha announced": "launch|zeta|beta",
    "正式发布 kimi-2": "launch|kimi-2",
}


def test_event_keys(spark):
    assert one(spark, rules.event_key(F.col("x")), *EVENTS) == list(EVENTS.values())


def rule(spark, title, excerpt="", source="s", role="primary", verified=False):
    df = spark.createDataFrame([(title, excerpt, source, role, verified)], "t string, e string, s string, r string, v boolean")
    row = df.select(*[c.alias(k) for k, c in rules.editorial_rules(F.col("t"), F.col("e"), F.col("s"), F.col("r"), F.col("v")).items()]).first()
    return [k for k, v in row.asDict().items() if v]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("Plain product news",), []),
        (("x", "", "s", "discovery", False), ["unverified_discovery"]),
        (("x", "", "s", "discovery", True), []),
        (("Sponsored: x",), ["sponsored"]),
        (("A new arXiv paper",), ["academic"]),
        (("A paper tool is now available",), []),
        (("How to build a template",), ["always_low_value"]),
        (("Leaderboard climbs",), ["benchmark"]),
        (("Benchmark shows lower latency",), []),
        (("Tool v1.2.3",), ["minor_version"]),
        (("Tool v1.2.3 fixes security",), []),
        (("New SDK",), ["developer"]),
        (("New SDK security access",), []),
        (("Changelog", "", "github-x"), ["code_release"]),
        (("Acme raises funding",), ["corporate"]),
        (("Acme raises funding for production",), []),
        (("发布release now",), []),
        (("某公司融资",), ["corporate"]),
    ],
)
def test_editorial(spark, args, want):
    assert rule(spark, *args) == want


def test_secrets(spark):
    got = one(spark, rules.redact(F.col("x")), "api_key: abcdefgh1 x", "see sk-abcdefghijklmnopq.", "nothing", "Authorization: Bearer abcdefgh12")
    assert got == ["[REDACTED] x", "see [REDACTED].", "nothing", "[REDACTED]"]


@pytest.mark.parametrize("name", ["event_key", "event_components"])
def test_event_queries_end_products_as_their_sql(spark, tmp_path, name):
    texts = {12: "gamma-4.2beta one", 312: "gamma-4.2 other two", 24: 'achen 78 token = "b64b244acde2e3b0a3add" and more'}
    docs = spark.createDataFrame([(i, t, "src1") for i, t in texts.items()], "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_few_texts_of_a_batch_are_python_objects_at_once():
    import tracemalloc

    import pyarrow as pa

    from tidewire.functions import text

    assert text.each(pa.array(["a", None, "b"] * 200), lambda v: v and v * 2).to_pylist() == ["aa", None, "bb"] * 200
    assert text.each(pa.array([], pa.string()), str).to_pylist() == []
    values = pa.array(["ü" * 5000 + str(i) for i in range(4000)])  # some 20 MB as Python texts, twice that with the results
    tracemalloc.start()
    assert len(text.each(values, lambda v: text.squeeze(v))) == 4000
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()

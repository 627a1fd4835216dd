import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire import schema
from tidewire.sources import feeds, pages, tables

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>
<item><title>New model</title><link>https://news.example.com/a</link><pubDate>Sat, 25 Jul 2026 10:00:00 GMT</pubDate><description><![CDATA[<p>A <b>model</b> update</p>]]></description></item>
<item><title>No link</title><pubDate>Sat, 25 Jul 2026 10:00:00 GMT</pubDate></item>
<item><title>Plain http</title><link>http://news.example.com/b</link><pubDate>Sat, 25 Jul 2026 10:00:00 GMT</pubDate></item>
<item><title>No zone</title><link>https://news.example.com/c</link><pubDate>2026-07-25T10:00:00</pubDate></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Reliable
 Agents &amp;amp; Research</title><link rel="alternate" href="https://pre.example.org/1"/><published>2026-07-25T18:30:00+08:00</published><summary>&lt;p&gt;About&lt;/p&gt;</summary></entry>
<entry><title>Late</title><link href="https://pre.example.org/2"/><published>Sat, 25 Jul 2026 10:00:00 GMT</published></entry></feed>"""
LEADS = """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><category term="LocalAI"/><id>t3_1</id><title>GPT tool from a lab</title><published>2026-07-25T10:00:00+00:00</published><content type="html">&lt;a href=&quot;https://lab.example.com/x?y=1#z&quot;&gt;[link]&lt;/a&gt; &lt;a href=&quot;https://www.reddit.com/r/LocalAI/1&quot;&gt;[comments]&lt;/a&gt;</content></entry>
<entry><category term="LocalAI"/><id>t3_2</id><title>LLM picture</title><published>2026-07-25T10:00:00+00:00</published><content type="html">&lt;a href=&quot;https://i.redd.it/x.png&quot;&gt;[link]&lt;/a&gt;</content></entry>
<entry><category term="LocalAI"/><id>t3_3</id><title>Help with my LLM</title><published>2026-07-25T10:00:00+00:00</published><content type="html">&lt;a href=&quot;https://lab.example.com/h&quot;&gt;[link]&lt;/a&gt;</content></entry>
<entry><category term="Other"/><id>t3_4</id><title>GPT elsewhere</title><published>2026-07-25T10:00:00+00:00</published><content type="html">&lt;a href=&quot;https://lab.example.com/o&quot;&gt;[link]&lt;/a&gt;</content></entry>
<entry><category term="LocalAI"/><id>t3_5</id><title>Gardening</title><published>2026-07-25T10:00:00+00:00</published><content type="html">&lt;a href=&quot;https://lab.example.com/g&quot;&gt;[link]&lt;/a&gt;</content></entry>
</feed>"""
RELEASES = """[{"name":"Big &lt;b&gt;one&lt;/b&gt;","tag_name":"v1","body":"<p>Notes</p>","draft":false,"prerelease":false,"published_at":"2026-07-25T10:00:00Z","html_url":"https://code.example.com/r/1"},
{"name":null,"tag_name":"v2","body":null,"draft":false,"prerelease":false,"published_at":"2026-07-25T10:00:00Z","html_url":"https://code.example.com/r/2"},
{"name":"draft","draft":true,"prerelease":false,"published_at":"2026-07-25T10:00:00Z","html_url":"https://code.example.com/r/3"},
{"name":"unknown","published_at":"2026-07-25T10:00:00Z","html_url":"https://code.example.com/r/4"}]"""


def spec(spark, *rows):
    return spark.createDataFrame([(i, i.title(), kind, url, None, adapter, com, "Agent", 5, False, role, True) for i, kind, url, adapter, com, role in rows], schema.SOURCE_SPECS)


def payload(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, payload string")


def test_rss_and_atom(spark):
    s = spec(spark, ("rss", "feed", "https://news.example.com", None, [], "primary"), ("pre", "arxiv", "https://pre.example.org", None, [], "primary"))
    got = feeds.parse_feeds(payload(spark, ("rss", RSS), ("pre", ATOM), ("rss", "not xml")), s).collect()
    assert sorted((r.title, r.excerpt) for r in got) == [("Late", ""), ("New model", "A model update"), ("Reliable Agents & Research", "About")]
    assert {r.published_at for r in got if r.title == "New model"} == {dt.datetime(2026, 7, 25, 10)}
    strict = feeds.parse_preprints(payload(spark, ("pre", ATOM)), s).collect()
    assert [(r.title, r.excerpt, r.published_at) for r in strict] == [("Reliable Agents & Research", "About", dt.datetime(2026, 7, 25, 10, 30))]


def test_releases(spark):
    s = spec(spark, ("code", "github", None, None, [], "primary"))
    got = feeds.parse_releases(payload(spark, ("code", RELEASES)), s).collect()
    assert sorted((r.title, r.excerpt) for r in got) == [("Big one", "Notes"), ("v2", "")]
    for bad in ('{"a": 1}', "oops"):
        with pytest.raises(Exception, match="JSON list"):
            feeds.parse_releases(payload(spark, ("code", bad)), s).collect()


def test_leads(spark):
    s = spec(spark, ("com", "reddit_rss", None, None, ["localai"], "discovery"), ("lab", "feed", "https://lab.example.com/f", None, [], "primary"))
    leads = feeds.parse_leads(payload(spark, ("com", LEADS)), s)
    assert [(r.community, r.post_id, r.external_url) for r in leads.collect()] == [("localai", "t3_1", "https://lab.example.com/x?y=1")]
    with pytest.raises(Exception, match="Atom"):
        feeds.parse_leads(payload(spark, ("com", RSS)), s).collect()
    domains = feeds.official_domains(s)
    chosen = feeds.choose_leads(leads, leads, domains)
    assert chosen.count() == 1
    article = '<html><head><script type="application/ld+json">{"@graph":[{"@type":["NewsArticle"],"headline":"GPT lab tool","description":"About the LLM tool","datePublished":"2026-07-24T10:00:00Z"}]}</script></head></html>'
    arts = pages.articles(spark.createDataFrame([("https://lab.example.com/x?y=1", article), ("https://lab.example.com/none", "<p>x</p>")], "url string, payload string"))
    got = feeds.verified_leads(chosen, arts, s, domains).collect()
    assert [(r.title, r.source_name, r.discovery_verified, r.is_official_source) for r in got] == [("GPT lab tool", "Reddit · r/localai", True, False)]


LONG = "A sentence that is long enough to stand as the excerpt of an entry without any detail page at all."
PAGES = {
    "anthropic_news": ("https://www.anthropic.com/news", f'<a href="/news/a"><h2>Card A</h2><time>Jul 24, 2026</time><p>x</p><p>{LONG}</p></a><a href="/news/b"><h2>No time</h2></a><a href="/other">o</a>', [("Card A", "https://www.anthropic.com/news/a", dt.datetime(2026, 7, 24, 7), LONG)]),
    "meta_ai_blog": ("https://ai.meta.com/blog/", f'<body><div><a href="/blog/m/">Learn more</a><a href="/blog/m/"><h3>Meta piece</h3></a><span>July 24, 2026</span><p>{LONG}</p><p>Featured</p></div></body>', [("Meta piece", "https://ai.meta.com/blog/m/", dt.datetime(2026, 7, 24, 7), LONG)]),
    "deepseek_news": ("https://www.deepseek.com/news", f'<a class="x ds-news-hero-card" href="/n/1"><h2>Hero</h2><p>July 24, 2026</p><p>{LONG}</p></a><a class="ds-news-hero-card" href="/n/2"><h2>Undated</h2></a>', [("Hero", "https://www.deepseek.com/n/1", dt.datetime(2026, 7, 23, 16), LONG)]),
    "zhipu_releases": ("https://docs.bigmodel.cn/x", '<Update label="2026-07-24" description="GLM 发布">\n- **Text** [doc](https://docs.bigmodel.cn/d) more\n</Update><Update label="2026-07-24" description="Other">[d](https://docs.bigmodel.cn/e)</Update>', [("GLM 发布", "https://docs.bigmodel.cn/d", dt.datetime(2026, 7, 23, 16), "Text doc more")]),
    "minimax_releases": ("https://platform.minimaxi.com/x", '## 2026 年 7 月\n<Card title="M1" href="/no">x</Card>\n## 2026 年 7 月 24 日\n<Card title="MiniMax M9" href="/m9">`New` [x](/y)</Card><Card title="Office" href="/z">x</Card>', [("MiniMax M9", "https://platform.minimaxi.com/m9", dt.datetime(2026, 7, 23, 16), "New x")]),
    "tencent_hunyuan": ("https://www.tencent.com/n", f'<article id="post-1"><h2 class="blog-title"><a href="/a">混元 news</a></h2><i class="tc-blogpost-date">2026年7月24日</i><p>{LONG}</p></article><article id="post-2"><h2 class="blog-title"><a href="/b">Games</a></h2><i class="tc-blogpost-date">2026年7月24日</i></article>', [("混元 news", "https://www.tencent.com/a", dt.datetime(2026, 7, 23, 16), LONG)]),
    "volcengine_doubao": ("https://www.volcengine.com/n", '<script>window._ROUTER_DATA = {"loaderData":{"__ssr_without_user/news/page":{"banner":{"title":"豆包 banner","link":"/b","date":"2026-07-24 08:00"},"listOnlineArticle":{"List":[{"DocumentID":7,"Title":"ARK row","Summary":"s","CreatedTime":"2026-07-24"},{"DocumentID":true,"Title":"Doubao bad"},{"DocumentID":8,"Title":"cars","CreatedTime":"2026-07-24"}]}}}};</script>', [("豆包 banner", "https://www.volcengine.com/b", dt.datetime(2026, 7, 24), ""), ("ARK row", "https://www.volcengine.com/news/detail/7", dt.datetime(2026, 7, 23, 16), "s")]),
    "baidu_ernie": ("https://cloud.baidu.com/n", '<script id="__NEXT_DATA__">{"props":{"pageProps":{"pageData":{"listData":{"result":[{"newsId":3,"title":"文心 row","time":"2026-07-24","abstract":"a"},{"newsId":4,"title":"Cloud","time":"2026-07-24"}]}}}}}</script>', [("文心 row", "https://cloud.baidu.com/news/news_3", dt.datetime(2026, 7, 23, 16), "a")]),
}


@pytest.mark.parametrize("adapter", PAGES)
def test_page_scanners(spark, adapter):
    base, markup, want = PAGES[adapter]
    bad = ("<html><body>Please verify you are human</body></html>", "<p>nothing</p>")
    found = pages.scan_pages(payload(spark, *[("s", x) for x in (markup, *bad)]), spec(spark, ("s", "official_page", base, adapter, [], "primary"))).orderBy("pos").collect()
    assert [(r.title, r.url, r.published_at, r.excerpt) for r in found if not r.error] == want
    assert [r.error for r in found if r.error] == ["PageStructureError"] * 2


def test_pages_to_items(spark):
    rows = [(a.replace("_", "-"), "official_page", PAGES[a][0], a, [], "primary") for a in PAGES]
    s = spec(spark, *rows)
    staged = payload(spark, *[(a.replace("_", "-"), PAGES[a][1]) for a in PAGES if a != "baidu_ernie"], ("baidu-ernie", "captcha"))
    entries = pages.scan_pages(staged, s).cache()
    assert {r.source_id: r.error for r in entries.where("error is not null").collect()} == {"baidu-ernie": "PageStructureError"}
    details = spark.createDataFrame([("https://docs.bigmodel.cn/d", f"<article><p>{LONG}</p></article>"), ("https://www.volcengine.com/b", "access denied")], "url string, payload string")
    got = {r.title: r.excerpt for r in pages.page_items(entries, details, s).collect()}
    assert got == {"Card A": LONG, "Meta piece": LONG, "Hero": LONG, "混元 news": LONG, "GLM 发布": LONG}


def test_article_text():
    assert pages.article_excerpt(f'<meta property="og:description" content="short"><main><p>x</p><p>{LONG}</p></main>') == LONG
    assert pages.article_excerpt('<meta name="description" content="short">') == "short"
    assert pages.article_excerpt(f"<h1>t</h1><div><p>{LONG}</p></div>") == LONG
    meta = '<meta property="og:title" content="T"><meta property="article:published_time" content="2026-07-24T10:00:00+02:00">'
    assert pages.article_metadata(meta)[:2] == ("T", dt.datetime(2026, 7, 24, 8, tzinfo=dt.UTC))
    assert pages.article_metadata(meta.replace("+02:00", "")) is None


def test_manifest_and_records(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("sources:\n- {id: a-b, name: A, kind: feed, url: 'https://a.example', category: Agent}\n- {id: c-d, name: C, kind: feed, url: 'https://c.example', category: Agent, official: false, weight: 3, enabled: false}\n")
    m = tables.read_manifest(spark, str(tmp_path / "m.yaml"))
    assert [(r.id, r.role, r.weight, r.enabled) for r in m.collect()] == [("a-b", "primary", 5, True), ("c-d", "trusted_media", 3, False)]
    assert schema.source_spec_violations(m).count() == 0
    folder = tmp_path / "runs/2026/07"
    folder.mkdir(parents=True)
    body = '{"date": "%s", "cutoff_at": "2026-07-24T15:59:59Z", "status": "published", "safe_error_code": "none", "source_runs": [{"source_id": "a-b", "source_name": "A", "success": true, "item_count": 2, "elapsed_ms": 5}]}'
    (folder / "2026-07-24.json").write_text(body % "2026-07-24")
    (folder / "2026-07-25.json").write_text(body % "2026-07-26")
    r = tables.read_run_records(spark, str(tmp_path / "runs"))
    assert {str(x.date): x.path_ok for x in r.collect()} == {"2026-07-24": True, "2026-07-26": False}
    runs = tables.exploded_runs(r)
    assert runs.where("recent_count is null and item_count = 2").count() == 2
    assert schema.run_record_violations(r).count() == 0 and schema.source_run_violations(runs).count() == 0
    bad = r.withColumn("status", F.lit("failed_before_publish"))
    assert {x.code for x in schema.run_record_violations(bad).collect()} == {"failed_code"}


def test_old_reports_get_a_lane(spark, tmp_path):
    item = '{"id": "0", "title": "t", "category": "论文研究"%s}'
    for version, day, extra in (("1.0", "2026-07-20", ""), ("1.1", "2026-07-21", ""), ("1.2", "2026-07-22", ', "editorial_lane": "平台与政策"')):
        (tmp_path / f"{day}.json").write_text(f'{{"schema_version": "{version}", "date": "{day}", "candidate_count": 1, "items": [{item % extra}], "source_runs": []}}')
    d = tables.read_reports(spark, str(tmp_path))
    lanes = {str(r.date): r.lane for r in d.select("date", F.expr("items[0].editorial_lane").alias("lane")).collect()}
    assert lanes == {"2026-07-20": "前沿研究", "2026-07-21": None, "2026-07-22": "平台与政策"}
    assert {r.code for r in schema.report_violations(d).collect()} == {"lane"}


def test_reports_against_their_index(spark):
    from tidewire.sources import tables

    reports = spark.sql("SELECT date'2024-01-01' AS date, array(1, 2) AS items UNION ALL SELECT date'2024-01-02', array(1) UNION ALL SELECT date'2024-01-05', array()")
    index = spark.sql("SELECT date'2024-01-01' AS date, 2 AS item_count UNION ALL SELECT date'2024-01-02', 3 UNION ALL SELECT date'2024-01-03', 1 UNION ALL SELECT date'2024-01-01', 2")
    assert [r.date.day for r in tables.indexed_reports(reports, index).collect()] == [2, 1]
    got = sorted((r.date.day, r.code) for r in tables.index_violations(reports, index).collect())
    assert got == [(1, "duplicate_entry"), (2, "item_count"), (3, "missing_report")]


WHEN = "<published>2026-07-25T10:00:00Z</published>"
FEEDS = {  # payload -> (title, url, excerpt) of its entries
    f"<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:entry><a:title>Pre &amp; <![CDATA[a <a:b> c]]></a:title><a:link href='https://x.example/1?p=1&amp;q=2'/>{WHEN.replace('<', '<a:').replace('<a:/', '</a:')}<a:summary type='html'>&lt;i&gt;One&lt;/i&gt;</a:summary></a:entry></a:feed>": [
        ("Pre & a c", "https://x.example/1?p=1&q=2", "One")
    ],
    f"\ufeff\n<?xml version='1.0' encoding='utf-8'?><rss><channel><item><title>Cut</title><link><![CDATA[https://x.example/2]]></link>{WHEN}<description><![CDATA[<p>in </item> and </description> here</p>]]></description></item></channel></rss>": [
        ("Cut", "https://x.example/2", "in and here")
    ],
    f"<feed><entry><title type='xhtml'><div>Rich <b>title</b></div></title><link rel='self' href='https://x.example/s'/><link rel='alternate' href='https://x.example/3'/>{WHEN}<content type='xhtml'><div xmlns='h'><p>Rich <i>text</i></p></div></content></entry></feed>": [
        ("Rich title", "https://x.example/3", "Rich text")
    ],
    f"<rdf:RDF xmlns:rdf='r'><channel><title>C</title></channel><item><title> </title><title>First</title><title>Second</title><link>https://x.example/4</link>{WHEN}</item><item><title>None</title><link/></item></rdf:RDF>": [
        ("First", "https://x.example/4", "")
    ],
    f"<rss><channel><item><title>Nb&nbsp;sp</title><link>https://x.example/5?a=1&amp;b=2</link>{WHEN}<description>&lt;b&gt;kept&lt;/b&gt;</description></item><item><title>open</channel>": [
        ("Nb sp", "https://x.example/5?a=1&b=2", "kept")
    ],
    f"<rss><channel><item><title>Use &amp;lt;div&amp;gt;</title><link>https://x.example/6</link>{WHEN}</item><!-- <item><title>x</title></item> --></channel></rss>": [
        ("Use <div>", "https://x.example/6", "")
    ],
    "<rss><channel><description><![CDATA[<item><title>x</title></item>]]></description></channel></rss>": [],
    "": [],
    "<": [],
}


def test_feeds_as_xml(spark):
    s = spec(spark, *[(f"f{i}", "feed", "https://x.example", None, [], "primary") for i in range(len(FEEDS) + 1)])
    rows = payload(spark, *[(f"f{i}", body) for i, body in enumerate(FEEDS)], (f"f{len(FEEDS)}", None))
    got = {}
    for r in feeds.parse_feeds(rows, s).collect():
        got.setdefault(r.source_id, []).append((r.title, r.url, r.excerpt))
    assert got == {f"f{i}": want for i, want in enumerate(FEEDS.values()) if want}
    assert feeds.parse_feeds(rows.limit(0), s).count() == 0


def test_leads_of_a_prefixed_feed(spark):
    s = spec(spark, ("com", "reddit_rss", None, None, ["localai"], "discovery"))
    import re

    prefixed = re.sub(r"<(/?)(?=[a-z])", r"<\1n:", LEADS).replace("xmlns=", "xmlns:n=")
    plain = [tuple(r) for r in feeds.parse_leads(payload(spark, ("com", LEADS)), s).collect()]
    assert plain and [tuple(r) for r in feeds.parse_leads(payload(spark, ("com", prefixed)), s).collect()] == plain
    broken = LEADS.replace("<entry>", "<entry><br>", 1)
    assert [tuple(r) for r in feeds.parse_leads(payload(spark, ("com", broken)), s).collect()] == plain


def test_cleaned_texts_that_are_filtered_are_cleaned_once(spark):
    from tidewire.plans.registry_sources import _spec

    payloads = spark.createDataFrame([], "source_id string, payload string")
    for parse in (feeds.parse_leads, feeds.parse_releases):
        plan = parse(payloads.union(spark.range(3).selectExpr("'x'", "repeat('y', id)")), _spec(spark, "x", "feed", None))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1, plan

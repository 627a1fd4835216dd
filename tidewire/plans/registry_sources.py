"""Registered queries of page and feed scanners, sinks, response checks and streams, with their SQL.

Payloads are made of every document, and what the scanners must find in them is
said in SQL from the document's number alone.
"""

import json
import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire import schema
from tidewire.functions import rules, text, urls
from tidewire.operators import funnel, ranking
from tidewire.plans import analysis, daily, readmodels, sinks, testbed
from tidewire.plans.materialize import Stored, cut, own_dir
from tidewire.plans.registry import _ITEMS_SQL, _PUB, _RUNS, SQL, day, fold, query, stamp
from tidewire.plans.snapshots import Snapshots
from tidewire.plans.testbed import CAND_SQL, HISTORY_SQL
from tidewire.sources import embedded, feeds, pages, tables
from tidewire.streaming import dedupe as streams


def _i() -> Column:
    return F.col("doc_id")


def _date() -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (_i() % 28).cast("int"))


_DATE = "(DATE '2024-01-01' + (doc_id % 28)::INT)"
#: A date of a page in UTC, by the zone that the page means.
_PACIFIC = f"strftime({_DATE} + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S')"
_CHINA = f"strftime({_DATE} - INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S')"


def _documents(spark, sf):
    return testbed.table(spark, sf, "documents")


def _spec(spark, name, kind, url, adapter=None, communities=(), role="primary"):
    row = (name, name, kind, url, None, adapter, list(communities), "大模型", 5, True, role, True)
    return spark.createDataFrame([row], schema.SOURCE_SPECS)


# --- page scanners ----------------------------------------------------------


def _found_sql(*entries: str) -> str:
    """Rows of pages: those of ``entries`` in order, or an error where every eleventh page is a challenge."""
    rows = " UNION ALL ".join(
        f"SELECT {n}::BIGINT AS pos, {e}, NULL AS error FROM documents WHERE doc_id % 11 <> 0" for n, e in enumerate(entries)
    )
    return f"{rows} UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'PageStructureError' FROM documents WHERE doc_id % 11 = 0"


def _scanned(spark, sf, adapter: str, base: str, markup: Column):
    page = F.when(_i() % 11 == 0, "<html><body>Please verify you are human</body></html>").otherwise(markup)
    staged = _documents(spark, sf).select(F.lit(adapter).alias("source_id"), page.alias("payload"))
    d = pages.scan_pages(staged, _spec(spark, adapter, "official_page", base, adapter))
    return d.select("pos", "title", "url", stamp("published_at").alias("published"), "excerpt", "error")


@query(_found_sql(f"'Card ' || doc_id AS title, 'https://www.anthropic.com/news/' || doc_id AS url, {_PACIFIC} AS published, 'About ' || doc_id AS excerpt"))
def link_card_scan(spark, sf):
    """Cards with heading and time; those without a time or on another host are left out."""
    card = '<a href="/news/%1$d"><h2>Card %1$d</h2><time>%2$s</time><p>x</p><p>About  %1$d</p></a><a href="/news/n%1$d"><h2>No time</h2></a>'
    away = '<a href="https://other.example.com/news/%1$d"><h2>Elsewhere</h2><time>%2$s</time></a>'
    return _scanned(spark, sf, "anthropic_news", "https://www.anthropic.com/news", F.format_string(card + away, _i(), F.date_format(_date(), "MMM d, yyyy")))


@query(_found_sql(f"'Piece ' || doc_id AS title, 'https://ai.meta.com/blog/' || doc_id || '/' AS url, {_PACIFIC} AS published, 'About piece ' || doc_id AS excerpt"))
def dated_link_scan(spark, sf):
    """Several links to an article below an element that shows its date."""
    page = '<body><div><a href="/blog/%1$d/">Learn more</a><a href="/blog/%1$d/"><h3>Piece %1$d</h3></a><span>%2$s</span><p>About piece %1$d</p><p>Featured</p></div><a href="/blog/">all</a></body>'
    return _scanned(spark, sf, "meta_ai_blog", "https://ai.meta.com/blog/", F.format_string(page, _i(), F.date_format(_date(), "MMMM d, yyyy")))


@query(_found_sql(f"'Hero ' || doc_id AS title, 'https://www.deepseek.com/n/' || doc_id AS url, {_CHINA} AS published, 'About ' || doc_id AS excerpt"))
def hero_card_scan(spark, sf):
    card = '<a class="x ds-news-hero-card" href="/n/%1$d#top"><h2>Hero %1$d</h2><p>%2$s</p><p>About %1$d</p></a><a class="ds-news-hero-card" href="/n/u%1$d"><h2>Undated</h2></a>'
    return _scanned(spark, sf, "deepseek_news", "https://www.deepseek.com/news", F.format_string(card, _i(), F.date_format(_date(), "MMMM d, yyyy")))


@query(_found_sql(f"'GLM ' || doc_id AS title, 'https://docs.bigmodel.cn/d/' || doc_id AS url, {_CHINA} AS published, 'Text doc more' AS excerpt"))
def update_block_scan(spark, sf):
    block = '<Update label="%2$s" description="GLM %1$d">\n- **Text** [doc](https://docs.bigmodel.cn/d/%1$d) more\n</Update><Update label="%2$s" description="Other">[d](https://docs.bigmodel.cn/e)</Update>'
    return _scanned(spark, sf, "zhipu_releases", "https://docs.bigmodel.cn/x", F.format_string(block, _i(), day(_date())))


@query(_found_sql(f"'MiniMax ' || doc_id AS title, 'https://platform.minimaxi.com/m/' || doc_id AS url, {_CHINA} AS published, 'New x' AS excerpt"))
def card_section_scan(spark, sf):
    """Cards under full dates; a heading without a day dates nothing."""
    page = '## 2024 年 1 月\n<Card title="M1" href="/no">x</Card>\n## 2024 年 1 月 %2$s 日\n<Card title="MiniMax %1$d" href="/m/%1$d">`New` [x](/y)</Card><Card title="Office" href="/z">x</Card>'
    return _scanned(spark, sf, "minimax_releases", "https://platform.minimaxi.com/x", F.format_string(page, _i(), F.date_format(_date(), "d")))


@query(_found_sql(f"'混元 ' || doc_id AS title, 'https://www.tencent.com/a/' || doc_id AS url, {_CHINA} AS published, 'About ' || doc_id AS excerpt"))
def post_scan(spark, sf):
    """Posts that name the brand."""
    post = '<article id="post-%1$d"><h2 class="blog-title"><a href="/a/%1$d">%3$s %1$d</a></h2><i class="tc-blogpost-date">2024年1月%2$s日</i><p>About %1$d</p></article>'
    number = F.date_format(_date(), "d")
    return _scanned(spark, sf, "tencent_hunyuan", "https://www.tencent.com/n", F.concat(F.format_string(post, _i(), number, F.lit("混元")), F.format_string(post, _i(), number, F.lit("Games"))))


def _filled(template: str):
    """A page template with the document's number for {n} and its date for {d}, for Spark and for SQL."""
    return F.replace(F.replace(F.lit(template), F.lit("{n}"), _i().cast("string")), F.lit("{d}"), day(_date()))


def _templates_sql(templates: list[str]) -> str:
    cases = " ".join(f"WHEN {k} THEN '" + t.replace("'", "''") + "'" for k, t in enumerate(templates))
    return f"replace(replace(CASE doc_id % {len(templates)} {cases} END, '{{n}}', doc_id::VARCHAR), '{{d}}', {_DATE}::VARCHAR)"


def _templates(templates: list[str]) -> Column:
    page = _filled(templates[-1])
    for k in range(len(templates) - 2, -1, -1):
        page = F.when(_i() % len(templates) == k, _filled(templates[k])).otherwise(page)
    return page


def _router(banner: str, rows: str) -> str:
    return '<script>window._ROUTER_DATA = {"loaderData":{"__ssr_without_user/news/page":{"banner":' + banner + ',"listOnlineArticle":{"List":' + rows + "}}}};</script>"


_ROUTER_PAGES = [
    _router('{"title":"豆包 {n}","link":"/b/{n}#top","date":"{d} 08:00"}', '[{"DocumentID":{n},"Title":"ARK {n}","Summary":"About <b>{n}</b> &amp; more","CreatedTime":"{d}"},{"DocumentID":true,"Title":"Doubao bad"},{"DocumentID":8,"Title":"cars","CreatedTime":"{d}"}]'),
    _router("null", '[{"DocumentID":" {n} ","title":"Doubao {n}","description":"low","date":"{d}T10:00:00+02:00"},"text",7,{"DocumentID":{n},"Title":"ARK again","CreatedTime":"{d}"}]'),
    _router('"text"', '[{"Title":7,"title":"ARK unseen","DocumentID":1,"CreatedTime":"{d}"},{"Title":"ARK {n}","Summary":["x"],"Link":"https://other.example/x","CreatedTime":"{d}"},{"Title":"ARK {n}","Link":"https://WWW.volcengine.com/p/{n}?q=1","UpdatedTime":"{d}"}]'),
    _router("{}", '{"Title":"no list"}'),
    _router("{}", '[{"Title":"broken {n}",]'),
    "<html>Please verify you are human</html>",
]
#: The first of two spellings that holds something counts, whatever its type; only strings are texts.
_ROUTER_SQL = rf"""
WITH p AS (SELECT doc_id, {_templates_sql(_ROUTER_PAGES)} AS page FROM documents),
j AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(page, 'window\._ROUTER_DATA\s*=\s*(\{{.*\}})\s*;?\s*</script>', 1), '') AS JSON) -> '$.loaderData."__ssr_without_user/news/page"' AS s FROM p),
ok AS (SELECT doc_id, s FROM j WHERE json_type(s -> '$.listOnlineArticle.List') = 'ARRAY'),
r AS (SELECT doc_id, 0 AS nr, s -> '$.banner' AS e FROM ok
  UNION ALL SELECT doc_id, i, s -> ('$.listOnlineArticle.List[' || (i - 1) || ']') FROM (SELECT doc_id, s, unnest(range(1, 1 + json_array_length(s -> '$.listOnlineArticle.List')::BIGINT)) AS i FROM ok)),
f AS (SELECT doc_id, nr, CASE WHEN coalesce(e ->> '$.Title', '') <> '' THEN CASE WHEN json_type(e -> '$.Title') = 'VARCHAR' THEN e ->> '$.Title' END ELSE e ->> '$.title' END AS title,
    CASE WHEN json_type(e -> '$.DocumentID') IN ('VARCHAR', 'UBIGINT', 'BIGINT') THEN trim(e ->> '$.DocumentID') END AS number, coalesce(e ->> '$.link', e ->> '$.Link') AS link,
    coalesce(e ->> '$.CreatedTime', e ->> '$.date', e ->> '$.UpdatedTime') AS at_time,
    CASE WHEN json_type(e -> '$.Summary') = 'VARCHAR' THEN e ->> '$.Summary' WHEN json_type(e -> '$.Summary') IS NULL THEN e ->> '$.description' END AS about
  FROM r WHERE json_type(e) = 'OBJECT'),
u AS (SELECT doc_id, nr, title, CASE WHEN number IS NOT NULL THEN 'https://www.volcengine.com/news/detail/' || number WHEN link LIKE '/%' THEN 'https://www.volcengine.com' || split_part(link, '#', 1)
      WHEN lower(link) LIKE 'https://www.volcengine.com/%' THEN 'https://www.volcengine.com' || substr(link, 27) END AS url,
    CASE WHEN at_time LIKE '%+02:00' THEN at_time[:19]::TIMESTAMP - INTERVAL 2 HOURS ELSE at_time::TIMESTAMP - INTERVAL 8 HOURS END AS t,
    trim(replace(regexp_replace(coalesce(about, ''), '<[^>]*>', '', 'g'), '&amp;', '&')) AS excerpt
  FROM f WHERE regexp_matches(title, '豆包|大模型|Doubao|ARK')),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY nr) AS n FROM u WHERE url IS NOT NULL AND t IS NOT NULL)
SELECT row_number() OVER (PARTITION BY doc_id ORDER BY nr) - 1 AS pos, title, url, strftime(t, '%Y-%m-%d %H:%M:%S') AS published, excerpt, NULL AS error FROM g WHERE n = 1
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'PageStructureError' FROM j WHERE doc_id NOT IN (SELECT doc_id FROM ok)"""


def _embedded(spark, sf, scan, adapter: str, base: str, templates: list[str]):
    staged = _documents(spark, sf).select(F.lit(adapter).alias("source_id"), _templates(templates).alias("payload"), F.lit(base).alias("base"))
    found = scan(staged, pages.ADAPTERS[adapter][1])
    return found.select(F.col("pos").cast("long").alias("pos"), "title", "url", stamp("published_at").alias("published"), "excerpt", "error")


@query(_ROUTER_SQL)
def router_json_scan(spark, sf):
    """Banner and list of the router state in pages of six shapes: fields of other types and spellings, repeated addresses, foreign hosts, no list, broken JSON, a challenge."""
    return _embedded(spark, sf, embedded.router_pages, "volcengine_doubao", "https://www.volcengine.com/n", _ROUTER_PAGES)


def _listing(rows: str) -> str:
    return '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"pageData":{"listData":{"result":' + rows + "}}}}}</script>"


_LISTING_PAGES = [
    _listing('[{"newsId":{n},"title":"文心 {n}","time":"{d}","abstract":"About {n}"},{"newsId":4,"title":"Cloud","time":"{d}"}]'),
    _listing('[{"newsId":"{n}","title":"News {n}","time":"{d} 12:30:00","abstract":"","content":"on ERNIE"},{"newsId":{n},"title":"文心 twice","time":"{d}"},null,{"newsId":false,"title":"文心","time":"{d}"}]'),
    _listing('[{"newsId":5,"title":"Plain","keywords":"千帆","time":"{d}","contentEtl":7,"content":"unseen"},{"newsId":6,"title":"文心 soon","time":"soon"},{"newsId":1.5,"title":"文心 half","time":"{d}"}]'),
    _listing('"none"'),
    "<html>no data</html>",
]
_LISTING_SQL = rf"""
WITH p AS (SELECT doc_id, {_templates_sql(_LISTING_PAGES)} AS page FROM documents),
j AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(page, '<script id="__NEXT_DATA__"[^>]*>(.*)</script>', 1), '') AS JSON) -> '$.props.pageProps.pageData.listData.result' AS s FROM p),
ok AS (SELECT doc_id, s FROM j WHERE json_type(s) = 'ARRAY'),
r AS (SELECT doc_id, i AS nr, s -> ('$[' || i || ']') AS e FROM (SELECT doc_id, s, unnest(range(0, json_array_length(s)::BIGINT)) AS i FROM ok)),
f AS (SELECT doc_id, nr, e ->> '$.title' AS title, CASE WHEN json_type(e -> '$.newsId') IN ('VARCHAR', 'UBIGINT', 'BIGINT') THEN trim(e ->> '$.newsId') END AS number, e ->> '$.keywords' AS keywords,
    coalesce(CASE WHEN coalesce(e ->> '$.abstract', '') <> '' THEN e ->> '$.abstract' WHEN (e -> '$.contentEtl') IS NOT NULL THEN CASE WHEN json_type(e -> '$.contentEtl') = 'VARCHAR' THEN e ->> '$.contentEtl' END ELSE e ->> '$.content' END, '') AS about,
    TRY_CAST(e ->> '$.time' AS TIMESTAMP) - INTERVAL 8 HOURS AS t
  FROM r WHERE json_type(e) = 'OBJECT'),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY nr) AS n FROM f WHERE number IS NOT NULL AND t IS NOT NULL AND regexp_matches(concat_ws(' ', title, about, keywords), '文心|ERNIE|千帆'))
SELECT row_number() OVER (PARTITION BY doc_id ORDER BY nr) - 1 AS pos, title, 'https://cloud.baidu.com/news/news_' || number AS url, strftime(t, '%Y-%m-%d %H:%M:%S') AS published, about AS excerpt, NULL AS error FROM g WHERE n = 1
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'PageStructureError' FROM j WHERE doc_id NOT IN (SELECT doc_id FROM ok)"""


@query(_LISTING_SQL)
def listing_json_scan(spark, sf):
    """A news list in pages of five shapes: ids and texts of other types, repeated addresses, bad times, no list, no data."""
    return _embedded(spark, sf, embedded.listing_pages, "baidu_ernie", "https://cloud.baidu.com/n", _LISTING_PAGES)


@query(
    f"""SELECT 'https://n.example.com/' || doc_id AS url, CASE doc_id % 3 WHEN 0 THEN 'Linked ' ELSE 'Meta ' END || doc_id AS title,
  strftime({_DATE} + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS published, CASE doc_id % 3 WHEN 0 THEN 'About ' ELSE 'Short ' END || doc_id AS excerpt FROM documents WHERE doc_id % 3 <> 2"""
)
def article_metadata(spark, sf):
    """Title, time and excerpt of articles by linked data or meta tags; a time without a zone is none."""
    linked = '<script type="application/ld+json">{"@graph":[{"@type":["NewsArticle"],"headline":"Linked %1$d","description":"About %1$d","datePublished":"%2$sT10:00:00+02:00"}]}</script>'
    meta = '<meta property="og:title" content="Meta %1$d"><meta property="og:description" content="Short %1$d"><meta property="article:published_time" content="%2$sT10:00:00%3$s">'
    page = F.when(_i() % 3 == 0, F.format_string(linked, _i(), day(_date()))).otherwise(F.format_string(meta, _i(), day(_date()), F.when(_i() % 3 == 1, "+02:00").otherwise("")))
    staged = _documents(spark, sf).select(F.format_string("https://n.example.com/%d", _i()).alias("url"), page.alias("payload"))
    return pages.articles(staged).select("url", "title", stamp("published_at").alias("published"), "excerpt")


# --- feeds ------------------------------------------------------------------


@query(
    f"""SELECT 'feed' AS source_id, 'Note ' || doc_id AS title, 'https://f.example.com/' || doc_id || '?a=1&b=2' AS url,
  strftime({_DATE} + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS published, 'About ' || doc_id AS excerpt FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 10 <> 0 AND doc_id % 9 <> 0"""
)
def atom_feed_scan(spark, sf):
    """Atom entries: alternate links; those without a title, https or a zone are left out."""
    entry = '<feed xmlns="http://www.w3.org/2005/Atom"><entry>%2$s<link rel="self" href="https://f.example.com/self"/><link rel="alternate" href="%3$s://f.example.com/%1$d?a=1&amp;b=2"/><updated>%4$s</updated><summary>About   %1$d</summary></entry></feed>'
    title = F.when(_i() % 7 == 0, "").otherwise(F.format_string("<title>Note %d</title>", _i()))
    at = F.concat(day(_date()), F.lit("T10:00:00"), F.when(_i() % 9 == 0, "").otherwise("+02:00"))
    body = F.format_string(entry, _i(), title, F.when(_i() % 10 == 0, "http").otherwise("https"), at)
    d = feeds.parse_feeds(_documents(spark, sf).select(F.lit("feed").alias("source_id"), body.alias("payload")), _spec(spark, "feed", "feed", "https://f.example.com/"))
    return d.select("source_id", "title", "url", stamp("published_at").alias("published"), "excerpt")


@query(
    f"""SELECT 'On thing ' || doc_id AS title, 'https://p.example.com/abs/' || doc_id AS url, strftime({_DATE}::TIMESTAMP + INTERVAL 90 MINUTES, '%Y-%m-%d %H:%M:%S') AS published,
  'A & B ' || doc_id AS excerpt FROM documents WHERE doc_id % 6 <> 0"""
)
def preprint_scan(spark, sf):
    """Preprint entries: escaped markup goes, and only ISO times count."""
    entry = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>On &lt;b&gt;thing&lt;/b&gt;\n  %1$d</title><link href="https://p.example.com/abs/%1$d" rel="alternate"/><published>%2$s</published><summary>A &amp;amp; B\n%1$d</summary></entry></feed>'
    at = F.when(_i() % 6 == 0, F.concat(F.date_format(_date(), "dd MMM yyyy"), F.lit(" 01:30:00 GMT"))).otherwise(F.concat(day(_date()), F.lit("T01:30:00Z")))
    staged = _documents(spark, sf).select(F.lit("pre").alias("source_id"), F.format_string(entry, _i(), at).alias("payload"))
    return feeds.parse_preprints(staged, _spec(spark, "pre", "arxiv", "https://p.example.com/")).select("title", "url", stamp("published_at").alias("published"), "excerpt")


@query(
    f"""SELECT 'localai' AS community, 't3_' || doc_id AS post_id, 'GPT lab tool ' || doc_id AS title, 'https://lab.example.com/' || doc_id || '?y=1' AS external_url,
  strftime({_DATE} + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS posted FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 9 <> 0"""
)
def community_leads(spark, sf):
    """Leads of community feeds: topical, and to an article elsewhere."""
    link = '&lt;a href=&quot;https://%2$s?y=1#f&quot;&gt;[link]&lt;/a&gt;'
    entry = '<feed xmlns="http://www.w3.org/2005/Atom"><entry>%3$s<id>t3_%1$d</id><title>%4$s %1$d</title><content type="html">' + link + "</content><published>%5$sT10:00:00+02:00</published></entry></feed>"
    there = F.when(_i() % 7 == 0, F.format_string("i.redd.it/%d", _i())).when(_i() % 9 == 0, F.format_string("lab.example.com/%d.jpg", _i())).otherwise(F.format_string("lab.example.com/%d", _i()))
    by = F.when(_i() % 2 == 0, '<category term="LocalAI"/><link href="https://www.example.com/"/>').otherwise('<link href="https://www.example.com/r/LocalAI/comments/1/"/>')
    body = F.format_string(entry, _i(), there, by, F.when(_i() % 5 == 0, "Gardening at home").otherwise("GPT lab tool"), day(_date()))
    d = feeds.parse_leads(_documents(spark, sf).select(F.lit("com").alias("source_id"), body.alias("payload")), _spec(spark, "com", "reddit_rss", None, communities=["localai"], role="discovery"))
    return d.select("community", "post_id", "title", "external_url", stamp("posted_at").alias("posted"))


@query(
    f"""SELECT 'https://lab.example.com/' || doc_id AS url, 'GPT lab tool ' || doc_id AS title, strftime({_DATE} + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS published,
  'Reddit · r/c' || (doc_id % 3) AS source_name, TRUE AS verified, FALSE AS official FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0"""
)
def verified_leads(spark, sf):
    """Leads whose article is topical and on an official host."""
    url = F.format_string("https://%s.example.com/%d", F.when(_i() % 2 == 0, "lab").otherwise("other"), _i())
    d = _documents(spark, sf).select("doc_id", url.alias("url"))
    leads = d.select(F.lit("com").alias("source_id"), F.format_string("c%d", _i() % 3).alias("community"), F.col("url").alias("canonical"))
    at = F.to_timestamp(F.concat(day(_date()), F.lit("T08:00:00+00:00")))
    title = F.format_string("%s %d", F.when(_i() % 5 == 0, "Gardening at home").otherwise("GPT lab tool"), _i())
    articles = d.select("url", title.alias("title"), at.alias("published_at"), F.lit("plain words").alias("excerpt"))
    out = feeds.verified_leads(leads, articles, _spec(spark, "com", "reddit_rss", None, role="discovery"), spark.createDataFrame([("lab.example.com",)], "domain string"))
    return out.select("url", "title", stamp("published_at").alias("published"), "source_name", F.col("discovery_verified").alias("verified"), F.col("is_official_source").alias("official"))


@query("SELECT n_nationkey, 'https://www.reddit.com/r/a' || n_nationkey || '+b/' || f AS url FROM nation, (VALUES ('new/.rss?limit=100'), ('top/.rss?sort=top&t=day&limit=100')) v(f)")
def lead_feed_urls(spark, sf):
    names = F.array(F.format_string("a%d", F.col("n_nationkey").cast("long")), F.lit("b"))
    return testbed.table(spark, sf, "nation").select("n_nationkey", F.explode(urls.lead_feed_urls(names)).alias("url"))


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~\n]|[<>&]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, substr(trim('Q & A ' || t), 1, 4000) AS cleaned FROM d"""
)
def text_clean(spark, sf):
    """Escaped markup around every text: decoded, without tags, collapsed and cut."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ -~\n]|[<>&]", " ")
    return _documents(spark, sf).select("doc_id", text.clean_text_udf(F.concat(F.lit("&lt;p&gt;Q &amp;amp; A</p> \n"), plain, F.lit(" <br>"))).alias("cleaned"))


@query(
    f"""SELECT 'Doc ' || doc_id || CASE doc_id % 8 WHEN 0 THEN ' part & more' ELSE '' END AS title, 'https://f.example.com/' || doc_id AS url,
  strftime({_DATE} + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS published, CASE doc_id % 8 WHEN 3 THEN '' ELSE 'About ' || doc_id END AS excerpt FROM documents"""
)
def feed_markup_scan(spark, sf):
    """Feeds with CDATA inside text, comments, borrowed entries, self-closed elements, a prefix, end tags inside CDATA, inline markup, and broken ones."""
    link = "<link>https://f.example.com/%1$d</link><pubDate>%2$s</pubDate>"
    atom = '<link href="https://f.example.com/%1$d"/><published>%2$s</published>'
    forms = [
        "<item><title>Doc <![CDATA[%1$d part & more]]></title >" + link + "<description><![CDATA[About]]> %1$d</description></item >",
        "<!-- <item><title>Old</title>" + link + "</item> --><item><!-- <title>Old</title> --><title>Doc %1$d</title>" + link + "<description>About %1$d</description></item>",
        "<entry><source><title>Elsewhere</title><published>2020-01-01T00:00:00Z</published></source><title>Doc %1$d</title>" + atom + "<summary>About %1$d</summary></entry>",
        "<item/><item><title>Doc %1$d</title>" + link + "<description/><media:title>Picture</media:title></item>",
        "<a:entry><a:title>Doc %1$d</a:title>" + atom.replace("</", "</a:").replace("<link", "<a:link").replace("<pub", "<a:pub") + "<a:summary>About &lt;i&gt;%1$d&lt;/i&gt;</a:summary></a:entry>",
        "<item><title>Doc %1$d</title>" + link + "<description><![CDATA[About </item></description><b>%1$d</b>]]></description></item>",
        '<entry><title type="xhtml"><div>Doc <b>%1$d</b></div></title>' + atom + '<content type="xhtml"><div>About <i>%1$d</i></div></content></entry>',
        "<item><title>Doc&nbsp;%1$d</title>" + link + "<description>About &lt;b&gt;%1$d&lt;/b&gt;</description></item><item><title>Open",
    ]
    roots = ["feed"] * 4 + ["a:feed", "feed", "feed", "feed"]
    at = F.concat(day(_date()), F.lit("T10:00:00+02:00"))
    made = [F.format_string(f"<{r}>{x}</{r}>", _i(), at) for r, x in zip(roots, forms, strict=True)]
    body = F.get(F.array(*made), (_i() % 8).cast("int"))
    d = feeds.parse_feeds(_documents(spark, sf).select(F.lit("feed").alias("source_id"), body.alias("payload")), _spec(spark, "feed", "feed", "https://f.example.com/"))
    return d.select("title", "url", stamp("published_at").alias("published"), "excerpt")


_TOPIC_TITLES = ["New LLM released", "Gardening", "Help with my LLM", "大模型 news", "I built an agent", "Claudette sings", "Rumor: GPT soon", "A self promo"]


@query(
    """SELECT doc_id, topic, rejected FROM documents JOIN (VALUES (0, TRUE, FALSE), (1, FALSE, FALSE), (2, TRUE, TRUE), (3, TRUE, FALSE), (4, TRUE, TRUE), (5, FALSE, FALSE), (6, TRUE, TRUE), (7, FALSE, TRUE)) v(k, topic, rejected) ON doc_id % 8 = k"""
)
def topic_titles(spark, sf):
    """Titles that leads may have, by example."""
    title = F.get(F.array(*[F.lit(t) for t in _TOPIC_TITLES]), (_i() % 8).cast("int"))
    return _documents(spark, sf).select("doc_id", rules.is_topic(title).alias("topic"), rules.has(title, rules.REJECTED_TITLE).alias("rejected"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS code FROM part")
def code_host(spark, sf):
    """Addresses of the code host itself, not of its neighbours."""
    k = F.col("p_partkey")
    url = F.when(k % 3 == 0, "https://GitHub.com/a/b").when(k % 3 == 1, "https://gist.github.com/a").otherwise("https://example.com/github.com")
    return testbed.table(spark, sf, "part").select("p_partkey", urls.is_code_host(url).alias("code"))


@query(
    """SELECT p_partkey, '/base/days/' || p_partkey || '/' AS page, '/base/' AS home, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '/base/assets/css/' || p_partkey || '.css' END AS asset,
  CASE p_partkey % 3 WHEN 0 THEN 'https://site.example.com/' WHEN 1 THEN 'https://site.example.com/days/' || p_partkey || '/' ELSE 'https://site.example.com/feed.xml' END AS public FROM part"""
)
def site_addresses(spark, sf):
    """Addresses of pages, assets and output files."""
    k = F.col("p_partkey")
    asset = F.format_string("%s/%d.css", F.when(k % 2 == 0, "css/..").otherwise("/css"), k)
    output = F.when(k % 3 == 0, "index.html").when(k % 3 == 1, F.format_string("days/%d/index.html", k)).otherwise("/feed.xml")
    return testbed.table(spark, sf, "part").select(
        "p_partkey", urls.page_url("/base/", F.format_string("/days/%d", k)).alias("page"), urls.page_url("/base/", F.lit("/")).alias("home"),
        urls.asset_url("/base/", asset).alias("asset"), urls.output_url("https://site.example.com/", output).alias("public"),
    )


# --- sinks and stored tables ------------------------------------------------


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders""")
def canonical_json(spark, sf):
    return sinks.canonical_json(testbed.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey"), "o_orderkey")


@query(f"WITH {_RUNS} SELECT date::VARCHAR AS date, CASE WHEN day(date) % 3 = 0 THEN 'second' ELSE 'first' END AS version FROM rep WHERE date >= DATE '2024-01-05'")
def report_upsert(spark, sf):
    """Reports stored twice: the second time replaces exactly its own dates, and a read prunes by date."""
    path = f"{own_dir(spark)}/upsert-{uuid.uuid4().hex}"
    d = testbed.report_days(spark, sf)
    sinks.upsert_by_date(d.withColumn("version", F.lit("first")), path)
    sinks.upsert_by_date(d.where("dayofmonth(date) % 3 = 0").withColumn("version", F.lit("second")), path)
    return sinks.read_by_date(spark, path, "2024-01-05").select(day("date").alias("date"), "version")


@query(f"WITH {_RUNS} SELECT date::VARCHAR AS date, status, 'none' AS code FROM rep JOIN rec USING (date)")
def publication(spark, sf):
    """Reports stored together with their run records."""
    path = f"{own_dir(spark)}/publish-{uuid.uuid4().hex}"
    records = testbed.run_days(spark, sf).select("date", testbed.now().alias("cutoff_at"), "status", F.lit("none").alias("safe_error_code"))
    sinks.publish(testbed.report_days(spark, sf), records, path)
    return sinks.read_by_date(spark, path).select(day("date").alias("date"), "run.status", F.col("run.safe_error_code").alias("code"))


@query(
    f"""WITH {_RUNS} SELECT '/' || p AS url FROM (VALUES (''), ('archive/'), ('sources/'), ('search/')) v(p) UNION ALL SELECT '/days/' || date || '/' FROM rep
UNION ALL SELECT DISTINCT '/channels/c' || (doc_id % 5) || CASE WHEN doc_id % 4 = 0 THEN '/' ELSE '/page/' || (1 + doc_id % 4) || '/' END FROM documents"""
)
def sitemap_urls(spark, sf):
    channel_pages = _documents(spark, sf).select(F.format_string("c%d", _i() % 5).alias("channel"), (1 + _i() % 4).alias("page"))
    return sinks.sitemap_urls(testbed.report_days(spark, sf), channel_pages, "/")


@query(
    f"""WITH {_RUNS}, r AS (SELECT date, sum(CASE WHEN success THEN n ELSE 0 END) AS c FROM rn GROUP BY date),
i AS (SELECT date, c + (day(date) % 3 = 0)::INT AS item_count FROM r UNION ALL SELECT date, c + (day(date) % 3 = 0)::INT FROM r WHERE day(date) % 7 = 0 UNION ALL SELECT date + 10000, 1 FROM r WHERE day(date) % 5 = 0)
SELECT i.date::VARCHAR AS date, CASE WHEN c IS NULL THEN 'missing_report' ELSE 'item_count' END AS code FROM i LEFT JOIN r USING (date) WHERE c IS NULL OR c <> item_count
UNION ALL SELECT date::VARCHAR, 'duplicate_entry' FROM i GROUP BY date HAVING count(*) > 1"""
)
def report_index(spark, sf):
    """Reports against an index with wrong counts, entries without a report and entries listed twice."""
    reports = testbed.reports(spark, sf)
    n = F.dayofmonth("date")
    own = reports.select("date", (F.size("items") + (n % 3 == 0).cast("int")).alias("item_count"))
    index = own.unionByName(own.where(n % 7 == 0)).unionByName(own.where(n % 5 == 0).select(F.date_add("date", 10_000).alias("date"), F.lit(1).alias("item_count")))
    return tables.index_violations(reports, index).select(day("date").alias("date"), "code")


@query("SELECT CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'invalid-json' ELSE 'success' END AS status, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN NULL ELSE 'd' || doc_id END AS id FROM documents")
def search_index_parse(spark, sf):
    """Serialized search indexes: an entry without an address, or no array, makes one invalid."""
    page = F.when(_i() % 5 == 0, "").otherwise(F.format_string(',"page_url":"/days/%d/"', _i()))
    entry = F.concat(F.format_string('{"id":"d%d"', _i()), page, F.lit("}"))
    stored = _documents(spark, sf).select(F.when(_i() % 7 == 0, entry).otherwise(F.concat(F.lit("["), entry, F.lit("]"))).alias("text"))
    return readmodels.parse_search_index(stored).select("status", F.element_at("entry", "id").alias("id"))


@query(f"WITH {_PUB} SELECT id, report_date::VARCHAR AS report_date, row_number() OVER (ORDER BY published_at DESC, report_date DESC, id) AS place FROM pub")
def search_places(spark, sf):
    """The place of every entry in the order of the search index."""
    d = ranking.numbered(testbed.items(spark, sf).select("id", "report_date", "published_at"), readmodels.search_sort())
    return d.select("id", day("report_date").alias("report_date"), F.col("position").alias("place"))


def _put(spark, files: dict[str, str], root: str) -> None:
    """Write a few small files below a folder that executors can read."""
    for name, body in files.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(body.encode()))
        out.close()


def _dates(spark, sf) -> list:
    return sorted(r.date for r in testbed.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct().collect())


@query(f"WITH {_RUNS} SELECT DISTINCT date::VARCHAR AS date, 'published' AS status, day(date) % 7 <> 0 AS path_ok, 2::BIGINT AS sources FROM rn")
def run_record_scan(spark, sf):
    """Run records, one file a date; some lie at another date's path."""
    root = f"{own_dir(spark)}/records-{uuid.uuid4().hex}"
    run = [{"source_id": f"s{i}", "source_name": f"S {i}", "success": True, "item_count": i, "elapsed_ms": 5} for i in range(2)]
    body = {"cutoff_at": "2024-01-01T15:59:59Z", "status": "published", "safe_error_code": "none", "source_runs": run}
    path = lambda d: (d.replace(year=d.year + 50) if d.day % 7 == 0 else d).strftime("%Y/%m/%Y-%m-%d.json")
    _put(spark, {path(d): json.dumps({"date": str(d), **body}) for d in _dates(spark, sf)}, root)
    return tables.read_run_records(spark, root).select(day("date").alias("date"), "status", "path_ok", F.size("source_runs").alias("sources"))


@query(
    f"""WITH {_RUNS} SELECT DISTINCT date::VARCHAR AS date, day(date) % 3 AS version, day(date)::BIGINT AS items,
  CASE day(date) % 3 WHEN 0 THEN CASE WHEN day(date) % 2 = 0 THEN '前沿研究' ELSE '产品工程' END WHEN 2 THEN '平台与政策' END AS lane FROM rn"""
)
def report_scan(spark, sf):
    """Reports of three versions, as many items as the day says; only the oldest version gets a lane by category."""
    root = f"{own_dir(spark)}/reports-{uuid.uuid4().hex}"

    def body(d) -> str:
        item = {"id": "0", "title": "t", "category": "论文研究" if d.day % 2 == 0 else "Agent", **({"editorial_lane": "平台与政策"} if d.day % 3 == 2 else {})}
        return json.dumps({"schema_version": f"1.{d.day % 3}", "date": str(d), "items": [item] * d.day, "source_runs": []}, ensure_ascii=False)

    _put(spark, {f"{d:%Y/%m/%Y-%m-%d}.json": body(d) for d in _dates(spark, sf)}, root)
    d = tables.read_reports(spark, root)
    return d.select(day("date").alias("date"), F.substring("schema_version", 3, 1).cast("long").alias("version"), F.size("items").alias("items"), F.expr("items[0].editorial_lane").alias("lane"))


_ENDS = {
    "sources down": ("failed_before_publish", "no_healthy_sources"),
    "no times": ("failed_before_publish", "candidate_preparation_failed"),
    "all known": ("no_eligible_content", "no_eligible_candidates"),
    "no analyzer": ("failed_before_publish", "configuration_failed"),
    "silent analyzer": ("failed_before_publish", "analysis_failed"),
    "full disk": ("failed_before_publish", "persistence_failed"),
    "good day": ("published", "none"),
}


@query(
    f"""WITH {CAND_SQL}, {HISTORY_SQL}, n AS (SELECT count(*) AS new_rows FROM cand WHERE published_at BETWEEN TIMESTAMP '{testbed.NOW}' - INTERVAL 120 HOURS AND TIMESTAMP '{testbed.NOW}' AND canonical_url NOT IN (SELECT canonical_url FROM hist))
SELECT case_name, status, code, CASE WHEN case_name IN ('sources down', 'no times') THEN NULL WHEN case_name = 'all known' THEN 0 ELSE new_rows END::BIGINT AS new_rows,
  (status = 'published')::BIGINT AS reports, CASE WHEN status = 'published' THEN 0 END::BIGINT AS uncounted FROM n, (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _ENDS.items())}) v(case_name, status, code)"""
)
def run_outcomes(spark, sf):
    """The ends of a day's run over all raw items (but the last check of a report, which only a faulty analysis step reaches): status, code and new rows of the stored record, whether a report
    was stored, and how many of its items the record's counts of selected rows miss."""
    raw = Stored(testbed.raw_items(spark, sf), "q-raw").df
    past = Stored(testbed.history(spark, sf), "q-history").df
    named = raw.select("source_id", "source_name").distinct()
    runs = cut(named.select("*", F.lit(True).alias("success"), F.lit(2).alias("item_count"), F.lit(5).alias("elapsed_ms"), F.lit(None).cast("string").alias("error_type")), "q-runs")
    down = runs.withColumn("success", F.lit(False))
    known = funnel.to_candidates(raw, simple=True).select("canonical_url")

    def ask(prompt, error, answer):
        fixed = {
            "category": "Agent", "editorial_lane": "产品与应用", "summary": "A summary of what happened today.", "importance": 5, "why_it_matters": "It matters to readers.",
            "tags": ["one"], "is_official": True, "marketing_risk": "low", "tracking_signal": "watch this",
        }
        return json.dumps([{"id": r["id"], "title": f"Title {k}", **fixed} for k, r in enumerate(prompt)], ensure_ascii=False)

    class FullDisk(Snapshots):
        def stage(self, rows):
            if "reports" in rows:
                raise OSError("no space left")
            return super().stage(rows)

    now = testbed.now()
    good = daily.prepare(raw, runs, past, now, simple=True)
    days = {
        "sources down": (daily.prepare(raw, down, past, now, simple=True), ask), "no times": (daily.prepare(raw.drop("published_at"), runs, past, now, simple=True), ask),
        "all known": (daily.prepare(raw, runs, known, now, simple=True), ask), "no analyzer": (good, None), "silent analyzer": (good, lambda *_: ""),
        "full disk": (good, ask), "good day": (good, ask),
    }
    out = []
    for name, (prepared, asked) in days.items():
        store = (FullDisk if name == "full disk" else Snapshots)(spark, f"{own_dir(spark)}/days-{uuid.uuid4().hex}")
        daily.conclude(prepared, down if name == "sources down" else runs, testbed.RUN_DATE, now, asked, "m", store)
        held = store.read("run_records", schema.RUN_RECORDS)
        total = F.expr("aggregate(source_runs, cast(null as bigint), (a, r) -> if(r.new_count is null, a, coalesce(a, 0) + r.new_count))")
        found = held.select(F.lit(name).alias("case_name"), "status", F.col("safe_error_code").alias("code"), total.alias("new_rows"))
        reports = store.read("reports", schema.REPORTS).select("date", F.size("items").alias("items"), F.expr("aggregate(source_runs, 0L, (a, r) -> a + coalesce(r.selected_count, 0))").alias("counted"))
        held = reports.agg(F.count("*").alias("reports"), F.sum(F.col("items") - F.col("counted")).alias("uncounted")).first()
        out.append(found.select("*", F.lit(held.reports).alias("reports"), F.lit(held.uncounted).cast("long").alias("uncounted")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(f"WITH {_RUNS} SELECT date::VARCHAR AS date, CASE WHEN day(date) % 2 = 0 THEN 'second' ELSE 'first' END AS status, count(*) AS sources FROM rn GROUP BY date")
def snapshot_commit(spark, sf):
    """Run records of all days in a first commit, of even days in a second, and a third that was never published and is swept."""
    rows = testbed.runs(spark, sf).groupBy("date").agg(F.count("*").alias("sources"))
    rows = cut(rows, "q-days")
    store = Snapshots(spark, f"{own_dir(spark)}/snap-{uuid.uuid4().hex}")
    store.commit({"run_records": rows.withColumn("status", F.lit("first"))})
    store.commit({"run_records": rows.where("day(date) % 2 = 0").withColumn("status", F.lit("second"))})
    store.stage({"run_records": rows.withColumn("status", F.lit("lost"))})
    store.sweep()
    return store.read("run_records", T.StructType([T.StructField("date", T.DateType()), T.StructField("status", T.StringType()), T.StructField("sources", T.LongType())])).withColumn("date", day("date"))


@query(SQL["source_status_7run"])
def source_status_committed(spark, sf):
    """The roll-up of the last seven run dates from committed runs: the folders of older days are not opened."""
    runs = Stored(testbed.runs(spark, sf), "q-runs").df
    store = Snapshots(spark, f"{own_dir(spark)}/snap-{uuid.uuid4().hex}")
    store.commit({"source_runs": runs.where("day(date) % 2 = 0")})
    store.commit({"source_runs": runs.where("day(date) % 2 = 1")})
    last = store.recent("source_runs", runs.schema, readmodels.ROLL_UP_DATES)
    d = readmodels.source_statuses(testbed.specs(spark, sf), last)
    return d.select("source_id", "request_status", "item_count", stamp("latest_published_at").alias("latest"), "recent_count", "new_count", "candidate_count", "diagnostic_label")


# --- checks of responses ----------------------------------------------------


def _n() -> Column:
    return F.regexp_extract("title", r"(\d+)$", 1).cast("long")


@query(f"WITH {_ITEMS_SQL} SELECT id, n % 13 BETWEEN 1 AND 10 AND n % 9 <> 0 AND n % 7 <> 0 AS ok FROM an")
def strict_rows(spark, sf):
    """Which rows of a response keep all bounds: importance, tags and risk are wrong in some."""
    d = testbed.analyses(spark, sf).withColumn("n", _n())
    d = d.withColumn("importance", (F.col("n") % 13).cast("int")).withColumn("marketing_risk", F.when(F.col("n") % 9 == 0, "none").otherwise(F.col("marketing_risk")))
    d = d.withColumn("tags", F.when(F.col("n") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("tags")))
    return d.select("id", analysis.strict_row().alias("ok"))


@query("SELECT * FROM (VALUES ('as asked', NULL), ('of no bounds', 'schema'), ('repeated', 'duplicate'), ('not asked', 'unknown')) v(case_name, error)")
def response_integrity(spark, sf):
    """The first error of four responses over all analyses."""
    rows = Stored(testbed.analyses(spark, sf), "q-analyses").df
    asked = rows.select("id")
    wrong = rows.withColumn("summary", F.when(_n() % 2 == 0, "short").otherwise(F.col("summary")))
    cases = [("as asked", rows, asked), ("of no bounds", wrong, asked), ("repeated", rows.unionByName(rows), asked), ("not asked", rows, asked.limit(1))]
    found = [analysis.response_error(r, s).select(F.lit(name).alias("case_name"), "error") for name, r, s in cases]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"WITH {_ITEMS_SQL} SELECT id, CASE WHEN n % 7 = 0 THEN CASE WHEN n % 6 = 5 THEN '前沿研究' ELSE '产品工程' END ELSE ['产品与应用', '商业与市场', '平台与政策'][n % 3 + 1] END AS lane FROM an WHERE n % 11 <> 0 AND n % 13 <> 0")
def analysis_bounds(spark, sf):
    """Analyses within the stored bounds; a missing lane follows from the category."""
    d = testbed.analyses(spark, sf).withColumn("n", _n())
    d = d.withColumn("editorial_lane", F.when(F.col("n") % 7 != 0, F.col("editorial_lane"))).withColumn("tracking_signal", F.when(F.col("n") % 11 == 0, "tiny").otherwise("watch this"))
    d = d.withColumn("importance", F.when(F.col("n") % 13 != 0, F.col("importance")))
    return analysis.valid_analyses(d).select("id", F.col("editorial_lane").alias("lane"))


@query(f"WITH {_ITEMS_SQL} SELECT id, 'unknown' AS error FROM an WHERE n % 3 = 0 UNION ALL SELECT id, 'unknown' FROM an WHERE n % 6 = 0 UNION ALL SELECT id, 'duplicate' FROM an WHERE n % 2 = 0")
def unknown_analyses(spark, sf):
    """Ids of analyses that nobody asked for or that come twice."""
    d = testbed.analyses(spark, sf)
    return analysis.unknown_ids(d.unionByName(d.where(_n() % 2 == 0)), d.where(_n() % 3 != 0).select("id"))


# --- streams ----------------------------------------------------------------


def _streamed(spark, source: Stored, build, out: str, files: int | None = None):
    """Run a stream over a stored table to its end, ``files`` at a time, into a table."""
    read = spark.readStream.schema(source.df.schema)
    d = build((read if files is None else read.option("maxFilesPerTrigger", files)).parquet(source.path))
    w = d.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append")
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(d.schema).parquet(f"{out}/data")


@query(f"WITH {CAND_SQL}, {HISTORY_SQL} SELECT doc_id FROM cand WHERE canonical_url NOT IN (SELECT canonical_url FROM hist)")
def stream_history(spark, sf):
    """Streamed candidates whose address is not in the history."""
    source = Stored(testbed.candidates(spark, sf).select("doc_id", "canonical_url"), "st-in")
    past = Stored(testbed.history(spark, sf), "st-history").df
    return _streamed(spark, source, lambda d: streams.against_history(d, past), f"{own_dir(spark)}/st-{uuid.uuid4().hex}").select("doc_id")


@query(f"WITH {CAND_SQL} SELECT host, lower(title) AS folded, max(source_weight) AS source_weight FROM cand GROUP BY host, lower(title)")
def stream_titles(spark, sf):
    """The best weight of each title at each host, from the keyed state of a stream."""
    source = Stored(testbed.candidates(spark, sf).select("id", "canonical_url", fold().alias("folded"), F.col("source_weight").cast("int").alias("source_weight"), "published_at"), "st-in")
    rows = _streamed(spark, source, streams.first_titles, f"{own_dir(spark)}/st-{uuid.uuid4().hex}")
    return rows.groupBy("host", "folded").agg(F.max("source_weight").alias("source_weight"))


@query(SQL["exact_winners"])
def stream_winners(spark, sf):
    """The winners of the first phase from the changes that a stream of at most four batches announces and takes back."""
    source = Stored(testbed.candidates(spark, sf).drop("doc_id"), "st-in")
    if len(source.df.inputFiles()) < 4:  # at most three splits of the input
        source = Stored(source.df.repartition(4), "st-in")
    files = -(-len(source.df.inputFiles()) // 4)
    was = {k: spark.conf.get(k, None) for k in streams.STATE_STORE}
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        rows = _streamed(spark, source, lambda d: streams.exact_changes(d, fold()), f"{own_dir(spark)}/st-{uuid.uuid4().hex}", max(1, files))
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return streams.settled_changes(rows).select("id", "source_id")


@query(f"WITH {CAND_SQL} SELECT source_id, count(*) AS new_count, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS latest FROM cand GROUP BY source_id")
def stream_funnel(spark, sf):
    """Counts per source from the batches of a stream, one of which is replayed."""
    source = Stored(testbed.candidates(spark, sf).select("source_id", "published_at"), "st-in")
    out = f"{own_dir(spark)}/st-{uuid.uuid4().hex}"
    write = streams.funnel_to(f"{out}/data")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    s = spark.readStream.schema(source.df.schema).parquet(source.path).writeStream.foreachBatch(twice).option("checkpointLocation", f"{out}/state")
    s.trigger(availableNow=True).start().awaitTermination()
    d = spark.read.parquet(f"{out}/data")
    return d.groupBy("source_id").agg(F.sum("new_count").alias("new_count"), stamp(F.max("latest_published_at")).alias("latest"))

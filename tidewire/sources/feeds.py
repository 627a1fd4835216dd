"""RSS and Atom feeds from staged payloads of (source_id, payload), wholly as expressions.

Payloads are parsed by Spark's XML functions, so feeds of any number of sources
are one scan. A bad entry is skipped and the rest kept.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules, text, times, urls
from tidewire.operators.domains import under

MAX_LEADS = 100
MAX_ARTICLES = 8

# Hosts that never hold an original article.
BLOCKED_DOMAINS = ["external-preview.redd.it", "i.redd.it", "preview.redd.it", "redd.it", "reddit.com", "v.redd.it"]
SHORTENERS = ["bit.ly", "buff.ly", "goo.gl", "ow.ly", "shorturl.at", "t.co", "tinyurl.com"]
MEDIA_FILE = r"(?i)\.(?:avif|gif|jpe?g|m4v|mov|mp4|png|webm|webp)$"


# The elements of an entry that are read, as texts.
TEXTS = ["id", "title", "pubDate", "published", "dc:date", "updated", "created", "description", "summary", "content:encoded", "content"]
_ENTRY = "struct<" + ",".join(f"`{t}`:array<string>" for t in TEXTS)
_ENTRY += ",link:array<struct<_VALUE:string,_href:string,_rel:string>>,category:array<struct<_term:string>>>"
_FEED = f"struct<channel:array<struct<item:array<{_ENTRY}>>>,item:array<{_ENTRY}>,entry:array<{_ENTRY}>,_broken:string>"


def _unprefixed(payload: Column) -> Column:
    """The payload without what stands before its first tag; the prefix of a prefixed root goes from all tags outside CDATA."""
    payload = F.regexp_replace(payload, r"^[\s\uFEFF]+", "")
    prefix = F.regexp_extract(payload, r"^(?:<\?[^>]*>\s*|<!--(?s:.*?)-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z_][\w.-]*):(?:feed|rss)\b", 1)
    tags = F.concat(F.lit(r"(<!\[CDATA\[(?s:.*?)\]\]>)|(</?)"), prefix, F.lit(":"))
    return F.when(prefix == "", payload).otherwise(F.regexp_replace(payload, tags, F.lit("$1$2")))


def _loose(payload: Column) -> Column:
    """Entries of a payload that is no well-formed XML, cut out by tag and read field by field."""
    plain = F.regexp_replace(payload, r"(?s)<!--.*?-->|(<!\[CDATA\[.*?\]\]>)", "$1")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)<(?:item|entry)(?:\s[^>]*)?(?<!/)>.*?</(?:item|entry)\s*>"), F.lit(0))
    own = F.transform(blocks, lambda b: F.regexp_replace(b, r"(?s)<source\b[^>]*(?<!/)>.*?</source\s*>", ""))

    def values(block: Column, tag: str) -> Column:
        found = F.regexp_extract_all(block, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?(?<!/)>(.*?)</{tag}\s*>"), F.lit(1))
        framed = lambda v: F.regexp_replace(v, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        return F.transform(found, lambda v: F.when(v.contains("<![CDATA["), framed(v)).otherwise(_decoded(v)))

    def attribute(element: Column, name: str) -> Column:
        found = F.regexp_extract(element, rf"(?s)^[^>]*\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
        return F.when(found != "", _decoded(found))

    def entry(block: Column) -> Column:
        texts = F.transform(values(block, "link"), lambda v: F.struct(v.alias("_VALUE"), F.lit(None).cast("string").alias("_href"), F.lit(None).cast("string").alias("_rel")))
        tags = lambda tag: F.regexp_extract_all(block, F.lit(rf"(?s)<{tag}\s[^>]*>"), F.lit(0))
        links = F.transform(tags("link"), lambda t: F.struct(F.lit(None).cast("string").alias("_VALUE"), attribute(t, "href").alias("_href"), attribute(t, "rel").alias("_rel")))
        terms = F.transform(tags("category"), lambda t: F.struct(attribute(t, "term").alias("_term")))
        return F.struct(*[values(block, t).alias(t) for t in TEXTS], F.concat(texts, links).alias("link"), terms.alias("category"))

    return F.transform(own, entry)


def _decoded(value: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#32;", " "), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def entries(payloads: DataFrame) -> DataFrame:
    """(source_id, pos, e) of every RSS item and Atom entry, in order; ``e`` holds its elements by name.

    Payloads are parsed as XML. One that is not well-formed is searched for its
    entries tag by tag instead, so that what can be read of it is not lost.
    """
    parsed = F.from_xml("_payload", _FEED, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    d = payloads.select("source_id", _unprefixed(F.col("payload")).alias("_payload")).select("source_id", "_payload", parsed.alias("_x"))
    none = F.array().cast(f"array<{_ENTRY}>")
    items = F.flatten(F.transform(F.col("_x.channel"), lambda c: F.coalesce(c["item"], none)))
    strict = F.concat(*[F.coalesce(c, none) for c in (items, F.col("_x.item"), F.col("_x.entry"))])
    found = F.when(F.col("_x._broken").isNotNull(), _loose(F.col("_payload")).cast(f"array<{_ENTRY}>")).otherwise(strict)
    return d.select("source_id", F.posexplode(found).alias("pos", "e"))


def _value(*tags: str) -> Column:
    """The first of an entry's elements of these names, in this order, that is not blank."""
    return F.coalesce(*[F.get(F.filter(F.col("e")[t], lambda v: F.trim(v) != ""), 0) for t in tags])


def _markup(*tags: str) -> Column:
    """Like ``_value``, escaped once, as the cleaning functions expect it."""
    return F.replace(F.replace(_value(*tags), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _link() -> Column:
    """RSS link text, or the alternate (or first) Atom link's address."""
    first = lambda found, field: F.get(F.transform(found, lambda k: k[field]), 0)
    links = F.col("e.link")
    text_ = F.filter(links, lambda k: F.trim(k["_VALUE"]) != "")
    addressed = F.filter(links, lambda k: F.trim(k["_href"]) != "")
    return F.coalesce(first(text_, "_VALUE"), first(F.filter(addressed, lambda k: k["_rel"] == "alternate"), "_href"), first(addressed, "_href"))


def _https(url: Column) -> Column:
    u = text.collapse(url)
    return F.when(u.rlike(r"^https://[^/\s]"), u)


def with_source(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Entry rows (source_id, title, url, published_at, excerpt) as raw items of their sources."""
    s = specs.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("weight").alias("source_weight"), F.col("category").alias("category_hint"),
        F.col("official").alias("is_official_source"), F.col("role").alias("source_role"),
    )
    d = rows.join(s, "source_id")
    return d.select(
        "source_id", "source_name", "source_weight", "title", "url", "published_at", F.coalesce("excerpt", F.lit("")).alias("excerpt"), "category_hint",
        "is_official_source", "source_role", F.lit(False).alias("discovery_verified"),
    )


def parse_feeds(payloads: DataFrame, specs: DataFrame) -> DataFrame:
    """Raw items of RSS and Atom payloads; entries need a title, an https link and a zoned time."""
    when, about = _value("pubDate", "published", "dc:date", "updated", "created"), _markup("description", "summary", "content:encoded", "content")
    d = entries(payloads).select(
        "source_id", text.clean_text_udf(_markup("title")).alias("title"), _https(_link()).alias("url"), times.feed_timestamp(when).alias("published_at"),
        text.clean_text_udf(about).alias("excerpt"),
    )
    return with_source(d.where("title <> '' and url is not null and published_at is not null"), specs)


def parse_preprints(payloads: DataFrame, specs: DataFrame) -> DataFrame:
    """Like ``parse_feeds`` for preprint listings: ISO times only, markup cleaned to the depth."""
    d = entries(payloads).select(
        "source_id", text.clean_markup_udf(_markup("title")).alias("title"), _https(_link()).alias("url"), times.strict_timestamp(_value("published")).alias("published_at"),
        text.clean_markup_udf(_markup("summary")).alias("excerpt"),
    )
    return with_source(d.where("title <> '' and url is not null and published_at is not null"), specs)


def _outside(host: Column) -> Column:
    return ~F.exists(F.array(*[F.lit(d) for d in BLOCKED_DOMAINS + SHORTENERS]), lambda d: urls.domain_matches(host, d))


def parse_leads(payloads: DataFrame, specs: DataFrame) -> DataFrame:
    """Discovery leads of community feeds: topical titles that link to an article elsewhere.

    A payload that is no Atom feed raises. Rows: source_id, pos, community, post_id, title, external_url, posted_at.
    """
    feed = F.col("payload").rlike(r"(?s)<(?:[A-Za-z_][\w.-]*:)?feed\b[^>]*Atom")
    checked = payloads.withColumn("payload", F.when(feed, F.col("payload")).otherwise(F.raise_error(F.lit("not an Atom feed"))))
    d = entries(checked).where(F.col("pos") < MAX_LEADS).join(specs.select(F.col("id").alias("source_id"), "communities"), "source_id")
    title = text.clean_text_udf(_markup("title"))
    anchor = F.regexp_extract(_value("content", "summary"), r"(?is)<a\b[^>]*\bhref=[\"']([^\"']+)[\"'][^>]*>\s*\[link\]\s*</a>", 1)
    url = F.replace(anchor, F.lit("&amp;"), F.lit("&"))
    terms = F.coalesce(F.filter(F.col("e.category._term"), lambda t: t.isNotNull()), F.array().cast("array<string>"))
    linked = F.regexp_extract(F.coalesce(_link(), F.lit("")), r"/r/([A-Za-z0-9_]{2,21})(?:/|$)", 1)
    names = F.transform(F.concat(terms, F.array(linked)), lambda x: F.lower(x))
    community = F.get(F.flatten(F.transform(names, lambda n: F.filter("communities", lambda c: F.lower(c) == n))), 0)
    posted = times.feed_timestamp(_value("published", "updated"))
    d = d.select("source_id", "pos", community.alias("community"), F.trim(_value("id")).alias("post_id"), title.alias("title"), url.alias("external_url"), posted.alias("posted_at"))
    host, path = urls.host(F.col("external_url")), F.regexp_extract("external_url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    ok = F.col("external_url").rlike(r"^https://[^/@\s]+(?:/|\?|#|$)") & _outside(host) & ~path.rlike(MEDIA_FILE) & ~F.col("external_url").rlike(r"^https://[^/?#]*:(?!443(?:[/?#]|$))")
    d = d.where("title <> '' and post_id is not null and community is not null and posted_at is not null").where(ok)
    d = d.withColumn("external_url", F.regexp_replace("external_url", "#.*$", ""))
    return d.where(rules.is_topic(F.col("title")) & ~rules.has(F.col("title"), rules.REJECTED_TITLE))


def official_domains(specs: DataFrame) -> DataFrame:
    """Hosts of enabled primary and trusted sources."""
    d = specs.where("enabled and role in ('primary', 'trusted_media') and url is not null")
    return d.select(urls.host(F.col("url")).alias("domain")).where("domain <> ''").distinct()


def choose_leads(new: DataFrame, best: DataFrame, domains: DataFrame, most: int = MAX_ARTICLES) -> DataFrame:
    """Leads of both feeds on allowed hosts, each canonical address once (the first), at most so many per source."""
    from pyspark.sql import Window

    both = new.withColumn("seq", F.struct(F.lit(0).alias("f"), F.col("pos").alias("p"))).unionByName(best.withColumn("seq", F.struct(F.lit(1).alias("f"), F.col("pos").alias("p"))))
    both = both.withColumn("canonical", urls.canonical_url(F.col("external_url"))).where("canonical is not null").withColumn("host", urls.host(F.col("external_url")))
    allowed = under(both, "host", domains)
    first = allowed.withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "canonical").orderBy("seq"))).where("_n = 1")
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("seq"))).where(F.col("_n") <= most)
    return kept.select("source_id", "community", "post_id", "title", "external_url", "canonical", "posted_at", F.col("_n").alias("place"))


def verified_leads(leads: DataFrame, articles: DataFrame, specs: DataFrame, domains: DataFrame) -> DataFrame:
    """Raw items of leads whose article says the same; ``articles`` has (url, title, published_at, excerpt)."""
    a = articles.where("title <> '' and excerpt <> '' and published_at is not null").withColumn("canonical", urls.canonical_url(F.col("url")))
    a = a.where(rules.is_topic(F.concat_ws(" ", "title", "excerpt"))).select("canonical", "title", "published_at", "excerpt")
    d = leads.select("source_id", "community", "canonical").join(a, "canonical")
    d = under(d.withColumn("host", urls.host(F.col("canonical"))), "host", domains)
    d = with_source(d.select("source_id", "community", "title", F.col("canonical").alias("url"), "published_at", "excerpt").drop("community"), specs).join(
        d.select("source_id", F.col("canonical").alias("url"), "community"), ["source_id", "url"]
    )
    d = d.withColumn("source_name", F.concat(F.lit("Reddit · r/"), F.col("community"))).withColumn("is_official_source", F.lit(False)).withColumn("discovery_verified", F.lit(True))
    return d.drop("community")


def parse_releases(payloads: DataFrame, specs: DataFrame) -> DataFrame:
    """Raw items of JSON release lists: neither drafts nor pre-releases; anything but a JSON list raises."""
    shape = "array<struct<name:string,tag_name:string,body:string,draft:boolean,prerelease:boolean,published_at:string,html_url:string>>"
    listed = F.col("payload").rlike(r"(?s)^\s*\[.*\]\s*$") & F.try_parse_json("payload").isNotNull()
    body = F.when(listed, F.col("payload")).otherwise(F.raise_error(F.lit("release payload must be a JSON list")))
    d = payloads.select("source_id", F.explode(F.from_json(body, shape)).alias("r")).select("source_id", "r.*")
    d = d.where("draft = false and prerelease = false")
    name, tag = text.clean_markup_udf("name"), text.clean_markup_udf("tag_name")
    d = d.select(
        "source_id", F.when(name != "", name).otherwise(tag).alias("title"), _https(F.col("html_url")).alias("url"), times.strict_timestamp(F.col("published_at")).alias("published_at"),
        text.clean_markup_udf("body").alias("excerpt"),
    )
    return with_source(d.where("title <> '' and url is not null and published_at is not null"), specs)

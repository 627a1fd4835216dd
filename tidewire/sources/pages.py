"""Index pages and articles of sources without a feed.

Each scanner turns a page's text into entries (title, url, published, excerpt);
``scan_pages`` runs the right one on every staged page in an Arrow function and
lets the engine do the rest: quotas, detail pages, source columns.
"""

import json
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pandas as pd
from dateutil.parser import parse as parse_time
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import clean_text
from tidewire.functions.urls import allowed_url
from tidewire.sources.dom import Node, parse
from tidewire.sources.feeds import with_source

MAX_INDEX = 30
MAX_DETAILS = 8
MIN_EXCERPT = 80

# Markers of challenge pages, words that are no titles, and what each scanner looks for.
CHALLENGES = ["access denied", "captcha", "verify you are human"]
CHALLENGE_ANYWHERE = "cf-chl-"
GENERIC_LINKS = ["blog", "featured", "learn more", "open source", "research"]
MONTH_DAY = r"(?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+\d{4}\b"
LONG_MONTH_DAY = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b"
CJK_DATE = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
UPDATE_TITLE = r"(?i)GLM|模型|产品|平台|智能体|Agent|发布|上线"
CARD_TITLE = r"(?i)MiniMax|model|模型|H\d|M\d|abab|海螺|Hailuo|speech|audio|video"
POST_BRAND = r"(?i)混元|Hunyuan"
ROUTER_BRAND = r"(?i)豆包|方舟|大模型|Doubao|ARK"
LISTING_BRAND = r"(?i)文心|ERNIE|千帆"
PACIFIC, CHINA = "America/Los_Angeles", "Asia/Shanghai"

Entry = tuple[str, str, datetime, str]


class PageStructureError(ValueError):
    """The page is a challenge or no longer has the expected structure."""


def is_challenge(markup: str) -> bool:
    """Whether a page only asks its reader to prove something."""
    low = markup.casefold()
    if CHALLENGE_ANYWHERE in low:
        return True
    if not any(m.split()[0] in low for m in CHALLENGES):
        return False
    visible = parse(markup).text().casefold()
    return any(m in visible for m in CHALLENGES)


def zoned(text: str, zone: str) -> datetime | None:
    """A date or time text as UTC; without an own zone it is meant in ``zone``."""
    try:
        at = parse_time(text.strip())
        return (at if at.utcoffset() is not None else at.replace(tzinfo=ZoneInfo(zone))).astimezone(UTC)
    except (OverflowError, TypeError, ValueError):
        return None


def _longest(texts: list[str]) -> str:
    return max((t for t in texts if t), key=len, default="")


def _distinct(entries: Iterator[Entry | None]) -> list[Entry]:
    seen: dict[str, Entry] = {}
    for e in entries:
        if e and e[0] and e[1] and e[2]:
            seen.setdefault(e[1], e)
    return list(seen.values())


def link_cards(markup: str, base: str, hosts: set[str]) -> list[Entry]:
    """Links to news whose card holds a heading, a time and paragraphs."""
    cards = [a for a in parse(markup).all("a") if "/news/" in a.attrs.get("href", "")]
    if not cards:
        raise PageStructureError("news cards missing")

    def entry(card: Node) -> Entry | None:
        head, when = card.first("h2"), card.first("time")
        if head is None or when is None:
            return None
        return head.text(), allowed_url(card.attrs["href"], base, hosts), zoned(when.text(), PACIFIC), _longest([p.text() for p in card.all("p")])

    return _distinct(entry(c) for c in cards)


def dated_links(markup: str, base: str, hosts: set[str]) -> list[Entry]:
    """Several links per article, below an element that shows a date."""
    groups: dict[str, list[Node]] = {}
    for a in parse(markup).all("a"):
        url = allowed_url(a.attrs.get("href"), base, hosts)
        path = re.sub(r"^https://[^/]*|[?].*$", "", url or "")
        if "/blog/" in path and path.rstrip("/") != "/blog":
            groups.setdefault(url, []).append(a)
    if not groups:
        raise PageStructureError("article links missing")

    def context(a: Node) -> tuple[Node, str] | None:
        for p in a.parents():
            if found := re.search(MONTH_DAY, p.text()):
                return p, found[0]
            if p.name in ("body", "html"):
                return None
        return None

    def entry(url: str, links: list[Node]) -> Entry | None:
        place = next((c for a in links if (c := context(a))), None)
        if place is None:
            return None
        around, date = place
        names = [h.text() for a in links for h in a.all("h1", "h2", "h3")] + [a.text() for a in links]
        title = _longest([n for n in names if n.casefold() not in GENERIC_LINKS])
        paras = [p.text() for p in around.all("p")]
        about = [p for p in paras if p != title and date.casefold() not in p.casefold() and p.casefold() not in GENERIC_LINKS]
        return title, url, zoned(date, PACIFIC), _longest(about)

    return _distinct(entry(u, a) for u, a in groups.items())


def hero_cards(markup: str, base: str, hosts: set[str]) -> list[Entry]:
    """Cards of one class, with the date somewhere in their text."""
    cards = [a for a in parse(markup).all("a") if a.has_class("ds-news-hero-card") and "href" in a.attrs]
    if not cards:
        raise PageStructureError("hero cards missing")

    def entry(card: Node) -> Entry | None:
        head, date = card.first("h2"), re.search(LONG_MONTH_DAY, card.text())
        if head is None or date is None:
            return None
        title = head.text()
        paras = [p.text() for p in card.all("p")]
        about = [p for p in paras if p != title and date[0].casefold() not in p.casefold()]
        return title, allowed_url(card.attrs["href"], base, hosts), zoned(date[0], CHINA), _longest(about)

    return _distinct(entry(c) for c in cards)


def post_articles(markup: str, base: str, hosts: set[str]) -> list[Entry]:
    """Newsroom posts that name the brand."""
    cards = [n for n in parse(markup).all("article") if n.attrs.get("id", "").startswith("post-")]
    if not cards:
        raise PageStructureError("newsroom posts missing")

    def entry(card: Node) -> Entry | None:
        link = next((a for h in card.all("h2") if h.has_class("blog-title") for a in h.all("a") if "href" in a.attrs), None)
        when = next((n for n in card.walk() if n.has_class("tc-blogpost-date")), None)
        if link is None or when is None or not re.search(POST_BRAND, card.text()):
            return None
        date = re.search(CJK_DATE, when.text())
        title = link.text()
        about = _longest([t for p in card.all("p") if (t := p.text()) != title])
        return (title, allowed_url(link.attrs["href"], base, hosts), zoned("-".join(date.groups()), CHINA), about) if date else None

    return _distinct(entry(c) for c in cards)


Scanner = Callable[[str, str, set[str]], list[Entry]]

# Adapter names of the manifest, with their scanner and hosts; those without one are read by ``embedded``.
ADAPTERS: dict[str, tuple[Scanner | None, set[str]]] = {
    "anthropic_news": (link_cards, {"anthropic.com", "www.anthropic.com"}),
    "meta_ai_blog": (dated_links, {"ai.meta.com"}),
    "deepseek_news": (hero_cards, {"deepseek.com", "www.deepseek.com"}),
    "zhipu_releases": (None, {"docs.bigmodel.cn"}),
    "minimax_releases": (None, {"minimaxi.com", "platform.minimaxi.com", "www.minimaxi.com"}),
    "tencent_hunyuan": (post_articles, {"tencent.com", "www.tencent.com"}),
    "volcengine_doubao": (None, {"volcengine.com", "www.volcengine.com"}),
    "baidu_ernie": (None, {"cloud.baidu.com"}),
}


def entries_of(markup: str, adapter: str, base: str) -> list[Entry]:
    """Entries of one index page; raises where the page is a challenge or has another structure."""
    if is_challenge(markup):
        raise PageStructureError("challenge page")
    scanner, hosts = ADAPTERS[adapter]
    return scanner(markup, base, hosts)


def scan_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """(source_id, pos, title, url, published_at, excerpt, error) of index pages (source_id, payload).

    A page that cannot be read gives one row with the error and nothing else. Pages that carry their entries as JSON or as
    components of a text are read by expressions (``embedded``), all others in an Arrow function.
    """
    from tidewire.sources import embedded  # which takes its patterns from here

    native = {
        "volcengine_doubao": embedded.router_pages, "baidu_ernie": embedded.listing_pages,
        "zhipu_releases": embedded.update_pages, "minimax_releases": embedded.card_pages,
    }
    d = pages.join(specs.where("kind = 'official_page'").select(F.col("id").alias("source_id"), "adapter", F.col("url").alias("base")), "source_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, markup, adapter, base in pdf[["source_id", "payload", "adapter", "base"]].itertuples(index=False):
                try:
                    found = entries_of(markup or "", adapter, base)
                    out += [(source, n, *e[:2], e[2].replace(tzinfo=None), e[3], None) for n, e in enumerate(found)]
                except (PageStructureError, KeyError) as error:
                    out.append((source, None, None, None, None, None, type(error).__name__))
            yield pd.DataFrame(out, columns=["source_id", "pos", "title", "url", "at", "excerpt", "error"]).astype({"pos": "Int32", "at": "datetime64[us]"})

    rest = d.where(~F.col("adapter").isin(list(native)) | F.col("adapter").isNull())
    found = rest.select("source_id", "payload", "adapter", "base").mapInPandas(run, "source_id string, pos int, title string, url string, at timestamp_ntz, excerpt string, error string")
    found = found.withColumn("published_at", F.to_timestamp(F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))).drop("at")
    listed = specs.where("kind = 'official_page'").select("adapter").distinct().collect()  # no more than there are scanners
    for adapter in sorted({r["adapter"] for r in listed} & native.keys()):
        found = found.unionByName(native[adapter](d.where(F.col("adapter") == adapter), ADAPTERS[adapter][1]))
    return found


def page_items(entries: DataFrame, details: DataFrame, specs: DataFrame) -> DataFrame:
    """Raw items of index entries; short ones take their excerpt from the first few detail pages (url, payload)."""
    e = entries.where(F.col("error").isNull() & (F.col("pos") < MAX_INDEX)).withColumn("short", F.length("excerpt") < MIN_EXCERPT)
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "short").orderBy("pos")))
    e = e.where(~F.col("short") | (F.col("_n") <= MAX_DETAILS))
    extra = details.select("url", detail_excerpt("payload").alias("more")).dropDuplicates(["url"])
    d = e.join(extra, "url", "left").withColumn("excerpt", F.when(F.col("short"), F.col("more")).otherwise(F.col("excerpt")))
    d = d.where(F.length("excerpt") >= MIN_EXCERPT)
    return with_source(d.select("source_id", "title", "url", "published_at", "excerpt"), specs)


def _linked_data(root: Node) -> Iterator[dict]:
    for s in root.all("script"):
        if s.attrs.get("type") != "application/ld+json":
            continue
        try:
            todo = [json.loads(s.raw())]
        except ValueError:
            continue
        while todo:
            value = todo.pop(0)
            if isinstance(value, list):
                todo = value + todo
            elif isinstance(value, dict):
                kinds = value.get("@type")
                kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
                if any(isinstance(k, str) and k.casefold() in ("article", "newsarticle") for k in kinds):
                    yield value
                if isinstance(value.get("@graph"), (list, dict)):
                    todo.insert(0, value["@graph"])


def _meta(root: Node, key: str) -> str:
    for attr in ("property", "name"):
        tag = next((m for m in root.all("meta") if m.attrs.get(attr) == key), None)
        if tag is not None and "content" in tag.attrs:
            return clean_text(tag.attrs["content"])
    return ""


def article_excerpt(markup: str) -> str:
    """The best description of an article: long metadata, then paragraphs, then short metadata."""
    root = parse(markup)
    named = [_meta(root, k) for k in ("og:description", "description", "twitter:description")]
    linked = [clean_text(a.get("description")) for a in _linked_data(root)]
    paras = root.all("p")
    body = [p for p in paras if p.inside("article") and any(n.has_class("entry-content") for n in p.parents())]
    body += [p for p in paras if p.inside("article")] + [p for p in paras if p.inside("main")]
    if (head := root.first("h1")) is not None:
        order = list(root.walk())
        body += [n for n in order[order.index(head) :] if n.name == "p"]
    for text in [*named, *linked]:
        if len(text) >= MIN_EXCERPT:
            return text
    for p in body:
        if len(text := p.text()) >= MIN_EXCERPT:
            return text
    short = [t for t in named if t]
    return short[-1] if short else next((t for t in linked if t), "")


def article_metadata(markup: str) -> tuple[str, datetime, str] | None:
    """(title, published, excerpt) from linked data or meta tags; needs an explicit zoned time."""

    def aware(value: object) -> datetime | None:
        try:
            at = parse_time(value.strip())
        except (AttributeError, OverflowError, TypeError, ValueError):
            return None
        return at.astimezone(UTC) if at.utcoffset() is not None else None

    root = parse(markup)
    for a in _linked_data(root):
        title, at = clean_text(a.get("headline") or a.get("name")), aware(a.get("datePublished"))
        if title and at:
            return title, at, clean_text(a.get("description"))
    title, at = _meta(root, "og:title") or _meta(root, "twitter:title"), aware(_meta(root, "article:published_time"))
    return (title, at, article_excerpt(markup)) if title and at else None


@F.pandas_udf(T.StringType())
def detail_excerpt(pages: pd.Series) -> pd.Series:
    """Excerpt of a detail page; null for a challenge."""
    return pages.map(lambda p: None if p is None or is_challenge(p) else article_excerpt(p))


def articles(pages: DataFrame) -> DataFrame:
    """(url, title, published_at, excerpt) of article pages (url, payload) that carry a title and a zoned time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(u, m[0], m[1].replace(tzinfo=None), m[2]) for u, p in pdf[["url", "payload"]].itertuples(index=False) if p and (m := article_metadata(p))]
            yield pd.DataFrame(out, columns=["url", "title", "at", "excerpt"]).astype({"at": "datetime64[us]"})

    found = pages.select("url", "payload").mapInPandas(run, "url string, title string, at timestamp_ntz, excerpt string")
    return found.withColumn("published_at", F.to_timestamp(F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))).drop("at")


def challenge(markup):
    """Native form of ``is_challenge``: markers in the text outside tags, or the one that counts anywhere."""
    low = F.lower(markup)
    visible = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"(?s)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " "), r"(?s)<[^>]*>", " "), r"\s+", " ")
    hit = low.contains(CHALLENGE_ANYWHERE)
    for m in CHALLENGES:
        hit = hit | visible.contains(m)
    return hit

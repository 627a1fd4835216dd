"""Index pages that carry their entries as JSON in a script or as components of a Markdown text, read without leaving the JVM.

Fields of JSON pages change case, type and presence, so nothing is declared: a field is taken as VARIANT by
path from whatever the page holds, and counts as text only where it is a string. A page whose JSON or
components are missing, broken or of another structure gives one row with an error, as the other scanners do.

Times are ISO dates or times with or without a zone, also with slashes or a space, and dates with the English name of a month;
others make no entry. Links are addresses or paths from the site's root.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import MAX_EXCERPT
from tidewire.sources import pages

# Where the pages keep their JSON, and the names that a field goes by, the first that holds something counts.
ROUTER_MARK = r"(?s)window\._ROUTER_DATA\s*=\s*(\{.*?\})\s*;?\s*</script>"
ROUTER_PAGE = "$.loaderData['__ssr_without_user/news/page']"
LISTING_MARK = r"(?is)<script\b[^>]*\bid=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"
LISTING_ROWS = "$.props.pageProps.pageData.listData.result"
ROUTER_BRANDED = ["Title", "title", "Summary", "summary", "Description", "description", "TagName", "tag", "CategoryCodeName", "category"]
ROUTER_ABOUT, ROUTER_TIME, ROUTER_LINK = ["Summary", "summary", "Description", "description"], ["CreatedTime", "date", "Date", "UpdatedTime"], ["link", "Link"]
LISTING_ABOUT = ["abstract", "contentEtl", "content"]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]
TIME_FORMATS = ["yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy/M/d", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSS", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
# Components of the text pages, their attributes, links, list marks and headings.
UPDATE, CARD = r"(?is)<Update\b[^>]*>.*?</Update>", r"(?is)<Card\b[^>]*>.*?</Card>"
ATTRIBUTE = r'([A-Za-z][A-Za-z0-9_-]*)="([^"]*)"'
WEB_LINK, ANY_LINK = r"\[([^\]]+)\]\((https://[^)]+)\)", r"\[([^\]]+)\]\(([^)]+)\)"
UPDATE_MARKS, CARD_MARKS, BULLET = r"[*_`#>💬]", r"[*_`#>]", r"(?mdU)^\s*[-+]\s*"
HEADING = r"(?mdU)^##\s+(.+?)\s*$"


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,6});"), F.lit(1)))
    char_of = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    text = F.aggregate(numbers, text, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), char_of(n)))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _clean(text: Column) -> Column:
    """Text without references, tags and runs of white space; empty for null."""
    bare = F.regexp_replace(_decoded(F.coalesce(text, F.lit(""))), r"(?s)<[A-Za-z/!][^>]*>", "")
    return F.substring(F.trim(F.regexp_replace(_decoded(bare), r"(?U)\s+", " ")), 1, MAX_EXCERPT)


def _text(row: Column, name: str) -> Column:
    """A field that is a string; null for other types."""
    held = F.try_variant_get(row, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(row, f"$.{name}", "string"))


def _filled(row: Column, name: str) -> Column:
    """Whether a field holds something: not null, false, zero or empty."""
    shown = F.to_json(F.try_variant_get(row, f"$.{name}", "variant"))
    return F.coalesce(~shown.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _first(row: Column, names: list[str]) -> Column:
    """The text of the first field that holds something, whatever that is."""
    found = F.lit(None).cast("string")
    for name in reversed(names):
        found = F.when(_filled(row, name), _text(row, name)).otherwise(found)
    return found


def _number(row: Column, name: str) -> Column:
    """An identifier: a string or whole number, but no boolean; empty otherwise."""
    held = F.schema_of_variant(F.try_variant_get(row, f"$.{name}", "variant"))
    return F.coalesce(F.when(held.isin("STRING", "BIGINT"), F.trim(F.try_variant_get(row, f"$.{name}", "string"))), F.lit(""))


def _zoned(text: Column, zone: str) -> Column:
    """A time in UTC; without a zone of its own it is meant in ``zone``."""
    own = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.replace(text, F.lit(" "), F.lit("T"))))
    local = F.coalesce(*[F.try_to_timestamp(F.when(~text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") | (F.length(text) <= 10), text), F.lit(f)) for f in TIME_FORMATS])
    return F.coalesce(own, F.to_utc_timestamp(local, zone))


def _allowed(link: Column, base: Column, hosts: set[str]) -> Column:
    """An https address on one of the hosts: a path is taken from the page's site; without fragment."""
    site = F.regexp_extract(base, r"^(https://[^/?#]+)", 1)
    link = F.trim(link)
    whole = F.when(link.rlike(r"^/[^/]"), F.concat(site, link)).when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(link)
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"^(?i:https)://([^/?#:@]+)(?::443)?(?:[/?#]|$)", 1)), r"\.+$", "")
    bare = F.regexp_replace(F.regexp_replace(whole, "#.*$", ""), r"^(?i:https)://", "")
    at = F.regexp_extract(bare, r"^([^/?]*)", 1)
    rest = F.substring(bare, F.length(at) + 1, F.length(bare))
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    return F.when(host.isin(sorted(hosts)), F.concat(F.lit("https://"), F.lower(at), F.when(path == "", "/").otherwise(path), F.regexp_replace(rest, r"^[^?]*", "")))


def _scanned(staged: DataFrame, state: Column, rows_of, entry_of) -> DataFrame:
    """Entries in page order, each address once, or one row with the error of a page; nothing is shuffled."""
    d = staged.select("source_id", "payload", "base", state.alias("state")).withColumn("rows", rows_of(F.col("state")))
    wrong = F.col("rows").isNull() | F.coalesce(pages.challenge(F.col("payload")), F.lit(True))
    made = F.filter(F.transform("rows", lambda row: F.struct(*entry_of(row, F.col("base")))), lambda e: (e["title"] != "") & e["url"].isNotNull() & e["published_at"].isNotNull())
    # arrays of one bind the entries and their addresses once
    once = F.transform(F.array(made), lambda es: F.transform(F.array(F.transform(es, lambda e: e["url"])), lambda us: F.filter(es, lambda e, i: F.array_position(us, e["url"]) == i + 1))[0])[0]
    error = F.when(wrong, F.lit(pages.PageStructureError.__name__))
    d = d.select("source_id", F.when(~wrong, once).alias("entries"), error.alias("error"))
    d = d.select("source_id", "error", F.posexplode_outer("entries").alias("pos", "e")).where("e is not null or error is not null")
    return d.select("source_id", "pos", "e.title", "e.url", "e.excerpt", "error", "e.published_at")


def _object(row: Column) -> Column:
    return F.coalesce(F.schema_of_variant(row).startswith("OBJECT"), F.lit(False))


def router_pages(staged: DataFrame, hosts: set[str]) -> DataFrame:
    """A banner and a list in the page's embedded router state; ``staged`` has source_id, payload and base, the page's address."""

    def rows(state: Column) -> Column:
        listed = F.try_variant_get(state, f"{ROUTER_PAGE}.listOnlineArticle.List", "array<variant>")
        banner = F.try_variant_get(state, f"{ROUTER_PAGE}.banner", "variant")
        return F.filter(F.concat(F.array(banner), listed), _object)

    def entry(row: Column, base: Column) -> list[Column]:
        title, number = _clean(_first(row, ["Title", "title"])), _number(row, "DocumentID")
        branded = _clean(F.concat_ws(" ", *[_text(row, k) for k in ROUTER_BRANDED])).rlike(pages.ROUTER_BRAND)
        link = F.when(number != "", F.concat(F.lit("/news/detail/"), number)).otherwise(_first(row, ROUTER_LINK))
        when = _zoned(_clean(_first(row, ROUTER_TIME)), pages.CHINA)
        return [F.when(branded, title).alias("title"), _allowed(link, base, hosts).alias("url"), when.alias("published_at"), _clean(_first(row, ROUTER_ABOUT)).alias("excerpt")]

    return _scanned(staged, F.try_parse_json(F.regexp_extract("payload", ROUTER_MARK, 1)), rows, entry)


def listing_pages(staged: DataFrame, hosts: set[str]) -> DataFrame:
    """A news list in the page's embedded data script; ``staged`` has source_id, payload and base, the page's address."""

    def rows(state: Column) -> Column:
        return F.filter(F.try_variant_get(state, LISTING_ROWS, "array<variant>"), _object)

    def entry(row: Column, base: Column) -> list[Column]:
        title, number, about = _clean(_text(row, "title")), _number(row, "newsId"), _clean(_first(row, LISTING_ABOUT))
        branded = _clean(F.concat_ws(" ", _text(row, "title"), _first(row, LISTING_ABOUT), _text(row, "keywords"))).rlike(pages.LISTING_BRAND) & (number != "")
        url = _allowed(F.concat(F.lit("/news/news_"), number), base, hosts)
        return [F.when(branded, title).alias("title"), url.alias("url"), _zoned(_clean(_text(row, "time")), pages.CHINA).alias("published_at"), about.alias("excerpt")]

    return _scanned(staged, F.try_parse_json(F.regexp_extract("payload", LISTING_MARK, 1)), rows, entry)


def _attribute(component: Column, name: str) -> Column:
    """An attribute of a component's tag; the last one if it is repeated."""
    tag = F.regexp_extract(component, r"(?s)^<[A-Za-z]+([^>]*)>", 1)
    names = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1))
    return F.try_element_at(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), lambda v, i: F.get(names, i) == name), F.lit(-1))


def _body(component: Column) -> Column:
    return F.regexp_extract(component, r"(?s)^<[^>]*>(.*)</[A-Za-z]+>$", 1)


def update_pages(staged: DataFrame, hosts: set[str]) -> DataFrame:
    """``<Update label=date description=title>`` components that name a release and link to it."""

    def rows(page: Column) -> Column:
        found = F.regexp_extract_all(page, F.lit(UPDATE), F.lit(0))
        return F.when(F.size(found) > 0, found)

    def entry(row: Column, base: Column) -> list[Column]:
        title, body = _clean(_attribute(row, "description")), _body(row)
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, WEB_LINK, "$1"), UPDATE_MARKS, " "), BULLET, "")
        link, when = F.regexp_extract(body, WEB_LINK, 2), _zoned(F.trim(_attribute(row, "label")), pages.CHINA)
        return [F.when(title.rlike(pages.UPDATE_TITLE), title).alias("title"), _allowed(link, base, hosts).alias("url"), when.alias("published_at"), _clean(plain).alias("excerpt")]

    return _scanned(staged, F.col("payload"), rows, entry)


def card_pages(staged: DataFrame, hosts: set[str]) -> DataFrame:
    """``<Card title href>`` components below headings that are full dates."""

    def rows(page: Column) -> Column:
        headings, sections = F.regexp_extract_all(page, F.lit(HEADING), F.lit(1)), F.split(page, HEADING, -1)
        dates = F.transform(headings, lambda h: F.regexp_replace(F.regexp_extract(h, rf"^\s*{pages.CJK_DATE}\s*$", 0), rf"^\s*{pages.CJK_DATE}\s*$", "$1-$2-$3"))
        cards = F.transform(dates, lambda d, i: F.transform(F.when(d != "", F.regexp_extract_all(F.get(sections, i + 1), F.lit(CARD), F.lit(0))), lambda c: F.struct(d.alias("date"), c.alias("card"))))
        return F.when((F.size(headings) > 0) & page.rlike(CARD), F.flatten(F.filter(cards, lambda c: c.isNotNull())))

    def entry(row: Column, base: Column) -> list[Column]:
        title = _clean(_attribute(row["card"], "title"))
        about = _clean(F.regexp_replace(F.regexp_replace(_body(row["card"]), ANY_LINK, "$1"), CARD_MARKS, " "))
        url = _allowed(_attribute(row["card"], "href"), base, hosts)
        return [F.when(title.rlike(pages.CARD_TITLE), title).alias("title"), url.alias("url"), _zoned(row["date"], pages.CHINA).alias("published_at"), about.alias("excerpt")]

    return _scanned(staged, F.col("payload"), rows, entry)

"""Main text of web pages by deducing the template that the pages of a host share.

Tokens are elements, named by the path of tags, classes and ids that leads to them, and texts
between two tags. Tokens of one host with the same occurrence vector, that is, as often
as each other on every page, form an equivalence class. Vectors are never gathered: a
token's vector is kept as its number of pages and two sums of a hash of page and
count, which tasks combine before any shuffle. Classes are valid where they hold an
element and something else, on several different pages, and nest: what they hang
on is in themselves and in one other valid class. The valid classes, nested from the
root down, are the host's template; what is left between its tokens are slots.

Of the slots the article's is the one below the deepest template element that still
holds most of the host's running text, or below a template ``article`` or ``main`` that holds half. Menus, headers, footers, sidebars,
notices, adverts, forms and comments are known by their elements, roles, classes and ids;
slots of links alone are menus; texts of valid classes are the template's own words,
unless they make up much of the slot, as in copies of one article.
Running text and links are summed over all pages of the host, so a page with one word
finds its article as well as a long one. A page whose own ``article`` or ``main`` lies inside the
slot is narrowed to it.

Hosts with fewer than ``MIN_PAGES`` different pages are deduced together; of their texts none is
taken for template. A token counts in a template if it is on one page in ``SHARE``, so a template has at most
``SHARE`` times the tokens of an average page and may be read whole by one task; no page is left out. Pages meet their template in
a join by host that adaptive execution can split; Spark broadcasts templates while they are small.

Text: character references are decoded as HTML has them, white space of a block (``br``
too) becomes one space, blocks are joined by one line feed.

Edge cases: null or empty html gives an empty text; a null or odd url counts with the small hosts; repeated
pages get equal texts and do not make a token look shared; markup may break off anywhere; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

import html
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.markup import ARTICLE, BLOCK, CHROME, HEADING, ROOT, read, token
from tidewire.plans.materialize import cut, settled

#: Different pages that a host or a class needs, least part of a host's pages that a template token is on, tokens held by a task at once.
MIN_PAGES, SHARE, HELD_TOKENS = 4, 50, 100_000
#: Part of the running text that a deeper element must hold, an article or main must hold, and part of links that makes a menu.
DEEPER, ENOUGH, LINKED = 0.8, 0.5, 0.8
#: Most of the slot's running text that may be the template's own words.
FIXED = 0.2
TEXT = "#text"
TOKENS = "host string, token long, parent long, name string, flags long, n long, v1 long, v2 long, pages long, chars long, links long"
SUMS = ("n", "v1", "v2", "chars", "links")


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_tokens(markup: str) -> dict[int, list]:
    """Tokens of one page: [parent, name, flags, count, characters of running text, of links]."""
    elements, pieces = read(markup)
    out: dict[int, list] = {}
    for e in elements:
        if e.path in out:
            out[e.path][3] += 1
        else:
            out[e.path] = [elements[e.up].path if e.up >= 0 else 0, e.name, e.flags | CHROME * e.chrome, 1, 0, 0]
    order = list(out)
    for _, raw, at in pieces:
        e = elements[at]
        if e.chrome or not (text := " ".join(raw.split())):
            continue
        out[e.path][5 if e.link else 4] += len(text)
        own = out.setdefault(token(e.path, TEXT + text), [e.path, TEXT, 0, 0, 0, 0])
        own[3] += 1
        own[4] += len(text)
    for p in order[:0:-1]:  # children come after their parents
        up = out[out[p][0]]
        up[4] += out[p][4]
        up[5] += out[p][5]
    return out


def host_tokens(pages: DataFrame) -> DataFrame:
    """One row per host and token with the sums over the host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (0, 3) else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in TOKENS.split(", ")])

        for b in batches:
            for h, markup in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                markup = markup.as_py() or ""
                page = xxhash.xxh64_intdigest(markup.encode("utf-8", "surrogatepass"))
                for t, (up, name, flags, n, chars, links) in page_tokens(markup).items():
                    v = xxhash.xxh64_intdigest(b"%d:%d" % (page, n))
                    got = held.get((h, t))
                    if got is None:
                        held[h, t] = [up, name, flags, 1, v >> 33, v & 0x7FFFFFFF, 1 << page % 63, chars, links]
                    else:
                        got[3] += 1
                        got[4] += v >> 33
                        got[5] += v & 0x7FFFFFFF
                        got[6] |= 1 << page % 63
                        got[7] += chars
                        got[8] += links
                if len(held) >= HELD_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return _summed(pages.select("host", "html").mapInArrow(run, TOKENS))


def _summed(rows: DataFrame) -> DataFrame:
    own = [F.max(c).alias(c) for c in ("parent", "name", "flags")]
    return rows.groupBy("host", "token").agg(*own, *[F.sum(c).alias(c) for c in SUMS], F.bit_or("pages").alias("pages"))


def template(tokens: pd.DataFrame) -> tuple[list[int], list[int]]:
    """(elements that lead to the article's slot, from the root down; tokens to drop) of one host's valid classes."""
    rows = {r.token: r for r in tokens.itertuples(index=False)}
    cls = {t: (r.n, r.v1, r.v2) for t, r in rows.items()}
    above: dict[tuple, set] = {}
    for t, r in rows.items():
        if t != ROOT and cls.get(r.parent) != cls[t]:
            above.setdefault(cls[t], set()).add(cls.get(r.parent))
    nested: dict[tuple, bool] = {cls[ROOT]: True}
    for c in set(cls.values()):
        way = []
        while c is not None and c not in nested and c not in way:
            way.append(c)
            ups = above.get(c, set())
            c = next(iter(ups)) if len(ups) == 1 else None
        nested |= dict.fromkeys(way, c is not None and nested.get(c, False))
    valid = {t: r for t, r in rows.items() if nested[cls[t]]}
    kids: dict[int, list] = {}
    for t, r in valid.items():
        if t != ROOT and r.name != TEXT:
            kids.setdefault(r.parent, []).append(r)

    def to_root(t: int) -> list[int]:
        way = [t]
        while way[-1] != ROOT:
            way.append(valid[way[-1]].parent)
        return way[::-1]

    open_kids = {t: [r for r in k if not r.flags & CHROME] for t, k in kids.items()}
    ways = {r.token: to_root(r.token) for k in open_kids.values() for r in k if r.flags & ARTICLE and r.chars >= ENOUGH * rows[ROOT].chars > 0}
    if ways:
        chain = min(ways.values(), key=lambda w: (len(w), -rows[w[-1]].chars, w[-1]))
    else:
        chain = [ROOT]
        while below := open_kids.get(chain[-1]):
            best = max(below, key=lambda r: (r.chars, -r.token))
            if best.chars < DEEPER * rows[chain[-1]].chars or not best.chars or any(r.flags & HEADING and r is not best for r in below):
                break
            chain.append(best.token)
    menus = [t for t, r in valid.items() if t not in chain and r.name in BLOCK and r.links and r.links >= LINKED * (r.links + r.chars)]
    texts = [r for r in valid.values() if r.name == TEXT and chain[-1] in to_root(r.parent)]
    own_words = sum(r.chars for r in texts) <= FIXED * rows[chain[-1]].chars  # otherwise the pages are copies of each other
    return chain, menus + [r.token for r in texts if own_words]


def templates(tokens: DataFrame) -> DataFrame:
    """(host, chain, gone): the template of every host with enough different pages, and of all others under the host ''."""
    tokens = cut(tokens.where((F.col("name") != TEXT) | (F.bit_count("pages") >= MIN_PAGES)), "pt-tokens")
    large = tokens.where((F.col("token") == ROOT) & (F.bit_count("pages") >= MIN_PAGES) & (F.col("host") != "")).select("host")
    own = tokens.join(large, "host", "left_semi")
    rest = tokens.join(large, "host", "left_anti").where(F.col("name") != TEXT).withColumn("host", F.lit(""))
    both = cut(own.select(*tokens.columns).unionByName(_summed(rest).select(*tokens.columns)), "pt-hosts")
    sizes = both.where(F.col("token") == ROOT).select("host", F.col("n").alias("all"))
    often = both.join(sizes, "host").where((F.col("n") * SHARE >= F.col("all")) & ((F.bit_count("pages") >= MIN_PAGES) | (F.col("n") == F.col("all"))))
    vector = ["host", "n", "v1", "v2"]
    element = F.max((F.col("name") != TEXT).cast("int"))
    classes = often.groupBy(*vector).agg(F.count("*").alias("size"), element.alias("element")).where("size > 1 and element = 1").select(*vector)
    held = often.join(classes, vector).select("host", "token", "parent", "name", "flags", "n", "v1", "v2", "chars", "links")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chain, gone = template(rows)
        return pd.DataFrame({"host": [key[0]], "chain": [chain], "gone": [gone]})

    return held.groupBy("host").applyInPandas(run, "host string, chain array<long>, gone array<long>")


def extract(markup: str, chain: list[int], gone: set[int]) -> str:
    """The article's text of one page under a template."""
    elements, pieces = read(markup)
    depth = {p: i for i, p in enumerate(chain)}
    level, dropped = [], []
    for e in elements:
        level.append(depth[e.path] if e.path in depth else level[e.up] if e.up >= 0 else 0)
        dropped.append(e.chrome or e.path in gone or e.up >= 0 and dropped[e.up])
    deepest = max((k for k, e in zip(level, elements, strict=True) if not e.chrome), default=0)
    kept = [x for x in pieces if level[x.at] >= deepest and not dropped[x.at]]
    if gone:
        kept = [x for x in kept if token(elements[x.at].path, TEXT + " ".join(x.raw.split())) not in gone]
    own = [x for x in kept if elements[x.at].article]
    if sum(len(x.raw) for x in own) >= ENOUGH * sum(len(x.raw) for x in kept):
        kept = own
    blocks: dict[int, list[str]] = {}
    for x in kept:
        blocks.setdefault(x.block, []).append(x.raw)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""

    def build() -> DataFrame:
        held = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
        found = cut(templates(host_tokens(held)), "pt-templates")
        pooled = found.where("host = ''").first()  # one row, as large as a template can be
        common = (pooled.chain, set(pooled.gone)) if pooled else ([ROOT], set())
        met = held.join(found.where("host <> ''"), "host", "left").select("page_id", "url", "host", "html", "chain", "gone")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, tuple[list[int], set[int]]] = {}
            for b in batches:
                texts = []
                for name, markup, chain, gone in zip(b.column(2).to_pylist(), b.column(3), b.column(4), b.column(5), strict=True):
                    if not chain.is_valid:
                        chosen = common
                    elif name in known:
                        chosen = known[name]
                    else:
                        if len(known) > 1000:
                            known.clear()
                        chosen = known[name] = (chain.as_py(), set(gone.as_py()))
                    texts.append(extract(markup.as_py() or "", *chosen))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        kinds = {f.name: f.dataType.simpleString() for f in met.schema}
        return met.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")

    return settled(build, "pagetext")


def op11_pages(spark, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: For these tables only, whose pages hold one article each: its paragraphs and headings, without other markup.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split_regex(body, '</?(p|h1)>') AS parts FROM a),
c AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(
      regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM b),
d AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""

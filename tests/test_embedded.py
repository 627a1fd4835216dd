import json
import random
import re

from pyspark.sql import functions as F

from tidewire.functions.text import clean_text
from tidewire.functions.urls import allowed_url
from tidewire.sources import embedded, pages

HOSTS = {"volcengine.com", "www.volcengine.com"}
BASE = "https://www.volcengine.com/n"


def router(rows, banner=None, tail=";"):
    state = {"loaderData": {"__ssr_without_user/news/page": {"banner": banner, "listOnlineArticle": {"List": rows}}}}
    return f"<html><script>window._ROUTER_DATA = {json.dumps(state, ensure_ascii=False)}{tail}</script><p>rest</p>"


def listing(rows):
    return f'<script type="a" id="__NEXT_DATA__">{json.dumps({"props": {"pageProps": {"pageData": {"listData": {"result": rows}}}}}, ensure_ascii=False)}</script>'


def odd(rng, *good):
    return rng.choice([*good, *good, None, "", 0, 7, True, [], {}, ["x"], {"a": 1}])


def some_pages(kind, n=120):
    rng = random.Random(n)
    out = []
    for i in range(n):
        rows = []
        for j in range(rng.randrange(5)):
            when = odd(rng, "2026-07-25", "2026-07-25 10:30:00", "2026-07-25T10:30:00Z", "2026-07-25T10:30:00+02:00", "2026/7/5", "soon")
            text = odd(rng, "About &lt;b&gt;豆包&lt;/b&gt; 文心 &#35937; x", "  two   words ", "ARK<br>ERNIE")
            r = {"CreatedTime": when, "time": when, "Summary": text, "description": odd(rng, "d"), "abstract": text, "content": odd(rng, "c")}
            r |= {rng.choice(["Title", "title"]): odd(rng, f"Doubao {j}", f"文心 {j} &amp; more", "cars")} | {"DocumentID": odd(rng, j, f" {j} ", 1.5), "newsId": odd(rng, j, f"{j}"), "link": odd(rng, "/a#x", "https://WWW.volcengine.com/b?c", "https://other.org/", "//volcengine.com/z")}
            rows.append(rng.choice([r, r, r, r, "text", None, 5]))
        page = router(rows, rng.choice([None, {}, {"title": "豆包", "link": "/b", "date": "2026-07-01"}, "x"]), rng.choice([";", "", " ;\n"])) if kind == "router" else listing(rows)
        out.append(rng.choice([page] * 9 + [page[:-40], "<html></html>", "Please verify you are human", page.replace("[", "{"), ""]))
    return out


def native(spark, markups, scan, base, hosts):
    df = spark.createDataFrame([(str(i), m, base) for i, m in enumerate(markups)], "source_id string, payload string, base string")
    found = scan(df, hosts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan
    return {tuple(r) for r in found.select("source_id", "pos", "title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), "excerpt", "error").collect()}


def said(row, *names):
    """The text under the first of these names that holds anything."""
    held = [row[n] for n in names if row.get(n)]
    return clean_text(held[0]) if held else ""


def rows_of(markup, mark, path):
    """All rows below a path of the JSON that starts at a mark, and what stands beside them; None where there is no such list."""
    if pages.is_challenge(markup) or mark not in markup:
        return None
    try:
        at = json.JSONDecoder().raw_decode(markup.split(mark, 1)[1].lstrip())[0]
        for name in path[:-1]:
            at = at[name]
        return (at if path[0] == "loaderData" else {}), at[path[-1]] if path[-1] != "listOnlineArticle" else at[path[-1]]["List"]
    except (KeyError, TypeError, ValueError):
        return None


def plain(markups, kind, base, hosts):
    """The entries of pages by plain loops over parsed JSON."""
    out = set()
    for i, m in enumerate(markups):
        path = ["loaderData", "__ssr_without_user/news/page", "listOnlineArticle"] if kind == "router" else ["props", "pageProps", "pageData", "listData", "result"]
        found = rows_of(m, "_ROUTER_DATA =" if kind == "router" else '"__NEXT_DATA__">', path)
        if found is None or not isinstance(found[1], list):
            out.add((str(i), None, None, None, None, None, "PageStructureError"))
            continue
        taken = set()
        for r in [found[0].get("banner"), *found[1]]:
            if not isinstance(r, dict):
                continue
            key = r.get("DocumentID" if kind == "router" else "newsId")
            key = "" if isinstance(key, bool) or not isinstance(key, (str, int)) else str(key).strip()
            if kind == "router":
                title, about, when = said(r, "Title", "title"), said(r, *embedded.ROUTER_ABOUT), said(r, *embedded.ROUTER_TIME)
                named = " ".join(clean_text(r.get(k)) for k in embedded.ROUTER_BRANDED)
                link, brand = f"/news/detail/{key}" if key else next((r[k] for k in ("link", "Link") if r.get(k)), None), pages.ROUTER_BRAND
            else:
                title, about, when = clean_text(r.get("title")), said(r, *embedded.LISTING_ABOUT), clean_text(r.get("time"))
                named, link, brand = f"{title} {about} {clean_text(r.get('keywords'))}", key and f"/news/news_{key}", pages.LISTING_BRAND
            url, at = allowed_url(link, base, hosts), pages.zoned(when, pages.CHINA)
            if title and url and at and re.search(brand, named) and url not in taken:
                out.add((str(i), len(taken), title, url, f"{at:%Y-%m-%d %H:%M:%S}", about, None))
                taken.add(url)
    return out


def test_router_pages_of_any_shape(spark):
    made = some_pages("router")
    assert native(spark, made, embedded.router_pages, BASE, HOSTS) == plain(made, "router", BASE, HOSTS)


def test_listing_pages_of_any_shape(spark):
    made = some_pages("listing", 121)
    base = "https://cloud.baidu.com/n"
    assert native(spark, made, embedded.listing_pages, base, {"cloud.baidu.com"}) == plain(made, "listing", base, {"cloud.baidu.com"})


def test_through_the_dispatch(spark):
    specs = spark.createDataFrame([("v", "official_page", "volcengine_doubao", BASE), ("b", "official_page", "baidu_ernie", "https://cloud.baidu.com/n"), ("z", "official_page", "zhipu_releases", "https://docs.bigmodel.cn/x")], "id string, kind string, adapter string, url string")
    update = '<Update label="2026-07-01" description="GLM 发布">[a](https://docs.bigmodel.cn/a)</Update>'
    staged = spark.createDataFrame([("v", router([{"Title": "ARK", "DocumentID": 1, "CreatedTime": "2026-07-01"}])), ("b", listing([{"title": "文心", "newsId": 2, "time": "2026-07-01"}])), ("z", update), ("b", "none")], "source_id string, payload string")
    got = {(r.source_id, r.url, r.error) for r in pages.scan_pages(staged, specs).collect()}
    assert got == {("v", "https://www.volcengine.com/news/detail/1", None), ("b", "https://cloud.baidu.com/news/news_2", None), ("z", "https://docs.bigmodel.cn/a", None), ("b", None, "PageStructureError")}


def text_entries(markup, kind, base, hosts):
    """The entries of a text page by plain loops; None where it has another structure."""
    parts = re.split(r"(?m)^##\s+(.+?)\s*$", markup)
    name = "Update" if kind == "update" else "Card"
    blocks = lambda text: re.findall(rf"(?is)<{name}\b([^>]*)>(.*?)</{name}>", text)
    if pages.is_challenge(markup) or not blocks(markup) or (kind == "card" and len(parts) < 3):
        return None
    dated = [(None, b) for b in blocks(markup)]
    if kind == "card":
        dates = [re.fullmatch(pages.CJK_DATE, h.strip()) for h in parts[1::2]]
        dated = [("-".join(d.groups()), b) for d, text in zip(dates, parts[2::2], strict=True) if d for b in blocks(text)]
    out = {}
    for date, (attributes, body) in dated:
        a = dict(re.findall(r'([A-Za-z][A-Za-z0-9_-]*)="([^"]*)"', attributes))
        if kind == "update":
            title, link, date, named = clean_text(a.get("description", "")), re.search(r"\[[^]]+]\((https://[^)]+)\)", body), a.get("label", ""), pages.UPDATE_TITLE
            link = link[1] if link else None
            about = re.sub(r"(?m)^\s*[-+]\s*", "", re.sub(r"[*_`#>💬]", " ", re.sub(r"\[([^]]+)]\(https://[^)]+\)", r"\1", body)))
        else:
            title, link, named = clean_text(a.get("title", "")), a.get("href"), pages.CARD_TITLE
            about = re.sub(r"[*_`#>]", " ", re.sub(r"\[([^]]+)]\([^)]+\)", r"\1", body))
        url, at = allowed_url(link, base, hosts), pages.zoned(date, pages.CHINA)
        if title and re.search(named, title) and url and at:
            out.setdefault(url, (title, url, f"{at:%Y-%m-%d %H:%M:%S}", clean_text(about)))
    return list(out.values())


def test_text_pages_of_any_shape(spark):
    rng = random.Random(8)
    titles = ["GLM 5", "新模型 &amp; more", "Office", "MiniMax M9", "H2 &lt;b&gt;x&lt;/b&gt;", "", "agent beta"]
    links = ["https://docs.bigmodel.cn/a#x", "https://docs.bigmodel.cn/a?b=1", "https://other.example/", "/m/1", "/m/2#y", "http://docs.bigmodel.cn/p", "//docs.bigmodel.cn/q", "https://u@docs.bigmodel.cn/"]
    labels = ["2026-07-24", "July 4, 2026", "2026-07-24T10:00:00Z", "2026-07-24 08:30", "soon", ""]
    bodies = ["\n- **Text** [doc]({l}) more\n+ and [two](/y)\n", "`x` [a]({l}) &lt;i&gt;q&lt;/i&gt; <b>bold</b> 💬 > z", "no link", "# Head\n\n  - [k]({l})", ""]
    heads = ["## 2026 年 7 月 24 日", "## 2026年7月2日  ", "## 2026 年 7 月", "##\n2026 年 1 月 3 日", "### 2026 年 7 月 1 日", "text"]
    updates, cards = [], []
    for _ in range(300):
        u, c = [], []
        for _ in range(rng.choice([0, 4, 8, 12])):
            title, link, body = rng.choice(titles), rng.choice(links[:2] * 3 + links[2:]).replace('/a', f'/a{rng.randrange(4)}'), rng.choice(bodies)
            u.append(f'''<{rng.choice(["Update", "update"])} {rng.choice(["", 'x=1 data-label="no" '])}label="{rng.choice(labels)}" description="{title}">{body.replace("{l}", link)}</Update>''')
            c.append(rng.choice(heads) + f'''\n<Card title="{title}" {rng.choice(["", 'title="H7" '])}href="{link}">{body.replace("{l}", link)}</Card>''' * rng.randrange(3))
        updates.append(rng.choice(["", "intro\n"]) + "\n".join(u) + rng.choice(["", "", "", "", "", "\n<Update label=", "captcha"]))
        cards.append("\n".join(c) + rng.choice(["", "\n## tail", "\n<Card title="]))
    for kind, markups, scan in (("update", updates, embedded.update_pages), ("card", cards, embedded.card_pages)):
        want = set()
        for i, m in enumerate(markups):
            found = text_entries(m, kind, "https://docs.bigmodel.cn/x", {"docs.bigmodel.cn"})
            want |= {(str(i), None, None, None, None, None, "PageStructureError")} if found is None else {(str(i), n, *e, None) for n, e in enumerate(found)}
        assert len([w for w in want if w[2]]) > 100 and len([w for w in want if w[6]]) > 20
        assert native(spark, markups, scan, "https://docs.bigmodel.cn/x", {"docs.bigmodel.cn"}) == want

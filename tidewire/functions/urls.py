"""Addresses: canonical form, digest id, host tests.

``canonical_url`` answers the common shape (ASCII, no escapes, no dot segments)
with expressions alone; only other rows go through Python.
"""

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that carry tracking only.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source"]
PATH_SAFE = "/:@!$&'()*+,;=-._~"

_SIMPLE = r"^(?i:https)://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.?(?::443)?(?:/[A-Za-z0-9/:@!$&'()*+,;=._~-]*)?(?:\?[A-Za-z0-9._~+-]*(?:=[A-Za-z0-9._~+-]*)?(?:&[A-Za-z0-9._~+-]*(?:=[A-Za-z0-9._~+-]*)?)*)?(?:#[\x21-\x7E]*)?$"
_DOTS = r"^[^?#]*/\.{1,2}(?:/|\?|#|$)"
_HTTP = r"^(?i:http)://[\x21-\x7E]*$"


def _simple(url: Column) -> Column:
    return url.rlike(_SIMPLE) & ~url.rlike(_DOTS)


def canonical_simple(url: Column) -> Column:
    """Canonical form of an address of the common shape; null for any other."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#:]+)", 1)), r"\.+$", "")
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(
        F.filter(F.split(F.when(F.regexp_extract(url, r"^([^#]*)", 1).contains("?"), query).otherwise(""), "&"), lambda x: x != ""),
        lambda x: F.struct(F.regexp_extract(x, r"^([^=]*)", 1).alias("k"), F.regexp_extract(x, r"^[^=]*=(.*)$", 1).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    out = F.concat(F.lit("https://"), host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(_simple(url), out)


def _escaped(value: str) -> bool:
    return re.fullmatch(r"(?:[^%]|%[0-9A-Fa-f]{2})*", value, re.S) is not None


def _collapse_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for n, part in enumerate(parts):
        plain = re.sub("%2e", ".", part, flags=re.I)
        if plain in (".", ".."):
            if plain == ".." and len(out) > 1:
                out.pop()
            if n == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def canonical(url: object) -> str | None:
    """Canonical form of any address, or None if it is not acceptable."""
    if not isinstance(url, str) or not url or url != url.strip() or re.search(r"[\x00-\x1f\x7f]", url):
        return None
    try:
        parts = urlsplit(url.replace("\\", "/"))
        port, host = parts.port, parts.hostname
        if parts.scheme.lower() != "https" or not host or parts.username is not None or parts.password is not None or " " in parts.netloc:
            return None
        if ":" in host:
            host = f"[{ipaddress.IPv6Address(host).compressed.lower()}]"
        else:
            host = host.encode("idna").decode("ascii").lower().rstrip(".") if not host.isascii() else host.lower().rstrip(".")
            if not host or not re.fullmatch(r"[a-z0-9._~!$&'()*+,;=-]+", host):
                return None
        if not _escaped(parts.path) or not _escaped(parts.query):
            return None
        path = _collapse_dots(parts.path or "/")
        path = re.sub(r"%[0-9A-Fa-f]{2}|[^%]", lambda m: m[0].upper() if m[0][0] == "%" else quote(m[0], safe=PATH_SAFE), path, flags=re.S)
        path = path.rstrip("/") or "/"
        pairs = parse_qsl(parts.query, keep_blank_values=True, errors="strict")
    except (UnicodeError, ValueError):
        return None
    query = urlencode(sorted(p for p in pairs if p[0].casefold() not in TRACKING))
    return urlunsplit(("https", host + (f":{port}" if port not in (None, 443) else ""), path, query, ""))


@F.pandas_udf(T.StringType())
def _canonical_udf(urls: pd.Series) -> pd.Series:
    return urls.map(canonical)


def canonical_url(url: Column) -> Column:
    """Canonical https address, or null where the address is rejected."""
    odd = ~(_simple(url) | url.rlike(_HTTP))
    return F.coalesce(canonical_simple(url), _canonical_udf(F.when(odd, url)))


def url_id(canonical_address: Column) -> Column:
    """First 16 hex digits of the SHA-256 digest."""
    return F.substring(F.sha2(canonical_address, 256), 1, 16)


def host(url: Column) -> Column:
    """Lower-cased host name of an address."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def bare_host(name: Column) -> Column:
    """A host in lower case, without final dots and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.+$", ""), r"^www\.", "")


def domain_matches(name: Column, domain: Column) -> Column:
    """Whether a host is a domain or lies under it; for a few fixed domains, ``operators.domains`` joins tables of them."""
    return (bare_host(name) == bare_host(domain)) | bare_host(name).endswith(F.concat(F.lit("."), bare_host(domain)))


def allowed_url(value: object, base: str, hosts: set[str]) -> str | None:
    """``value`` joined to ``base`` if it is https on one of the hosts; without fragment."""
    if not isinstance(value, str) or not value.strip():
        return None
    try:
        parts = urlsplit(urljoin(base, value.strip()))
        port, name = parts.port, parts.hostname
    except ValueError:
        return None
    if parts.scheme != "https" or name is None or parts.username is not None or parts.password is not None or port not in (None, 443):
        return None
    if name.casefold().rstrip(".") not in {h.casefold().rstrip(".") for h in hosts}:
        return None
    return urlunsplit(("https", parts.netloc.lower(), parts.path or "/", parts.query, ""))


def releases_url(repo: Column) -> Column:
    """Address of a repository's latest releases, from ``owner/name``."""
    enc = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    parts = F.split(repo, "/")
    return F.concat(F.lit("https://api.github.com/repos/"), enc(F.get(parts, 0)), F.lit("/"), enc(F.get(parts, 1)), F.lit("/releases?per_page=10"))


def lead_feed_urls(communities: Column) -> Column:
    """The two feeds, new and top of the day, of a list of communities."""
    root = F.concat(F.lit("https://www.reddit.com/r/"), F.array_join(communities, "+"))
    return F.array(F.concat(root, F.lit("/new/.rss?limit=100")), F.concat(root, F.lit("/top/.rss?sort=top&t=day&limit=100")))


def is_code_host(url: Column) -> Column:
    """Whether an address is one of the code host itself."""
    return F.coalesce(host(url) == "github.com", F.lit(False))


def _site_path(path: Column) -> Column:
    """A path without slashes around it; null if a part of it is a dot or two."""
    clean = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(~F.arrays_overlap(F.split(clean, "/"), F.array(F.lit("."), F.lit(".."))), clean)


def page_url(base: str, page: Column) -> Column:
    """Address of a page below ``base``, which ends in a slash; null for paths that leave it."""
    clean = _site_path(page)
    return F.when(clean == "", base).otherwise(F.concat(F.lit(base), clean, F.lit("/")))


def asset_url(base: str, asset: Column) -> Column:
    """Address of an asset; null without a name and for paths that leave the folder."""
    clean = _site_path(asset)
    return F.when(clean != "", F.concat(F.lit(f"{base}assets/"), clean))


def output_url(root: str, path: Column) -> Column:
    """Public address of an output file: index pages are named by their folder."""
    return F.concat(F.lit(root), F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"(^|/)index\.html$", "$1"))

"""Analyses of selected candidates: salvage, drift, validation and joining.

The analyzer itself is any callable from selected rows to response text; only its
responses are handled here.
"""

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import rules
from tidewire.operators import ranking
from tidewire.schema import CATEGORIES, LANES, RESEARCH, RISKS

MAX_ITEMS = 7
MAX_PER_SOURCE = 2
WRAPPERS = ["items", "rows", "analyses", "analysis", "data"]
LIMITS = {"title": 80, "summary": 160, "why_it_matters": 100, "tracking_signal": 80}
FIELDS = ["id", "title", "category", "editorial_lane", "summary", "importance", "why_it_matters", "tags", "is_official", "marketing_risk", "tracking_signal"]
ROW = "struct<id:string,title:string,category:string,editorial_lane:string,summary:string,importance:string,why_it_matters:string,tags:array<string>,is_official:string,marketing_risk:string,tracking_signal:string>"


def prompt_rows(selected: DataFrame) -> DataFrame:
    """The columns an analyzer gets to see, cut and with markup characters escaped."""

    def safe(c: Column) -> Column:
        for char, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
            c = F.replace(c, F.lit(char), F.lit(code))
        return c

    return selected.select(
        "id", safe(F.substring("title", 1, 300)).alias("title"), safe(F.substring("source_name", 1, 120)).alias("source"), "source_role",
        "published_at", safe(F.substring("excerpt", 1, 600)).alias("excerpt"), "category_hint", F.col("is_official_source").alias("is_official"),
    )


def response_text(body: Column, protocol: str) -> Column:
    """The text of a provider's response body: chat choices, or the first block if it is text."""
    if protocol == "chat":
        return F.get_json_object(body, "$.choices[0].message.content")
    return F.when(F.get_json_object(body, "$.content[0].type") == "text", F.get_json_object(body, "$.content[0].text"))


def salvage(text: str | None) -> list | None:
    """Rows of the first JSON value in a text: fences and chatter around it are passed over; wrappers are opened."""
    if text is None:
        return None
    body = text.strip()
    fence = re.fullmatch(r"```[A-Za-z0-9_-]*[ \t]*\r?\n(.*?)\r?\n?```", body, re.S)
    body = fence[1].strip() if fence else body
    decoder = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"[\[{]", body))]:
        try:
            value, _ = decoder.raw_decode(body[at:])
        except ValueError:
            continue
        if isinstance(value, dict):
            value = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), None)
        return value if isinstance(value, list) else None
    return None


@F.pandas_udf(T.StructType([T.StructField("error", T.StringType()), T.StructField("rows", T.ArrayType(T.StringType()))]))
def _salvage(values: pd.Series) -> pd.DataFrame:
    out = []
    for v in values:
        rows = salvage(v)
        readable = v is not None and (rows is not None or _has_json(v))
        out.append((None if rows is not None else "schema" if readable else "json", [json.dumps(r, ensure_ascii=False) for r in rows or []]))
    return pd.DataFrame(out, columns=["error", "rows"])


def _has_json(text: str) -> bool:
    body = text.strip()
    decoder = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"[\[{]", body))]:
        try:
            decoder.raw_decode(body[at:])
            return True
        except ValueError:
            continue
    return False


def response_rows(responses: DataFrame, text: str = "text") -> DataFrame:
    """(error, pos, row JSON) of every response; error is json or schema where it has no rows."""
    d = responses.withColumn("_s", _salvage(F.col(text)))
    return d.select(*[c for c in responses.columns], F.col("_s.error").alias("error"), F.posexplode_outer("_s.rows").alias("pos", "row"))


def normalize_drift(rows: DataFrame) -> DataFrame:
    """Analysis rows (JSON in ``row``) with texts trimmed and cut, and digits, flags and tags put right."""
    d = rows.withColumn("r", F.from_json("row", ROW))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    tags = F.transform("r.tags", trim)
    tags = F.slice(F.array_distinct(F.filter(tags, lambda t: (F.length(t) <= 50) & (t != ""))), 1, 3)
    flag = F.lower(trim(F.col("r.is_official")))
    digits = trim(F.col("r.importance"))
    return d.select(
        *[c for c in rows.columns if c != "row"],
        F.col("r.id").alias("id"),
        *[F.substring(trim(F.col(f"r.{k}")), 1, n).alias(k) for k, n in LIMITS.items()],
        F.col("r.category").alias("category"),
        F.col("r.editorial_lane").alias("editorial_lane"),
        F.when(digits.rlike("^[0-9]{1,9}$"), F.expr("try_cast(regexp_replace(r.importance, '[^0-9]', '') AS int)")).alias("importance"),
        tags.alias("tags"),
        F.when(flag.isin("true", "false"), flag == "true").alias("is_official"),
        F.col("r.marketing_risk").alias("marketing_risk"),
    )


def strict_row() -> Column:
    """Whether an analysis row keeps all bounds of a response."""
    c = F.col
    ok = (
        c("id").rlike("^[0-9a-f]{16}$")
        & F.length("title").between(1, 80)
        & c("editorial_lane").isin(LANES)
        & c("category").isin(CATEGORIES)
        & F.length("summary").between(20, 160)
        & c("importance").between(1, 10)
        & F.length("why_it_matters").between(10, 100)
        & F.size("tags").between(1, 3)
        & F.forall("tags", lambda t: F.length(t).between(1, 50) & (F.length(F.trim(t)) > 0))
        & c("is_official").isNotNull()
        & c("marketing_risk").isin(RISKS)
        & F.length("tracking_signal").between(5, 80)
    )
    return F.coalesce(ok, F.lit(False))


def response_error(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """One row with the first error of a response: schema, duplicate, unknown, or null."""
    known = selected.select("id", F.lit(True).alias("_known"))
    d = rows.withColumn("_ok", strict_row()).join(known, "id", "left")
    return d.agg(
        F.when(F.count_if(~F.col("_ok")) > 0, "schema")
        .when(F.count("*") > F.count_distinct("id"), "duplicate")
        .when(F.count_if(F.col("_known").isNull()) > 0, "unknown")
        .alias("error")
    )


def within_quota(rows: DataFrame, selected: DataFrame, per_source: int = MAX_PER_SOURCE, most: int = MAX_ITEMS) -> DataFrame:
    """In response order (``pos``): the first rows of each source, and of all."""
    d = rows.join(selected.select("id", "source_id"), "id")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).where(F.col("_n") <= per_source)
    return d.orderBy("pos").limit(most).drop("_n")


def valid_analyses(analyses: DataFrame) -> DataFrame:
    """Analyses within the stored bounds; others are dropped."""
    c = F.col
    lane = F.coalesce(c("editorial_lane"), F.when(c("category") == RESEARCH, "前沿研究").otherwise("产品工程"))
    d = analyses.withColumn("editorial_lane", lane)
    ok = (
        c("category").isin(CATEGORIES) & c("editorial_lane").isin(LANES) & F.length("summary").between(20, 1200) & c("importance").between(1, 10)
        & F.length("why_it_matters").between(10, 800) & F.size("tags").between(1, 6) & c("is_official").isNotNull()
        & c("marketing_risk").isin(RISKS) & F.length("tracking_signal").between(5, 500)
    )
    return d.where(F.coalesce(ok, F.lit(False)))


def unknown_ids(analyses: DataFrame, selected: DataFrame) -> DataFrame:
    """Ids that were never asked for, or come twice; any row here fails the run."""
    extra = analyses.join(selected, "id", "left_anti").select("id", F.lit("unknown").alias("error"))
    twice = analyses.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("error"))
    return extra.unionByName(twice)


def not_risky(role: Column, risk: Column) -> Column:
    """Whether an item may be published: risky marketing passes from primary sources only."""
    return (role == "primary") | (risk != "high")


def build_items(selected: DataFrame, analyses: DataFrame) -> DataFrame:
    """Published items: candidates with their analysis, but for risky marketing of others than primary sources."""
    a = valid_analyses(analyses)
    a = a.select("id", *[F.col(k).alias(f"a_{k}") for k in FIELDS if k not in ("id", "is_official")])
    d = selected.join(a, "id").where(not_risky(F.col("source_role"), F.col("a_marketing_risk")))
    return d.select(
        "id", "canonical_url", F.col("title").alias("original_title"), F.col("source_name").alias("source"), "source_id", "source_role", "discovery_verified",
        "published_at", *[F.col(f"a_{k}").alias(k) for k in ("title", "category", "editorial_lane", "summary", "importance", "why_it_matters", "tags")],
        F.col("is_official_source").alias("is_official"), F.col("a_marketing_risk").alias("marketing_risk"), F.col("a_tracking_signal").alias("tracking_signal"),
    )


def publishable(items: DataFrame) -> DataFrame:
    """Reasons against publishing a day's items: too few, too many, or too many of one source."""
    n = items.agg(F.count("*").alias("n"))
    bounds = n.where((F.col("n") < 1) | (F.col("n") > MAX_ITEMS)).select(F.when(F.col("n") < 1, "publication_threshold").otherwise("too_many_items").alias("reason"))
    quota = ranking.source_quota_violations(items, MAX_PER_SOURCE).select(F.concat(F.lit("source_quota:"), F.col("source_id")).alias("reason"))
    return bounds.unionByName(quota)


def has_secrets(items: DataFrame) -> DataFrame:
    """Items any of whose texts looks like a credential."""
    texts = ["title", "summary", "why_it_matters", "tracking_signal"]
    hit = F.exists("tags", lambda t: rules.has_secret(t))
    for k in texts:
        hit = hit | rules.has_secret(F.col(k))
    return items.where(hit)

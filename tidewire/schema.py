"""Schemas, enumerations and table constraints."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def struct(fields: str) -> T.StructType:
    """A struct type from ``name type`` pairs; needs no session."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Enumerations.
CATEGORIES = ["大模型", "Agent", "Coding Agent", "AI 工具", "开源项目", "论文研究"]
ROLES = ["primary", "trusted_media", "discovery"]
RUN_STATUSES = ["published", "no_eligible_content", "failed_before_publish"]
LANES = ["产品与应用", "商业与市场", "平台与政策", "产品工程", "商业趋势", "前沿研究"]
RISKS = ["low", "medium", "high"]
KINDS = ["feed", "arxiv", "github", "official_page", "reddit_rss"]
ERROR_CODES = [
    "none",
    "no_healthy_sources",
    "no_eligible_candidates",
    "configuration_failed",
    "collection_failed",
    "candidate_preparation_failed",
    "analysis_failed",
    "report_validation_failed",
    "persistence_failed",
]
#: slug, name and category of the channels, in display order
CHANNELS = [("model", "大模型"), ("agent", "Agent"), ("ai-tools", "AI 产品"), ("open-source", "开源生态"), ("industry-policy", "行业政策")]
POLICY_LANE = "平台与政策"
RESEARCH = "论文研究"

SOURCE_SPECS = struct(
    "id string, name string, kind string, url string, repo string, adapter string, communities array<string>, "
    "category string, weight int, official boolean, role string, enabled boolean"
)
RAW_ITEMS = struct(
    "source_id string, source_name string, source_weight int, title string, url string, published_at timestamp, excerpt string, "
    "category_hint string, is_official_source boolean, source_role string, discovery_verified boolean"
)
SOURCE_RUN = struct(
    "source_id string, source_name string, success boolean, item_count int, elapsed_ms int, error_type string, recent_count int, "
    "new_count int, eligible_count int, candidate_count int, selected_count int, latest_published_at timestamp"
)
RUN_RECORDS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("cutoff_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("source_runs", T.ArrayType(SOURCE_RUN)),
        T.StructField("safe_error_code", T.StringType()),
    ]
)
ANALYSIS_FIELDS = (
    "title string, category string, editorial_lane string, summary string, importance int, why_it_matters string, "
    "tags array<string>, is_official boolean, marketing_risk string, tracking_signal string"
)
ANALYSES = struct("id string, " + ANALYSIS_FIELDS)
NEWS_ITEM = struct(
    "id string, canonical_url string, original_title string, source string, source_id string, source_role string, discovery_verified boolean, "
    "published_at timestamp, title string, category string, editorial_lane string, summary string, importance int, why_it_matters string, "
    "tags array<string>, is_official boolean, marketing_risk string, tracking_signal string"
)
REPORTS = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("degraded", T.BooleanType()),
        T.StructField("candidate_count", T.IntegerType()),
        T.StructField("items", T.ArrayType(NEWS_ITEM)),
        T.StructField("source_runs", T.ArrayType(SOURCE_RUN)),
    ]
)


def _violations(df: DataFrame, key, rules: dict) -> DataFrame:
    """(key, code) for every rule that a row breaks; an unknown outcome breaks it too."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(key.cast("string").alias("key"), F.explode(broken).alias("code"))


def _repeated(df: DataFrame, key, code: str) -> DataFrame:
    return df.groupBy(key.cast("string").alias("key")).count().where("count > 1").select("key", F.lit(code).alias("code"))


def source_spec_violations(specs: DataFrame) -> DataFrame:
    """C1-C3: unique ids, locators that fit the kind, roles that fit the flags."""
    c = F.col
    has = lambda x: c(x).isNotNull() & (c(x) != "")
    rules = {
        "id_format": c("id").rlike(r"^[a-z0-9][a-z0-9-]+$"),
        "kind": c("kind").isin(KINDS),
        "weight_range": c("weight").between(1, 10),
        "category": c("category").isin(CATEGORIES),
        "role": c("role").isin(ROLES),
        "url_required": ~c("kind").isin("feed", "arxiv") | has("url"),
        "repo_required": (c("kind") != "github") | F.coalesce(c("repo").rlike(r"^[^/\s]+/[^/\s]+$"), F.lit(False)),
        "page_locator": (c("kind") != "official_page") | (F.coalesce(c("url").startswith("https://"), F.lit(False)) & has("adapter")),
        "lead_locator": (c("kind") != "reddit_rss")
        | (F.coalesce(F.size("communities") > 0, F.lit(False)) & ~c("official") & (c("weight") == 5) & (c("role") == "discovery")),
        "official_role": ~c("official") | (c("role") == "primary"),
    }
    return _violations(specs, c("id"), rules).unionByName(_repeated(specs, c("id"), "duplicate_id"))


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """C4-C5: the id is the digest of the canonical address, and fields are in range."""
    c = F.col
    rules = {
        "id_digest": c("id") == F.substring(F.sha2("canonical_url", 256), 1, 16),
        "https": c("canonical_url").startswith("https://"),
        "weight_range": c("source_weight").between(1, 10),
        "role": c("source_role").isin(ROLES),
        "category": c("category_hint").isin(CATEGORIES),
        "title": F.length(F.trim("title")) > 0,
        "published": c("published_at").isNotNull(),
    }
    return _violations(candidates, c("id"), rules)


def news_item_violations(items: DataFrame) -> DataFrame:
    """C6: bounds of a published item."""
    c = F.col
    rules = {
        "id_digest": c("id") == F.substring(F.sha2("canonical_url", 256), 1, 16),
        "summary_length": F.length("summary").between(20, 1200),
        "why_length": F.length("why_it_matters").between(10, 800),
        "importance_range": c("importance").between(1, 10),
        "tags_count": F.size("tags").between(1, 6),
        "tags_unique": F.size(F.array_distinct("tags")) == F.size("tags"),
        "tags_text": F.forall("tags", lambda t: (F.length(F.trim(t)) > 0) & (F.length(t) <= 100)),
        "risk": c("marketing_risk").isin(RISKS),
        "lane": c("editorial_lane").isin(LANES),
        "signal_length": F.length("tracking_signal").between(5, 500),
    }
    return _violations(items, c("id"), rules)


def source_run_violations(runs: DataFrame) -> DataFrame:
    """C7: success and failure carry the fields that belong to them."""
    c = F.col
    rules = {
        "success_count": ~c("success") | c("item_count").isNotNull(),
        "success_error": ~c("success") | c("error_type").isNull(),
        "failure_error": c("success") | c("error_type").isNotNull(),
        "elapsed": c("elapsed_ms") >= 0,
        "error_format": c("error_type").isNull() | c("error_type").rlike(r"^[A-Za-z][A-Za-z0-9_]{0,127}$"),
    }
    return _violations(runs, c("source_id"), rules)


def run_record_violations(records: DataFrame) -> DataFrame:
    """C8: unique source ids, and a status that agrees with the error code."""
    c = F.col
    ids = F.transform("source_runs", lambda r: r["source_id"])
    rules = {
        "status": c("status").isin(RUN_STATUSES),
        "error_code": c("safe_error_code").isin(ERROR_CODES),
        "unique_sources": F.size(F.array_distinct(ids)) == F.size(ids),
        "published_code": (c("status") != "published") | (c("safe_error_code") == "none"),
        "empty_code": (c("status") != "no_eligible_content") | (c("safe_error_code") == "no_eligible_candidates"),
        "failed_code": (c("status") != "failed_before_publish") | ~c("safe_error_code").isin("none", "no_eligible_candidates"),
    }
    return _violations(records, c("date"), rules).unionByName(_repeated(records, c("date"), "duplicate_date"))


def report_violations(reports: DataFrame) -> DataFrame:
    """C9: counts, unique sources and full provenance in current versions."""
    c = F.col
    ids = F.transform("source_runs", lambda r: r["source_id"])
    rules = {
        "version": c("schema_version").isin("1.0", "1.1", "1.2", "1.3"),
        "candidate_count": c("candidate_count") >= F.size("items"),
        "unique_sources": F.size(F.array_distinct(ids)) == F.size(ids),
        "provenance": (c("schema_version") != "1.3")
        | F.forall("items", lambda x: x["source_id"].isNotNull() & x["source_role"].isNotNull() & x["discovery_verified"].isNotNull()),
        "lane": (c("schema_version") != "1.1") | F.forall("items", lambda x: x["editorial_lane"].isNotNull()),
    }
    return _violations(reports, c("date"), rules)


def index_violations(index: DataFrame, reports: DataFrame) -> DataFrame:
    """C10: (date, item_count, path) rows agree with the dates, paths and reports."""
    c = F.col
    own = reports.select(c("date").alias("_date"), F.size("items").alias("_n"))
    j = index.join(own, c("date") == c("_date"), "left")
    rules = {
        "path": c("path") == F.concat(F.lit("data/"), F.date_format("date", "yyyy/MM/yyyy-MM-dd"), F.lit(".json")),
        "report_missing": c("_date").isNotNull(),
        "item_count": c("_n").isNull() | (c("item_count") == c("_n")),
    }
    return _violations(j, c("date"), rules).unionByName(_repeated(index, c("date"), "duplicate_date"))


def publication_violations(reports: DataFrame, records: DataFrame) -> DataFrame:
    """C11: a report's run record exists, is published and holds the same source runs."""
    c = F.col
    rec = records.select(c("date").alias("_date"), c("status").alias("_status"), F.to_json("source_runs").alias("_runs"))
    j = reports.join(rec, c("date") == c("_date"), "left")
    rules = {
        "record_missing": c("_date").isNotNull(),
        "record_status": c("_date").isNull() | (c("_status") == "published"),
        "record_runs": c("_date").isNull() | c("_runs").eqNullSafe(F.to_json("source_runs")),
    }
    return _violations(j, c("date"), rules)

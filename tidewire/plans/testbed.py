"""Raw items, reports and run records made from the benchmark tables by plain arithmetic.

The tables hold invented prose, so titles are decorated by the document's number
to make every rule fire. ``PRELUDE`` says the same in SQL.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import funnel
from tidewire.schema import CATEGORIES

NOW = "2024-01-31 00:00:00"
RUN_DATE = "2024-01-31"
#: What a scan keeps of an excerpt.
MAX_EXCERPT = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def _titles(words, n):
    return (
        F.when(n == 0, F.concat(words, F.lit(" launches Nova-"), (F.col("doc_id") % 50).cast("string")))
        .when(n == 1, F.concat(F.lit("arXiv paper on "), words))
        .when(n == 2, F.concat(F.lit("Sponsored: "), words))
        .when(n == 3, F.concat(words, F.lit(" benchmark results")))
        .when(n == 4, F.concat(words, F.lit(" v1.2."), (F.col("doc_id") % 10).cast("string"), F.lit(" patch")))
        .when(n == 5, F.concat(words, F.lit(" SDK API security access for production")))
        .when(n == 6, F.concat(words, F.lit(" raises funding")))
        .when(n == 7, F.concat(words, F.lit(" release of open models")))
        .when(n == 8, F.concat(words, F.lit(" price update")))
        .when(n == 9, F.concat(F.lit("Introducing "), words))
        .when(n == 10, F.concat(words, F.lit(" framework")))
        .otherwise(F.concat(words, F.lit(" notes")))
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source dimension: one row per source of the documents."""
    k = F.col("k")
    d = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("int").alias("k")).distinct()
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return d.select(
        F.when(k == 7, "github-k7").otherwise(F.concat(F.lit("src"), k.cast("string"))).alias("id"), F.concat(F.lit("Source "), k.cast("string")).alias("name"),
        F.lit("feed").alias("kind"), F.concat(F.lit("https://h"), (k % 17).cast("string"), F.lit(".example.com/feed")).alias("url"), F.lit(None).cast("string").alias("repo"),
        F.lit(None).cast("string").alias("adapter"), F.array().cast("array<string>").alias("communities"), F.get(names, k % 6).alias("category"),
        (1 + k % 10).cast("int").alias("weight"), (k % 3 == 0).alias("official"),
        F.when(k % 3 == 0, "primary").when(k % 3 == 1, "trusted_media").otherwise("discovery").alias("role"), (k != 19).alias("enabled"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("doc_id"), F.col("k")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.substring("source", 4, 9).cast("int").alias("k"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^ -~\n]", ""), r"\s+", " "))
    words = F.array_join(F.slice(F.split(plain, " ", 9), 1, 8), " ")
    page = F.when(i % 10 == 3, i - 2).otherwise(i)
    tail = F.when(i % 4 == 0, "?utm_source=x&b=2&a=1#f").when(i % 4 == 1, F.concat(F.lit("?b=2&a="), (page % 3).cast("string"))).when(i % 4 == 2, "?Ref=z&empty=").otherwise("")
    scheme = F.when(i % 89 == 0, "http").otherwise("https")
    url = F.concat(scheme, F.lit("://H"), (k % 17).cast("string"), F.lit(".Example.com/p/"), page.cast("string"), F.lit("/"), F.when(i % 10 == 3, "").otherwise(tail))
    minutes = F.when(i % 97 == 0, F.lit(-90)).otherwise((i * 37) % 9000)
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return d.select(
        "doc_id", F.when(k == 7, "github-k7").otherwise(F.concat(F.lit("src"), k.cast("string"))).alias("source_id"), F.concat(F.lit("Source "), k.cast("string")).alias("source_name"),
        (1 + k % 10).cast("int").alias("source_weight"), _titles(words, i % 12).alias("title"), url.alias("url"),
        F.timestamp_seconds(F.unix_timestamp(now()) - minutes * 60).alias("published_at"), F.substring("text", 1, MAX_EXCERPT).alias("excerpt"),
        F.get(names, k % 6).alias("category_hint"), (k % 3 == 0).alias("is_official_source"),
        F.when(k % 3 == 0, "primary").when(k % 3 == 1, "trusted_media").otherwise("discovery").alias("source_role"), (i % 2 == 0).alias("discovery_verified"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.to_candidates(raw_items(spark, sf_dir), simple=True)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses published before: those of every thirteenth document."""
    return candidates(spark, sf_dir).where("doc_id % 13 = 0").select("canonical_url").distinct()


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis per candidate address whose first document's number is not a multiple of five."""
    n = candidates(spark, sf_dir).groupBy("id").agg(F.min("doc_id").alias("n")).where("n % 5 <> 0")
    names, lanes = (F.array(*[F.lit(c) for c in x]) for x in (CATEGORIES, ["产品与应用", "商业与市场", "平台与政策"]))
    return n.select(
        "id", F.concat(F.lit("Headline "), F.col("n").cast("string")).alias("title"), F.get(names, (F.col("n") % 6).cast("int")).alias("category"),
        F.get(lanes, (F.col("n") % 3).cast("int")).alias("editorial_lane"), F.concat(F.lit("A summary that is long enough: "), F.col("n").cast("string")).alias("summary"),
        (1 + F.col("n") % 10).cast("int").alias("importance"), F.concat(F.lit("It matters because "), F.col("n").cast("string")).alias("why_it_matters"),
        F.array(F.lit("tag"), F.concat(F.lit("t"), (F.col("n") % 7).cast("string"))).alias("tags"), F.lit(True).alias("is_official"),
        F.when(F.col("n") % 3 == 0, "low").when(F.col("n") % 3 == 1, "medium").otherwise("high").alias("marketing_risk"), F.lit("watch this").alias("tracking_signal"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day and source of the events, as exploded source runs."""
    e = table(spark, sf_dir, "events").select("*", F.to_date("ts").alias("date"), (F.col("user_id") % 20).cast("int").alias("k"))
    n = e.groupBy("date", "k").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.max("ts").alias("latest"))
    ok = (F.dayofmonth("date") + F.col("k")) % 7 != 0
    known = lambda c: F.when(ok & (F.dayofmonth("date") % 4 != 0), c).cast("long")
    return n.select(
        "date", F.col("k").alias("pos"), F.concat(F.lit("src"), F.col("k").cast("string")).alias("source_id"), F.concat(F.lit("Source "), F.col("k").cast("string")).alias("source_name"), ok.alias("success"),
        F.when(ok, F.col("n")).cast("long").alias("item_count"), F.when(~ok, "TimeoutError").alias("error_type"), known(F.col("n")).alias("recent_count"), known(F.col("clicks")).alias("new_count"),
        known(F.col("clicks") / 2).alias("eligible_count"), known(F.lit(1)).alias("candidate_count"), F.lit(None).cast("long").alias("selected_count"),
        F.when(ok, F.col("latest")).alias("latest_published_at"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, items, source_runs): one report per day of the events, with as many items as its sources brought."""
    run = F.struct("source_id", "success", "recent_count")
    d = runs(spark, sf_dir).groupBy("date").agg(F.collect_list(run).alias("source_runs"), F.sum(F.coalesce("item_count", F.lit(0))).alias("n"))
    return d.select("date", F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<bigint>")).alias("items"), "source_runs")


def run_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, status) of the days with events, but for a few."""
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct().where("dayofmonth(date) % 7 <> 2")
    n = F.dayofmonth("date")
    return d.select("date", F.when(n % 6 == 0, "no_eligible_content").when(n % 5 == 0, "failed_before_publish").otherwise("published").alias("status"))


def report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with a report."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct().where("dayofmonth(date) % 5 <> 0 or dayofmonth(date) % 7 = 2")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published items: each document appears in the reports of one or two of 200 days."""
    d = candidates(spark, sf_dir).select("doc_id", "id", "canonical_url", "source_name", "published_at", "source_id", "is_official_source")
    one = d.withColumn("report_date", F.date_sub(F.lit(RUN_DATE).cast("date"), (F.col("doc_id") % 200).cast("int")))
    two = d.where("doc_id % 3 = 0").withColumn("report_date", F.date_sub(F.lit(RUN_DATE).cast("date"), (F.col("doc_id") * 7 % 200).cast("int")))
    both = one.unionByName(two)
    n = both.groupBy("id", "report_date").agg(F.min("doc_id").alias("n"), F.min("canonical_url").alias("canonical_url"), F.min("source_name").alias("source"), F.max("published_at").alias("published_at"), F.min("source_id").alias("source_id"))
    names, lanes = (F.array(*[F.lit(c) for c in x]) for x in (CATEGORIES, ["产品与应用", "商业与市场", "平台与政策"]))
    k = F.col("n")
    return n.select(
        "id", "report_date", "canonical_url", "source", "source_id", "published_at", F.concat(F.lit("Headline "), k.cast("string")).alias("title"),
        F.get(names, (k % 6).cast("int")).alias("category"), F.get(lanes, F.when(k % 7 == 0, 2).otherwise((k % 2).cast("int"))).alias("editorial_lane"),
        F.concat(F.lit("Summary "), (k % 40).cast("string")).alias("summary"), F.concat(F.lit("Why "), k.cast("string")).alias("why_it_matters"),
        F.array(F.lit("tag"), F.concat(F.lit("t"), (k % 7).cast("string"))).alias("tags"), (1 + k % 10).cast("int").alias("importance"), (k % 2 == 0).alias("is_official"),
        F.when(k % 2 == 0, "low").otherwise("medium").alias("marketing_risk"),
    )


# The same tables in SQL, for use as leading common table expressions.
_CATS = "['大模型', 'Agent', 'Coding Agent', 'AI 工具', '开源项目', '论文研究']"
RAW_SQL = rf"""
t_doc AS (SELECT doc_id, coalesce(text, '') AS text, substr(source, 4)::INT AS k FROM documents),
t_word AS (
  SELECT *, array_to_string(string_split(trim(regexp_replace(regexp_replace(text, '[^ -~\n]', '', 'g'), '\s+', ' ', 'g')), ' ')[1:8], ' ') AS w,
         CASE WHEN doc_id % 10 = 3 THEN doc_id - 2 ELSE doc_id END AS page
  FROM t_doc),
raw AS (
  SELECT doc_id, CASE WHEN k = 7 THEN 'github-k7' ELSE 'src' || k END AS source_id, 'Source ' || k AS source_name, 1 + k % 10 AS source_weight,
    CASE doc_id % 12 WHEN 0 THEN w || ' launches Nova-' || (doc_id % 50) WHEN 1 THEN 'arXiv paper on ' || w WHEN 2 THEN 'Sponsored: ' || w
      WHEN 3 THEN w || ' benchmark results' WHEN 4 THEN w || ' v1.2.' || (doc_id % 10) || ' patch' WHEN 5 THEN w || ' SDK API security access for production'
      WHEN 6 THEN w || ' raises funding' WHEN 7 THEN w || ' release of open models' WHEN 8 THEN w || ' price update' WHEN 9 THEN 'Introducing ' || w
      WHEN 10 THEN w || ' framework' ELSE w || ' notes' END AS title,
    CASE WHEN doc_id % 89 = 0 THEN 'http' ELSE 'https' END || '://H' || (k % 17) || '.Example.com/p/' || page || '/' ||
      CASE WHEN doc_id % 10 = 3 THEN '' ELSE CASE doc_id % 4 WHEN 0 THEN '?utm_source=x&b=2&a=1#f' WHEN 1 THEN '?b=2&a=' || (page % 3) WHEN 2 THEN '?Ref=z&empty=' ELSE '' END END AS url,
    TIMESTAMP '{NOW}' - to_minutes(CASE WHEN doc_id % 97 = 0 THEN -90 ELSE (doc_id * 37) % 9000 END) AS published_at,
    substr(text, 1, {MAX_EXCERPT}) AS excerpt, {_CATS}[k % 6 + 1] AS category_hint, k % 3 = 0 AS is_official_source,
    CASE k % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'trusted_media' ELSE 'discovery' END AS source_role, doc_id % 2 = 0 AS discovery_verified
  FROM t_word)"""

#: Canonical addresses and collapsed titles; http addresses are rejected.
CAND_SQL = (
    RAW_SQL
    + r""",
t_split AS (
  SELECT *, lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) AS host, rtrim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS query
  FROM raw WHERE url LIKE 'https://%'),
t_query AS (
  SELECT doc_id, string_agg(p, '&' ORDER BY split_part(p, '=', 1), split_part(p, '=', 2)) AS q
  FROM (SELECT doc_id, unnest(string_split(query, '&')) AS p FROM t_split WHERE query <> '')
  WHERE lower(split_part(p, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'source')
  GROUP BY doc_id),
t_canon AS (
  SELECT t_split.* EXCLUDE (title), trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || coalesce('?' || q, '') AS canonical_url
  FROM t_split LEFT JOIN t_query USING (doc_id)),
cand AS (SELECT *, substr(sha256(canonical_url), 1, 16) AS id FROM t_canon)"""
)

SCORE_SQL = rf"""(source_weight * 4
  + CASE WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 6 HOURS THEN 20 WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 12 HOURS THEN 16
         WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS THEN 12 WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 36 HOURS THEN 8
         WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOURS THEN 4 WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 96 HOURS THEN 2
         WHEN published_at >= TIMESTAMP '{NOW}' - INTERVAL 120 HOURS THEN 1 ELSE 0 END
  + CASE source_role WHEN 'primary' THEN 14 WHEN 'trusted_media' THEN 8 ELSE 0 END
  + CASE WHEN is_official_source THEN 8 ELSE 0 END
  + least(12, length(trim(excerpt, E' \t\n\r')) // 80)
  + CASE WHEN regexp_matches(lower(title), '\b(?:release|launch|introducing)\b') THEN 6 ELSE 0 END)"""


def ranked_sql(source: str) -> str:
    """Common table expression ``ranked`` with score, scarcity and total over another one."""
    return rf"""
ranked AS (
  SELECT *, score + scarcity AS total FROM (
    SELECT *, {SCORE_SQL} AS score,
           CASE WHEN category_hint = '论文研究' THEN 0 ELSE greatest(0, 6 - least(6,
             count(*) OVER (PARTITION BY CASE WHEN category_hint = 'Coding Agent' THEN 'Agent' ELSE category_hint END))) END AS scarcity
    FROM {source}))"""


HISTORY_SQL = "hist AS (SELECT DISTINCT canonical_url FROM cand WHERE doc_id % 13 = 0)"

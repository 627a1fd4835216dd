"""Sinks: partitioned reports and run records, Markdown, search index, feed and sitemap."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import safe_markdown
from tidewire.operators import ranking
from tidewire.plans.readmodels import search_order


def upsert_by_date(df: DataFrame, path: str) -> None:
    """Write rows, replacing exactly the dates that they hold; each date is one partition."""
    w = df.withColumn("day", F.date_format("date", "yyyy-MM-dd")).write.mode("overwrite")
    w.option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_by_date(spark, path: str, since: str | None = None) -> DataFrame:
    """Rows of a table written by ``upsert_by_date``; ``since`` prunes partitions."""
    d = spark.read.parquet(path)
    return (d.where(F.col("day") >= since) if since else d).drop("day")


def publish(reports: DataFrame, records: DataFrame, path: str) -> None:
    """Report and run record of a date as one row set, so that both appear together or not at all."""
    both = reports.join(records.select("date", F.struct("cutoff_at", "status", "safe_error_code").alias("run")), "date")
    upsert_by_date(both, path)


def canonical_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json) with fields in name order."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def _item_block(number: Column, level: str) -> Column:
    return F.concat(
        F.lit(f"{level} "), number.cast("string"), F.lit(". "), safe_markdown(F.col("title")), F.lit("\n\n"), safe_markdown(F.col("summary")),
        F.lit("\n\n- "), safe_markdown(F.col("why_it_matters")), F.lit("\n- <"), F.replace(F.replace("canonical_url", F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")), F.lit(">\n"),
    )


def markdown(items: DataFrame, heading: str = "# ") -> DataFrame:
    """(report_date, markdown) of every report: the first three items as highlights, then all."""
    d = ranking.paginated(items, ranking.publish_order(), 10_000, ("report_date",))
    block = F.struct("position", _item_block(F.col("position"), "###").alias("block"))
    # a report holds at most a handful of items, so its list is bounded
    d = d.groupBy("report_date").agg(F.array_sort(F.collect_list(block)).alias("b"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x["block"]), "\n")
    body = F.concat(F.lit(heading), F.date_format("report_date", "yyyy-MM-dd"), F.lit("\n\n## Top\n\n"), text(F.slice("b", 1, 3)), F.lit("\n## All\n\n"), text(F.col("b")))
    return d.select("report_date", body.alias("markdown"))


def write_search_index(entries: DataFrame, path: str) -> None:
    search_order(entries).write.mode("overwrite").json(path)


def _xml(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def rss_elements(entries: DataFrame) -> DataFrame:
    """(id, xml): one feed element per entry of ``readmodels.rss_items``."""
    about = F.concat(
        F.lit("<p>"), _xml(F.col("summary")), F.lit("</p><p>"), _xml(F.col("why_it_matters")), F.lit('</p><p><a href="'), _xml(F.col("canonical_url")), F.lit('">原始来源</a></p>')
    )
    stamp = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss xx")
    body = F.concat(
        F.lit("<item><title>"), _xml(F.col("title")), F.lit("</title><link>"), _xml(F.col("link")), F.lit('</link><guid isPermaLink="true">'), _xml(F.col("link")),
        F.lit("</guid><pubDate>"), stamp, F.lit("</pubDate><description>"), _xml(about), F.lit("</description></item>"),
    )
    return entries.select("id", body.alias("xml"))


def sitemap_urls(reports: DataFrame, pages: DataFrame, root: str) -> DataFrame:
    """Addresses of all pages: fixed ones, days and channel pages (channel, page)."""
    fixed = reports.sparkSession.createDataFrame([(root + x,) for x in ("", "archive/", "sources/", "search/")], "url string")
    days = reports.select(F.concat(F.lit(root + "days/"), F.date_format("date", "yyyy-MM-dd"), F.lit("/")).alias("url")).distinct()
    first = F.when(F.col("page") > 1, F.concat(F.lit("page/"), F.col("page").cast("string"), F.lit("/"))).otherwise("")
    channels = pages.select("channel", "page").distinct().select(F.concat(F.lit(root + "channels/"), F.col("channel"), F.lit("/"), first).alias("url"))
    return fixed.unionByName(days).unionByName(channels)


def robots(root: str) -> str:
    """The text of robots.txt: everything may be read, and where the sitemap is."""
    return f"User-agent: *\nAllow: /\nSitemap: {root}sitemap.xml\n"


def build_info(reports: DataFrame, built_at: Column, revision: str) -> DataFrame:
    """One row: when and from what the site was built, the number of reports and the latest date."""
    return reports.agg(F.count_distinct("date").alias("reports"), F.max("date").alias("latest")).select(
        F.to_utc_timestamp(built_at, "UTC").alias("built_at"), F.lit(revision).alias("revision"), "reports", "latest"
    )

"""Derived read models: archive, editions, channels, sources, search, feed and health."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as texts
from tidewire.operators import ranking
from tidewire.operators.dedupe import first_wins
from tidewire.schema import CHANNELS, POLICY_LANE, RESEARCH

# Labels shown for sources without figures, and the channel of each category.
NEVER_RUN_LABEL = "暂无运行数据"
NO_DIAGNOSTICS_LABEL = "历史诊断不可用"
CATEGORY_CHANNEL = {"大模型": "model", "Agent": "agent", "Coding Agent": "agent", "AI 工具": "ai-tools", "开源项目": "open-source"}

PAGE_SIZE = 20
ROLL_UP_DATES = 7
SEARCH_DAYS = 180
FEED_DAYS = 30
RECENT_DAYS = 30
FRESHNESS_DAYS = {"primary": 90, "trusted_media": 7, "discovery": 7}
COUNTERS = ["recent_count", "new_count", "eligible_count", "candidate_count", "selected_count"]


def channel(category: Column, lane: Column) -> Column:
    """Channel slug of a published item; research has none, policy goes before category."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORY_CHANNEL.items() for x in pair])
    return F.when(lane == POLICY_LANE, "industry-policy").when(category != RESEARCH, F.element_at(known, category))


def channel_name(slug: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CHANNELS for x in pair]), slug)


def fragment(item: Column, day: Column) -> Column:
    return F.concat(F.lit("item-"), item, F.lit("-"), F.date_format(day, "yyyy-MM-dd"))


def day_url(item: Column, day: Column, base: str = "/") -> Column:
    if not (base.startswith(("/", "https://")) and base.endswith("/")):
        raise ValueError("base path must begin and end with a slash")
    return F.concat(F.lit(f"{base}days/"), F.date_format(day, "yyyy-MM-dd"), F.lit("/#"), fragment(item, day))


def report_items(reports: DataFrame) -> DataFrame:
    """One row per published item with its report's date."""
    return reports.select(F.col("date").alias("report_date"), "generated_at", F.explode("items").alias("i")).select("report_date", "generated_at", "i.*")


def issue_numbers(reports: DataFrame) -> DataFrame:
    """(date, issue): ordinal of each distinct date."""
    return reports.select("date").distinct().withColumn("issue", F.row_number().over(Window.orderBy("date")))


def edition_neighbors(reports: DataFrame) -> DataFrame:
    """(date, older, newer) of every distinct report date."""
    w = Window.orderBy("date")
    return reports.select("date").distinct().select("date", F.lag("date").over(w).alias("older"), F.lead("date").over(w).alias("newer"))


def neighbors_of(reports: DataFrame, date: str) -> tuple:
    """(older, newer) of one edition; a date without a report is an error."""
    found = edition_neighbors(reports).where(F.col("date") == F.lit(date).cast("date")).first()
    if found is None:
        raise ValueError(f"no edition of {date}")
    return found["older"], found["newer"]


def archive(reports: DataFrame, records: DataFrame) -> DataFrame:
    """(date, status, has_report, latest_run_status) of every day from the first to the last that is known."""
    r = reports.select("date", F.lit(True).alias("_report"))
    s = records.select("date", F.col("status").alias("latest_run_status"))
    span = r.select("date").unionByName(s.select("date")).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("date"))
    d = days.join(r, "date", "left").join(s, "date", "left")
    run, report = F.col("latest_run_status"), F.col("_report").isNotNull()
    status = (
        F.when(run == "no_eligible_content", "no_eligible_content")
        .when(report, "published")
        .when(run == "failed_before_publish", "failed_before_publish")
        .when(run == "published", "missing_report")
        .otherwise("never_run")
    )
    d = d.withColumn("status", status)
    return d.select("date", "status", (F.col("status") == "published").alias("has_report"), "latest_run_status")


def archive_violations(reports: DataFrame, records: DataFrame) -> DataFrame:
    """Days that two reports or two records claim, and published runs without a report."""
    twice = lambda df, code: df.groupBy("date").count().where("count > 1").select("date", F.lit(code).alias("code"))
    missing = archive(reports, records).where("status = 'missing_report'").select("date", F.lit("missing_report").alias("code"))
    return twice(reports, "duplicate_report").unionByName(twice(records, "duplicate_record")).unionByName(missing)


def source_statuses(specs: DataFrame, runs: DataFrame, last: int = ROLL_UP_DATES) -> DataFrame:
    """Roll-up of the last run dates per enabled source; ``runs`` has a date and one row per source and run.

    Sums stay null where no run knows the figure.
    """
    dates = runs.select("date").distinct().orderBy(F.col("date").desc()).limit(last)
    held = runs.join(F.broadcast(dates), "date")  # at most ``last`` rows
    agg = held.groupBy("source_id").agg(
        F.max_by("success", "date").alias("success"), F.max_by("item_count", "date").alias("item_count"),
        F.max("latest_published_at").alias("latest_published_at"), *[F.sum(c).alias(c) for c in COUNTERS],
    )
    d = specs.where("enabled").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("role").alias("source_role"))
    d = d.join(agg, "source_id", "left")
    known = F.coalesce(*COUNTERS).isNotNull()
    label = F.when(F.col("success").isNull(), NEVER_RUN_LABEL).when(~known, NO_DIAGNOSTICS_LABEL)
    status = F.when(F.col("success").isNull(), "never_run").when(F.col("success"), "ok").otherwise("failed")
    return d.select("source_id", "source_name", "source_role", status.alias("request_status"), "item_count", "latest_published_at", *COUNTERS, label.alias("diagnostic_label"))


def fallback_specs(runs: DataFrame) -> DataFrame:
    """Sources known only from runs: the name seen first, by date and then position."""
    first = runs.groupBy("source_id").agg(F.min_by("source_name", F.struct("date", "pos")).alias("source_name"))
    return first.orderBy("source_id")


def header_counts(reports: DataFrame) -> DataFrame:
    """Sources, successful sources, fresh ones (with recent items) and items of every report, and whether a source failed."""
    ok = F.size(F.filter("source_runs", lambda r: r["success"]))
    fresh = F.size(F.filter("source_runs", lambda r: F.coalesce(r["recent_count"], F.lit(0)) > 0))
    n = F.size("source_runs")
    return reports.select("date", n.alias("sources"), ok.alias("ok_sources"), fresh.alias("fresh"), F.size("items").alias("items"), (ok < n).alias("degraded"))


def home(items: DataFrame) -> DataFrame:
    """Latest report's items in publish order, as lead, briefs and rest."""
    latest = items.agg(F.max("report_date").alias("report_date"))
    d = items.join(F.broadcast(latest), "report_date")  # one row
    d = d.withColumn("position", F.row_number().over(Window.orderBy(*ranking.publish_order())))
    return d.withColumn("slot", F.when(F.col("position") == 1, "lead").when(F.col("position") <= 4, "brief").otherwise("rest"))


def two_digits(position: Column) -> Column:
    """A position with a leading zero below ten."""
    return F.concat(F.when(position < 10, "0").otherwise(""), position.cast("string"))


def day_pages(items: DataFrame) -> DataFrame:
    """Items of every report in publish order, with a two-digit number."""
    d = ranking.numbered(items, ranking.publish_order(), ("report_date",))
    return d.withColumn("number", two_digits(F.col("position")))


def channel_timelines(items: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Items of every channel, newest first, on pages; numbers run on over pages."""
    d = items.withColumn("channel", channel(F.col("category"), F.col("editorial_lane"))).where("channel is not null")
    order = [F.col("published_at").desc(), F.col("id").asc(), F.col("report_date").desc()]
    d = ranking.paginated(d, order, page_size, ("channel",))
    return d.withColumn("number", two_digits(F.col("position")))


def _window(items: DataFrame, days: int) -> DataFrame:
    latest = items.agg(F.max("report_date").alias("_latest"))
    return items.join(F.broadcast(latest)).where(F.col("report_date") >= F.date_sub("_latest", days - 1)).drop("_latest")


def _newest_first(items: DataFrame) -> DataFrame:
    return first_wins(items, "id", [F.col("report_date").desc()])


def search_index(items: DataFrame, base: str = "/", days: int = SEARCH_DAYS) -> DataFrame:
    """Public search entries: items in a channel, each once with its newest report."""
    d = _window(items, days + 1).withColumn("_channel", channel(F.col("category"), F.col("editorial_lane"))).where("_channel is not null")
    d = _newest_first(d)
    return d.select(
        "id", "title", "summary", "why_it_matters", "tags", channel_name(F.col("_channel")).alias("display_category"), "source",
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_at"), F.date_format("report_date", "yyyy-MM-dd").alias("report_date"),
        "is_official", "marketing_risk", day_url(F.col("id"), F.col("report_date"), base).alias("page_url"),
    )


def search_sort() -> list[Column]:
    """The order of a search index: newest first, then by report."""
    return [F.col("published_at").desc(), F.col("report_date").desc(), F.col("id").asc()]


def search_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy(*search_sort())


def search(
    entries: DataFrame, query: str = "", channel_: str = "", source: str = "", start: str = "", end: str = "", recent_window: bool = True, ascii_only: bool = False,
    among: DataFrame | None = None,
) -> DataFrame:
    """Search entries that hold a text, in a channel, of a source, between two days; newest first.

    ``among`` has the columns of the entries' key, (slot, id), and names the only entries to look at.
    """
    fold, norm = _folding(ascii_only), folded_query
    d = entries
    if not start and not end and recent_window:
        latest = entries.agg(F.max(F.to_date("report_date")).alias("_latest"))
        d = d.join(F.broadcast(latest)).where(F.col("report_date") >= F.date_format(F.date_sub("_latest", RECENT_DAYS - 1), "yyyy-MM-dd")).drop("_latest")
    if among is not None:
        d = d.join(among, among.columns, "left_semi")
    if norm(query):
        d = d.where(searched_text(ascii_only).contains(norm(query)))
    if norm(channel_):
        d = d.where(fold(F.col("display_category")) == norm(channel_))
    if norm(source):
        d = d.where(fold(F.col("source")) == norm(source))
    if start:
        d = d.where(F.col("report_date") >= start)
    if end:
        d = d.where(F.col("report_date") <= end)
    return d.orderBy(*result_order())


def result_order() -> list[Column]:
    """Newest first."""
    return [F.to_timestamp("published_at").desc(), F.col("id").asc()]


def _folding(ascii_only: bool):
    return (lambda *c: F.lower(F.trim(F.concat_ws("\n", *c)))) if ascii_only else texts.search_text


def searched_text(ascii_only: bool = False) -> Column:
    """The folded text of an entry that searches look in."""
    return _folding(ascii_only)(F.col("title"), F.col("summary"), F.col("why_it_matters"), F.col("source"), F.array_join("tags", "\n"))


def folded_query(value: object) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", str(value or "")).strip().lower()


def parse_search_index(payloads: DataFrame, column: str = "text") -> DataFrame:
    """(status, entry) of serialized search indexes: each must be an array of objects with text id and page_url."""
    kind = F.try_parse_json(F.col(column))
    d = payloads.select(F.col(column), F.from_json(F.when(F.schema_of_variant(kind).startswith("ARRAY"), F.col(column)), "array<map<string,string>>").alias("a"))
    good = F.coalesce(F.forall("a", lambda m: F.element_at(m, "id").isNotNull() & F.element_at(m, "page_url").isNotNull()), F.lit(False))
    d = d.withColumn("status", F.when(good, "success").otherwise("invalid-json"))
    return d.select("status", F.explode_outer(F.when(good, F.col("a"))).alias("entry"))


def source_facet(entries: DataFrame) -> DataFrame:
    """Distinct sources in the order of the site's language."""
    return entries.select("source").distinct().orderBy(F.collate("source", "zh"))


def rss_items(items: DataFrame, root: str = "/", days: int = FEED_DAYS) -> DataFrame:
    """Feed entries: items in a channel of the last report days, each once, newest first."""
    d = _window(items, days).where(channel(F.col("category"), F.col("editorial_lane")).isNotNull())
    d = _newest_first(d)
    return d.select(
        "id", "title", "summary", "why_it_matters", "canonical_url", "published_at", "report_date",
        day_url(F.col("id"), F.col("report_date"), root).alias("link"),
    ).orderBy(F.col("published_at").desc(), F.col("id").asc())


def source_health(specs: DataFrame, items: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """Freshness per enabled source; ``failures`` has (source_id, error_type) of collections that failed."""
    agg = items.groupBy("source_id").agg(F.count("*").alias("n"), F.to_date(F.max("published_at")).alias("latest"))
    d = specs.where("enabled").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("role").alias("source_role"))
    d = d.join(agg, "source_id", "left").join(failures.select("source_id", F.col("error_type").alias("_error")).dropDuplicates(["source_id"]), "source_id", "left")
    days = F.element_at(F.create_map(*[F.lit(x) for pair in FRESHNESS_DAYS.items() for x in pair]), F.col("source_role"))
    failed, empty = F.col("_error").isNotNull(), F.col("n").isNull()
    status = F.when(failed, "failed").when(empty, "empty").when(F.col("latest") >= F.date_sub(as_of, days), "fresh").otherwise("stale")
    safe = F.when(F.col("_error").rlike(r"^[A-Za-z][A-Za-z0-9_]{0,127}$"), F.col("_error")).otherwise("Error")
    return d.select(
        "source_id", "source_name", "source_role", status.alias("status"), F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("item_count"),
        F.when(~failed, F.col("latest")).alias("latest_date"), F.when(failed, safe).when(empty, "EmptySourceResult").alias("error_type"),
    )


def health_gate(health: DataFrame) -> DataFrame:
    """One row: whether there are required sources and all of them are reachable and not empty."""
    need = health.where("source_role <> 'discovery'")
    return need.agg((F.coalesce(F.bool_and(F.col("status").isin("fresh", "stale")), F.lit(False)) & (F.count("*") > 0)).alias("ok"))


def health_lines(health: DataFrame) -> DataFrame:
    """One printable line per source."""
    return health.select(
        F.concat_ws(" ", "source_id", texts.collapse(F.col("source_name")), "source_role", "status", F.col("item_count").cast("string"), F.coalesce(F.date_format("latest_date", "yyyy-MM-dd"), F.lit("-")), F.coalesce("error_type", F.lit("-"))).alias("line")
    )

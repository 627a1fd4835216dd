"""From raw items to candidates, the counters on the way, and the daily selection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules, text, times, urls
from tidewire.operators import dedupe, ranking
from tidewire.plans.materialize import cut

DEDUPE_LIMIT = 500
SOURCE_FLOOR = 6
POOL = 36
OFFICIAL_CAP = 6
UNOFFICIAL_CAP = 3


def to_candidates(raw: DataFrame, simple: bool = False) -> DataFrame:
    """Raw items with canonical address, id and normalised title; rows without one of them drop out.

    ``simple`` keeps to addresses of the common shape and ASCII titles, wholly in the JVM.
    """
    address = urls.canonical_simple(F.col("url")) if simple else urls.canonical_url(F.col("url"))
    title = text.collapse(F.col("title")) if simple else text.normalize_title(F.col("title"))
    d = raw.withColumn("canonical_url", address).withColumn("title", title)
    d = d.where(F.col("canonical_url").isNotNull() & F.col("title").isNotNull() & (F.col("title") != "") & F.col("published_at").isNotNull())
    return d.withColumn("id", urls.url_id(F.col("canonical_url"))).withColumn("url", F.col("canonical_url"))


def eligible_here() -> Column:
    c = F.col
    return rules.eligible(c("title"), c("excerpt"), c("source_id"), c("source_role"), c("discovery_verified"))


def recent(candidates: DataFrame, now: Column) -> DataFrame:
    return candidates.where(times.in_window(F.col("published_at"), now))


def without_history(candidates: DataFrame, history: DataFrame) -> DataFrame:
    return candidates.join(history.select("canonical_url").distinct(), "canonical_url", "left_anti")


def history_urls(reports: DataFrame, records: DataFrame, run_date: Column, days: int = times.HISTORY_DAYS) -> DataFrame:
    """Distinct addresses published in the days before a run; days whose last run had nothing are left out."""
    past = reports.where((F.col("date") >= F.date_sub(run_date, days)) & (F.col("date") < run_date))
    return active_reports(past, records).select(F.explode("items").alias("i")).select(F.col("i.canonical_url").alias("canonical_url")).distinct()


def active_reports(reports: DataFrame, records: DataFrame) -> DataFrame:
    """Reports that no later empty run shadows; failed runs shadow nothing."""
    gone = records.where(F.col("status") == "no_eligible_content").select("date").distinct()
    return reports.join(gone, "date", "left_anti")


def funnel_counts(raw: DataFrame, history: DataFrame, now: Column, simple: bool = False) -> DataFrame:
    """Per source: latest publication of all rows, and rows recent, new and eligible, before any dedupe."""
    return admitted_counts(admitted(raw, history, now, simple))


def admitted(raw: DataFrame, history: DataFrame, now: Column, simple: bool = False) -> DataFrame:
    """Raw items with a publication time as candidates, with _recent, _new and _eligible.

    All that counters and selection ask of raw items is answered in this one pass, which a run stores; metrics
    gathered on the side would count rows again when a lost task is repeated. Editorial rules run on new rows alone.
    """
    d = to_candidates_flagged(raw, simple)
    seen = history.select("canonical_url").distinct().withColumn("_seen", F.lit(True))
    d = d.join(seen, "canonical_url", "left")
    recent_now = F.coalesce(F.col("_ok") & times.in_window(F.col("published_at"), now), F.lit(False))
    d = d.withColumn("_recent", recent_now).withColumn("_new", F.col("_recent") & F.col("_seen").isNull())
    return d.withColumn("_eligible", F.when(F.col("_new"), F.coalesce(eligible_here(), F.lit(False))).otherwise(False)).drop("_seen", "_ok")


def admitted_counts(rows: DataFrame) -> DataFrame:
    """The counters of ``funnel_counts`` from admitted rows."""
    n = [F.count_if(f"_{x}").alias(f"{x}_count") for x in ("recent", "new", "eligible")]
    return rows.groupBy("source_id").agg(F.max("published_at").alias("latest_published_at"), *n)


def to_candidates_flagged(raw: DataFrame, simple: bool = False) -> DataFrame:
    """All raw items with a publication time; _ok tells which make candidates."""
    address = urls.canonical_simple(F.col("url")) if simple else urls.canonical_url(F.col("url"))
    title = text.collapse(F.col("title")) if simple else text.normalize_title(F.col("title"))
    d = raw.where("published_at is not null").withColumn("canonical_url", address).withColumn("title", F.coalesce(title, F.lit("")))
    return d.withColumn("_ok", F.col("canonical_url").isNotNull() & (F.col("title") != ""))


def source_run_snapshot(runs: DataFrame, funnel: DataFrame, candidates: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Source runs with their counters: zero where a successful source had nothing, null for failed ones.

    ``candidates`` and ``selected`` are rows with a source_id; ``selected`` is None until analysis has ended.
    """
    count = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    d = runs.select("source_id", "source_name", "success", "item_count", "elapsed_ms", "error_type")
    d = d.join(funnel, "source_id", "left").join(count(candidates, "candidate_count"), "source_id", "left")
    d = d.join(count(selected, "selected_count"), "source_id", "left") if selected is not None else d.withColumn("selected_count", F.lit(None))
    known = lambda name: F.when(F.col("success"), F.coalesce(name, F.lit(0))).cast("int").alias(name)
    return d.select(
        "source_id", "source_name", "success", "item_count", "elapsed_ms", "error_type",
        *[known(x) for x in ("recent_count", "new_count", "eligible_count", "candidate_count")],
        (known("selected_count") if selected is not None else F.lit(None).cast("int").alias("selected_count")),
        F.when(F.col("success"), F.col("latest_published_at")).alias("latest_published_at"),
    )


def select_candidates(
    raw: DataFrame, history: DataFrame, now: Column, trim: int | None = DEDUPE_LIMIT, simple: bool = False
) -> DataFrame:
    """The daily selection: exact winners, trimmed for diversity, deduplicated, eligible, balanced.

    ``trim`` is the small pipeline's bound on the rows that reach the fuzzy phase; None lifts it.
    """
    fresh = without_history(recent(to_candidates(raw, simple), now), history)
    return _selected(fresh, now, trim, simple)


def select_admitted(rows: DataFrame, now: Column, trim: int | None = DEDUPE_LIMIT, simple: bool = False) -> DataFrame:
    """The daily selection from admitted rows."""
    fresh = rows.where("_new").withColumn("id", urls.url_id(F.col("canonical_url"))).withColumn("url", F.col("canonical_url"))
    return _selected(fresh.drop("_recent", "_new", "_eligible"), now, trim, simple)


def _selected(fresh: DataFrame, now: Column, trim: int | None, simple: bool) -> DataFrame:
    folded = text.fold_ascii(F.col("title")) if simple else text.fold_title(F.col("title"))
    winners = cut(dedupe.exact_winners(fresh, folded), "fn-exact")
    if trim is not None:
        winners = ranking.diverse(winners, now, trim, SOURCE_FLOOR, folded).select(*winners.columns)
    unique = cut(dedupe.fuzzy_winners(dedupe.event_winners(winners, folded), folded), "fn-unique")
    return ranking.balanced(unique.where(eligible_here()), now, POOL, OFFICIAL_CAP, UNOFFICIAL_CAP, folded)

"""One day's run as a driver function: raw items in, a report and a run record out.

Only bounded things pass through the driver: the rows that an analyzer gets to
see (at most ``funnel.POOL``), its response, and counts. Every end of a run has a
status and a safe error code, and leaves its record: a published day stores report,
record and index entry in one commit, any other only its record, so a report of an earlier run of
the same day stays.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import funnel, ranking
from tidewire.plans import analysis
from tidewire.plans.materialize import cut
from tidewire.plans.snapshots import Snapshots
from tidewire.schema import RUN_RECORDS, SOURCE_RUN

SCHEMA_VERSION = "1.3"

#: From the prompt rows, and from the error and text of a response to repair, to a response text.
Ask = Callable[[list[dict], str | None, str | None], str]


class RunError(Exception):
    """A run that ends without a report; ``code`` is one of the safe error codes, ``detail`` says more about an analysis."""

    def __init__(self, code: str, detail: str | None = None):
        super().__init__(code)
        self.code, self.detail = code, detail

    @property
    def status(self) -> str:
        return "no_eligible_content" if self.code == "no_eligible_candidates" else "failed_before_publish"


@dataclass
class Outcome:
    """How a run ended: ``report`` is None unless it is published; ``record`` is one row."""

    status: str
    code: str
    report: DataFrame | None
    record: DataFrame


def _parsed(text: str, selected: DataFrame) -> tuple[DataFrame | None, str | None]:
    """Analysis rows of a response within the quota, or the error that keeps it from having any."""
    rows = analysis.response_rows(selected.sparkSession.createDataFrame([(text,)], "text string"))
    head = rows.first()
    if head is None or head["error"]:
        return None, head["error"] if head else "json"
    rows = cut(analysis.normalize_drift(rows.select("pos", "row")), "dy-rows")
    error = analysis.response_error(rows, selected).first()["error"]
    return (None, error) if error else (analysis.within_quota(rows, selected).drop("source_id"), None)


def analyze(selected: DataFrame, ask: Ask) -> DataFrame:
    """The analyses of selected candidates; a response that cannot be used is sent back once for repair."""
    prompt = [r.asDict() for r in analysis.prompt_rows(selected).orderBy("id").collect()]
    if not prompt or len({r["id"] for r in prompt}) < len(prompt):
        raise RunError("analysis_failed", "invalid_input")
    try:
        text = ask(prompt, None, None)
        rows, error = _parsed(text, selected)
        if rows is None:
            rows, error = _parsed(ask(prompt, error, text), selected)
    except Exception as failure:
        raise RunError("analysis_failed", "analysis failed") from failure
    if rows is None:
        raise RunError("analysis_failed", "invalid_after_repair")
    rows = cut(rows, "dy-analyses")
    if not analysis.has_secrets(rows).isEmpty():
        raise RunError("analysis_failed", "sensitive_output")
    return rows


def _snapshot(runs: DataFrame, counts: DataFrame | None, candidates: DataFrame | None, selected: DataFrame | None) -> DataFrame:
    """The source runs with the counters that are known by now, as the stored struct has them."""
    names = [f.name for f in SOURCE_RUN.fields]
    if counts is not None:
        d = funnel.source_run_snapshot(runs, counts, candidates, selected)
    else:
        held = ("source_id", "source_name", "success", "item_count", "elapsed_ms", "error_type")
        d = runs.select(*held, *[F.lit(None).alias(c) for c in names if c not in held])
    return d.select(*[F.col(f.name).cast(f.dataType) for f in SOURCE_RUN.fields])


def _listed(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))


def record_row(spark: SparkSession, run_date: str, now, status: str, code: str, source_runs: DataFrame) -> DataFrame:
    """The run record: one row, whatever the outcome."""
    d = _listed(source_runs, "source_runs").select(
        F.lit(run_date).cast("date").alias("date"), now.alias("cutoff_at"), F.lit(status).alias("status"), "source_runs", F.lit(code).alias("safe_error_code")
    )
    return d.select(*[F.col(f.name).cast(f.dataType) for f in RUN_RECORDS.fields])


def report_row(items: DataFrame, source_runs: DataFrame, run_date: str, now, model: str, candidates: int) -> DataFrame:
    """The report: one row with its items in publishing order."""
    placed = ranking.numbered(items, ranking.publish_order())
    listed = _listed(placed.select("position", *items.columns), "items")
    order = F.transform("items", lambda x: x.dropFields("position")).alias("items")
    runs = _listed(source_runs, "source_runs").withColumn("degraded", F.exists("source_runs", lambda r: ~r["success"]))
    return listed.crossJoin(runs).select(  # one row each
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(run_date).cast("date").alias("date"), now.alias("generated_at"), F.lit(model).alias("model"),
        "degraded", F.lit(candidates).alias("candidate_count"), order, "source_runs",
    )


@dataclass
class Prepared:
    """What the selection of a day leaves: candidates and counters per source, or the code of the failure."""

    candidates: DataFrame | None
    counts: DataFrame | None
    code: str | None


def prepare(raw: DataFrame, runs: DataFrame, history: DataFrame, now, trim: int | None = funnel.DEDUPE_LIMIT, simple: bool = False) -> Prepared:
    """The selection over the items of healthy sources; raw items are read and judged once for counters and selection."""
    if runs.where("success").isEmpty():
        return Prepared(None, None, "no_healthy_sources")
    try:
        admitted = cut(funnel.admitted(raw, history, now, simple), "dy-admitted")
        counts = cut(funnel.admitted_counts(admitted), "dy-counts")
        new = counts.agg(F.sum("new_count")).first()[0]
        candidates = cut(funnel.select_admitted(admitted, now, trim, simple), "dy-candidates") if new else admitted.limit(0)
    except Exception:
        return Prepared(None, None, "candidate_preparation_failed")
    return Prepared(candidates, counts, None)


def index_rows(report: DataFrame) -> DataFrame:
    """The index entry of a report."""
    return report.select("date", "generated_at", F.size("items").alias("item_count"))


def conclude(prepared: Prepared, runs: DataFrame, run_date: str, now, ask: Ask | None, model: str, store: Snapshots | None = None) -> Outcome:
    """Analyze, build and store a prepared day; every end has a record, and with ``store`` leaves it there.

    Where storing a report fails, the day ends as ``persistence_failed`` and that record is stored instead; where even a
    record can't be stored, an error of that code is raised.
    """
    spark = runs.sparkSession
    chosen = report = None
    try:
        if prepared.code:
            raise RunError(prepared.code)
        n = prepared.candidates.count()
        if not n:
            chosen = prepared.candidates
            raise RunError("no_eligible_candidates")
        if ask is None:
            raise RunError("configuration_failed")
        items = cut(analysis.build_items(prepared.candidates, analyze(prepared.candidates, ask)), "dy-items")
        chosen = items
        reasons = [r["reason"] for r in analysis.publishable(items).collect()]
        if reasons:
            raise RunError("no_eligible_candidates" if "publication_threshold" in reasons else "report_validation_failed")
        status, code = "published", "none"
    except RunError as error:
        status, code = error.status, error.code
    snapshot = cut(_snapshot(runs, prepared.counts, prepared.candidates, chosen), "dy-runs")
    record = record_row(spark, run_date, now, status, code, snapshot)
    if status == "published":
        report = report_row(items, snapshot, run_date, now, model, n)
        if store is None:
            return Outcome(status, code, report, record)
        try:
            store.commit({"reports": report, "run_records": record, "index": index_rows(report)})
            return Outcome(status, code, report, record)
        except Exception:
            failed = RunError("persistence_failed")
            status, code, report = failed.status, failed.code, None
            record = record_row(spark, run_date, now, status, code, snapshot)
    if store is not None:
        try:
            store.commit({"run_records": record})
        except Exception as failure:
            raise RunError("persistence_failed", "the run record could not be stored") from failure
    return Outcome(status, code, report, record)


def run_daily(
    raw: DataFrame, runs: DataFrame, history: DataFrame, run_date: str, now, ask: Ask | None, model: str,
    store: Snapshots | None = None, trim: int | None = funnel.DEDUPE_LIMIT, simple: bool = False,
) -> Outcome:
    """Select, analyze, build and store one day.

    ``runs`` has one row per enabled source (source_id, source_name, success, item_count, elapsed_ms, error_type), ``raw``
    the items of the sources that succeeded, ``history`` the addresses published before.
    """
    if not model:
        raise ValueError("model is required")
    return conclude(prepare(raw, runs, history, now, trim, simple), runs, run_date, now, ask, model, store)

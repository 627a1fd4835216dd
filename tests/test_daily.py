import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.plans import daily
from tidewire.plans.snapshots import Conflict, Snapshots
from tidewire.schema import RAW_ITEMS, REPORTS, RUN_RECORDS

INDEX = T.StructType([T.StructField("date", T.DateType()), T.StructField("generated_at", T.TimestampType()), T.StructField("item_count", T.IntegerType())])

NOW = dt.datetime(2024, 1, 31)


def raw(spark, n=4):
    rows = [
        (f"s{i % 2}", f"Source {i % 2}", 8, f"{word} launches Nova-{i}0 to everyone", f"https://a{i}.example.com/p/{i}", NOW - dt.timedelta(hours=i + 1), "A long text. " * 9, "Agent", True, "primary", False)
        for i, word in enumerate(["Aldebaran", "Betelgeuse", "Capella", "Deneb"][:n])
    ]
    return spark.createDataFrame(rows, RAW_ITEMS)


def runs(spark, *ok):
    rows = [(f"s{i}", f"Source {i}", x, 2 if x else None, 5, None if x else "TimeoutError") for i, x in enumerate(ok)]
    return spark.createDataFrame(rows, "source_id string, source_name string, success boolean, item_count int, elapsed_ms int, error_type string")


def response(prompt, *_):
    rows = [
        {
            "id": r["id"], "title": f"Title {k}", "category": "Agent", "editorial_lane": "产品与应用", "summary": "A summary of what happened today.", "importance": str(k + 1),
            "why_it_matters": "It matters to readers.", "tags": ["one"], "is_official": "True", "marketing_risk": "low", "tracking_signal": "watch this",
        }
        for k, r in enumerate(prompt)
    ]
    return json.dumps(rows, ensure_ascii=False)


def run(spark, tmp_path, items, sources, ask):
    history = spark.createDataFrame([], "canonical_url string")
    return daily.run_daily(items, sources, history, "2024-01-31", F.lit("2024-01-31 00:00:00").cast("timestamp"), ask, "m", Snapshots(spark, str(tmp_path / "days")))


def test_published_after_one_repair(spark, tmp_path):
    asked = []

    def ask(prompt, error, text):
        asked.append((len(prompt), error))
        return response(prompt) if error else "no rows here"

    out = run(spark, tmp_path, raw(spark), runs(spark, True, True, False), ask)
    assert (out.status, out.code) == ("published", "none") and asked == [(4, None), (4, "json")]
    report, record = out.report.first(), out.record.first()
    assert [x["importance"] for x in report["items"]] == sorted((x["importance"] for x in report["items"]), reverse=True) and report.degraded and report.candidate_count == 4
    assert {r.source_id: (r.eligible_count, r.candidate_count, r.selected_count) for r in record.source_runs} == {"s0": (2, 2, 2), "s1": (2, 2, 2), "s2": (None, None, None)}
    store = Snapshots(spark, str(tmp_path / "days"))
    assert store.read("run_records", RUN_RECORDS).first().status == "published" and len(store.read("reports", REPORTS).first()["items"]) == 4
    assert store.read("index", INDEX).first().item_count == 4 and store.version() == 1


def test_failed_runs_leave_a_record(spark, tmp_path):
    none = run(spark, tmp_path, raw(spark), runs(spark, False, False), response)
    assert (none.status, none.code, none.report) == ("failed_before_publish", "no_healthy_sources", None)
    assert [r.recent_count for r in none.record.first().source_runs] == [None, None]
    empty = run(spark, tmp_path, raw(spark, 0), runs(spark, True), response)
    assert (empty.status, empty.code) == ("no_eligible_content", "no_eligible_candidates")
    assert [(r.candidate_count, r.selected_count) for r in empty.record.first().source_runs] == [(0, 0)]
    bad = run(spark, tmp_path, raw(spark, 2), runs(spark, True, True), lambda prompt, error, text: "[]")
    assert (bad.status, bad.code) == ("failed_before_publish", "analysis_failed")
    assert bad.record.first().source_runs[0].candidate_count == 1 and bad.record.first().source_runs[0].selected_count is None
    with pytest.raises(ValueError):
        daily.run_daily(raw(spark), runs(spark, True), None, "2024-01-31", None, None, "")


def test_a_failed_run_leaves_its_record_beside_an_earlier_report(spark, tmp_path):
    run(spark, tmp_path, raw(spark), runs(spark, True, True), response)
    bad = run(spark, tmp_path, raw(spark), runs(spark, True, True), lambda *_: "[]")
    store = Snapshots(spark, str(tmp_path / "days"))
    assert bad.code == "analysis_failed" and store.version() == 2
    assert store.read("run_records", RUN_RECORDS).first().safe_error_code == "analysis_failed" and len(store.read("reports", REPORTS).first()["items"]) == 4


def test_a_report_that_breaks_the_quota_is_not_published(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(daily.analysis, "within_quota", lambda rows, selected: rows.join(selected.select("id", "source_id"), "id"))
    crowd = raw(spark).withColumn("source_id", F.lit("s0"))
    bad = run(spark, tmp_path, crowd, runs(spark, True), response)
    store = Snapshots(spark, str(tmp_path / "days"))
    assert (bad.status, bad.code, bad.report) == ("failed_before_publish", "report_validation_failed", None)
    assert store.read("run_records", RUN_RECORDS).first().safe_error_code == bad.code and store.read("reports", REPORTS).isEmpty()


def test_raw_items_are_read_once(spark):
    """Counters and selection both come from the stored admitted rows."""
    from tidewire.operators import funnel

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    items = raw(spark)
    marked = items.withColumn("excerpt", seen("excerpt"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "canonical_url string")
    prepared = daily.prepare(marked, runs(spark, True, True), empty, now)
    assert read.value == 4 and prepared.candidates.count() == 4
    assert sorted(prepared.counts.collect()) == sorted(funnel.funnel_counts(items, empty, now).collect())


def dated(spark, **days):
    rows = [(dt.date(2024, 1, int(d[1:])), text) for d, text in days.items()]
    return spark.createDataFrame(rows, "date date, text string")


SHAPE = T.StructType([T.StructField("date", T.DateType()), T.StructField("text", T.StringType())])


def held(store, table="a", **more):
    return {r.date.day: r.text for r in store.read(table, SHAPE, **more).collect()}


def test_a_commit_replaces_its_days_in_all_tables_or_none(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.version() == 0 and held(store) == {}
    assert store.commit({"a": dated(spark, d1="x", d2="y"), "b": dated(spark, d1="z")}) == 1
    assert store.commit({"a": dated(spark, d2="Y", d3="w")}) == 2
    assert held(store) == {1: "x", 2: "Y", 3: "w"} and held(store, "b") == {1: "z"} and held(store, version=1) == {1: "x", 2: "y"}
    assert held(store, since="2024-01-02") == {2: "Y", 3: "w"}
    assert all("day=2024-01-01" not in f for f in store.read("a", SHAPE, since="2024-01-02").inputFiles())


def test_death_between_writing_and_publishing(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path))
    store.commit({"a": dated(spark, d1="x"), "b": dated(spark, d1="z")})
    monkeypatch.setattr(Snapshots, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.commit({"a": dated(spark, d1="new"), "b": dated(spark, d1="new")})
    monkeypatch.undo()
    again = Snapshots(spark, str(tmp_path))
    assert held(again) == {1: "x"} and held(again, "b") == {1: "z"} and again.version() == 1
    assert len(again.sweep()) == 1 and again.sweep() == [] and held(again) == {1: "x"}
    again.commit({"a": dated(spark, d1="new")})
    assert again.sweep(keep=2) == [] and held(again, version=1) == {1: "x"}
    # the first commit still holds table b, so only its manifest goes
    assert again.sweep() == ["manifests/000000000001.json"] and held(again) == {1: "new"} and held(again, "b") == {1: "z"}


def test_two_writers(spark, tmp_path):
    one, two = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    staged = one.stage({"a": dated(spark, d1="one")})
    two.commit({"a": dated(spark, d2="two")})
    with pytest.raises(Exception, match="already exists"):
        one.publish(0, staged)
    stage = one.stage

    def slow(tables):
        out = stage(tables)
        two.commit(others.pop()) if others else None
        return out

    one.stage = slow
    others = [{"a": dated(spark, d3="two")}]
    assert one.commit({"a": dated(spark, d1="one")}) == 3 and held(one) == {1: "one", 2: "two", 3: "two"}
    others = [{"a": dated(spark, d1="theirs")}]
    with pytest.raises(Conflict):
        one.commit({"a": dated(spark, d1="mine")})
    assert held(two)[1] == "theirs"


def test_a_roll_up_opens_as_many_folders_however_long_the_past(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    opened = []
    for day in range(1, 13):
        store.commit({"a": dated(spark, **{f"d{day}": f"row {day}"}).coalesce(1)})
        last = store.recent("a", SHAPE, 7)
        opened.append(len(last.inputFiles()))
        assert {r.date.day for r in last.collect()} == set(range(max(1, day - 6), day + 1))
    assert opened == [min(d, 7) for d in range(1, 13)] and store.recent("none", SHAPE, 7).isEmpty()

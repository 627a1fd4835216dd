"""Scans of stored tables: manifest, run records and reports."""

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.schema import REPORTS, RUN_RECORDS, SOURCE_SPECS


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Source dimension from a YAML manifest; defaults follow from the official flag."""
    import yaml

    entries = yaml.safe_load(Path(path).read_text(encoding="utf-8"))["sources"]
    rows = []
    for e in entries:
        official = e.get("official", True)
        rows.append((
            e["id"], e["name"], e["kind"], e.get("url"), e.get("repo"), e.get("adapter"), e.get("communities") or [], e["category"], e.get("weight", 5),
            official, e.get("role") or ("primary" if official else "trusted_media"), e.get("enabled", True),
        ))
    return spark.createDataFrame(rows, SOURCE_SPECS)


def _with_path(df: DataFrame) -> DataFrame:
    named = F.regexp_extract(F.input_file_name(), r"(\d{4}/\d{2}/\d{4}-\d{2}-\d{2})\.json$", 1)
    return df.withColumn("_named", named).withColumn("path_ok", F.col("_named") == F.date_format("date", "yyyy/MM/yyyy-MM-dd")).drop("_named")


def read_run_records(spark: SparkSession, root: str) -> DataFrame:
    """All run records below a folder, latest first, with whether the path agrees with the date."""
    d = spark.read.schema(RUN_RECORDS).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return _with_path(d).orderBy(F.col("date").desc())


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """All reports below a folder; older versions lack provenance, and their lane follows from the category."""
    d = spark.read.schema(REPORTS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "????-??-??.json").json(root)
    lane = lambda i: F.coalesce(i["editorial_lane"], F.when(i["category"] == "论文研究", "前沿研究").otherwise("产品工程"))
    fixed = F.transform("items", lambda i: i.withField("editorial_lane", lane(i)))
    d = d.withColumn("items", F.when(F.col("schema_version") != "1.1", fixed).otherwise(F.col("items")))
    return _with_path(d)


def indexed_reports(reports: DataFrame, index: DataFrame) -> DataFrame:
    """The reports that an index of (date, item_count) lists, latest first."""
    return reports.join(index.select("date"), "date", "left_semi").orderBy(F.col("date").desc())


def index_violations(reports: DataFrame, index: DataFrame) -> DataFrame:
    """(date, code): index entries without a report, with another number of items, or listed twice; any row fails a load."""
    held = reports.select("date", F.size("items").alias("_held"))
    both = index.join(held, "date", "left")
    code = F.when(F.col("_held").isNull(), "missing_report").when(F.col("_held") != F.col("item_count"), "item_count")
    wrong = both.select("date", code.alias("code")).where("code is not null")
    twice = index.groupBy("date").count().where("count > 1").select("date", F.lit("duplicate_entry").alias("code"))
    return wrong.unionByName(twice)


def exploded_runs(records: DataFrame) -> DataFrame:
    """One row per run date and source."""
    return records.select("date", F.posexplode("source_runs").alias("pos", "r")).select("date", "pos", "r.*")


def bytes_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Staged payload files as (path, payload) rows."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "utf-8").alias("payload"))

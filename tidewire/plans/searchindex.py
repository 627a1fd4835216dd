"""Text search through trigram postings, so that a search reads its share of the index and not all entries.

A stored index is a folder of three tables. ``entries`` holds the search entries by
``slot``, a hash of their id. ``postings`` holds (gram, id) for every run of three
characters of an entry's folded text, ``counts`` the entries of each gram; both are
partitioned by ``bucket``, a hash of the gram, and sorted, so that a gram's rows are
neighbours.

An entry holds a text only if it holds all of the text's grams. A search reads the
counts of its grams, then the postings of the few rarest, and the entries of
the slots that these name; the text itself is then looked for in those entries.
The outcome is that of ``readmodels.search``. Texts of one or two characters have no gram and scan the entries.

Edge cases: null fields are left out of an entry's text; rows of one id are found
together; a gram in a third of all entries is dealt to many tasks when written,
by ranges of id, and is read only if the text has no rarer grams; entries without an
id are found by scans only, so none may be stored. An empty table makes an empty index.
"""

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.plans import readmodels

WIDTH = 3
BUCKETS = 64
KEYS = 4
POSTINGS = "gram string, id string, bucket int"
MADE = "buckets int, ascii_only boolean, shape string"
COUNTS = "gram string, entries long, bucket int"


def grams(text: Column) -> Column:
    """The distinct runs of ``WIDTH`` characters of a text."""
    chars = F.split(text, "")
    starts = F.when(F.length(text) >= WIDTH, F.sequence(F.lit(0), F.length(text) - WIDTH)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(WIDTH)])))


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + WIDTH] for i in range(len(text) - WIDTH + 1)})


def _hashed(value: Column, buckets: int) -> Column:
    return (F.crc32(value.cast("binary")) % buckets).cast("int")


def _written(df: DataFrame, path: str, part: str, order: list[str]) -> None:
    """By ranges of part and order: no task gets more than its share, and a file holds neighbours."""
    df.repartitionByRange(part, *order).sortWithinPartitions(part, *order).write.partitionBy(part).parquet(path)


def write(entries: DataFrame, path: str, buckets: int = BUCKETS, ascii_only: bool = False) -> None:
    """Store an index of search entries, each with a text ``id``, in a new folder."""
    spark = entries.sparkSession
    _written(entries.withColumn("slot", _hashed(F.col("id"), buckets)), f"{path}/entries", "slot", ["id"])
    stored = spark.read.schema(T.StructType([*entries.schema.fields, T.StructField("slot", T.IntegerType())])).parquet(f"{path}/entries")
    held = stored.select("id", readmodels.searched_text(ascii_only).alias("folded")).select("id", F.explode(grams(F.col("folded"))).alias("gram")).withColumn("bucket", _hashed(F.col("gram"), buckets))
    _written(held, f"{path}/postings", "bucket", ["gram", "id"])
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("entries"))
    _written(counts, f"{path}/counts", "bucket", ["gram"])
    spark.createDataFrame([(buckets, ascii_only, stored.schema.json())], MADE).coalesce(1).write.json(f"{path}/made")


def _rows_of(table: DataFrame, names: list[str], buckets: int) -> DataFrame:
    parts = sorted({zlib.crc32(g.encode()) % buckets for g in names})
    return table.where(F.col("bucket").isin(parts) & F.col("gram").isin(names))


def postings(spark: SparkSession, path: str, text: str, buckets: int = BUCKETS, keys: int = KEYS) -> DataFrame | None:
    """(gram, id): postings of the rarest grams of a folded text, none if a gram is in no entry; null for a text without grams."""
    wanted = grams_of(text)
    if not wanted:
        return None
    counts = _rows_of(spark.read.schema(COUNTS).parquet(f"{path}/counts"), wanted, buckets).select("gram", "entries").collect()  # a row each of the text's own grams
    rarest = [r.gram for r in sorted(counts, key=lambda r: (r.entries, r.gram))[:keys]] if len(counts) == len(wanted) else []
    return _rows_of(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), rarest, buckets).select("gram", "id")


def candidates(found: DataFrame, keys: int, buckets: int) -> DataFrame:
    """(slot, id) of entries in the postings of all ``keys`` grams."""
    held = found.groupBy("id").agg(F.count_distinct("gram").alias("n"))
    return held.where(F.col("n") == keys).select(_hashed(F.col("id"), buckets).alias("slot"), "id")


def search(spark: SparkSession, path: str, query: str = "", keys: int = KEYS, **filters) -> DataFrame:
    """The rows of ``readmodels.search(entries, query, **filters)`` for the entries stored under ``path``."""
    made = spark.read.schema(MADE).json(f"{path}/made").first()
    entries = spark.read.schema(T.StructType.fromJson(json.loads(made.shape))).parquet(f"{path}/entries")
    text = readmodels.folded_query(query)
    found = postings(spark, path, text, made.buckets, keys)
    among = None if found is None else candidates(found, min(keys, len(grams_of(text))), made.buckets)
    return readmodels.search(entries, query, ascii_only=made.ascii_only, among=among, **filters).drop("slot")

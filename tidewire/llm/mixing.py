"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

``targets`` shares a word budget out among sources by weight, holding every
source to at most ``cap`` times its own size and resharing the excess (water
filling, solved in closed form over the sources sorted by saturation point).

``mix`` takes whole epochs of a source first; the fraction that is left is filled
with the documents of the smallest exponential keys ``-ln(u) / w``, where ``u``
is a hash of the id (reruns agree) and ``w`` a quality weight, the share of
letters in the text. The prefix sum along the keys is built in two levels: sums
of key buckets per source, and running sums inside a bucket. A source that holds
a third of all rows is thus spread over thousands of buckets. Buckets are steps of
the logarithm of the key: a weight only shifts it, so whatever the weights, no
bucket is expected to hold more than 1 / (e * ``buckets``) of a source's rows. The document
at the cut is taken if that brings the source nearer to its target.

Edge cases: null text has size 0 and weight of the least quality; a null source
is a source of its own and sorts last; sources of size 0 get target 0; ties of
keys follow the id, then the size, then a hash of the text, so rows of one id (or
none) come in a fixed order, and rows that are alike in all of these are exchangeable;
a repeated row is drawn on its own; very long texts are one row like any other;
an empty table gives an empty result; other columns are ignored. Sources are
ranked in one task, a row each.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.materialize import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKETS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, size, tie, key, bucket) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    weight = F.greatest(F.lit(0.05), letters / F.greatest(F.length(text), F.lit(1)))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    out = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(text).alias("tie"), (-F.log(u) / weight).alias("key"))
    return out.withColumn("bucket", F.floor(F.log("key") * buckets))


def _tag(source):
    """A key that sorts sources by code point and null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (tag, source_size): adds target, epochs and rest. One row per source."""
    order = Window.orderBy("tag")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    s = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(cap))
    rise = Window.orderBy(F.col("limit") / F.col("weight"), "tag")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(whole) * share
    s = s.withColumn("level", (budget - before) / above)
    s = s.withColumn("open", F.col("level") <= F.col("limit") / F.col("weight"))
    s = s.withColumn("fill", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("limit") / F.col("weight"))).over(whole))
    s = s.withColumn("target", F.when(F.col("fill").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("fill") * F.col("weight"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    s = s.withColumn("epochs", epochs.cast("long"))
    return s.select("tag", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    d = cut(sized(docs, buckets), "mix-docs").withColumn("tag", _tag(F.col("source")))
    part = d.groupBy("tag", "bucket").agg(F.sum("size").alias("bucket_size"))
    part = cut(part, "mix-parts")
    goal = targets(part.groupBy("tag").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    ahead = F.sum("bucket_size").over(Window.partitionBy("tag").orderBy("bucket")) - F.col("bucket_size")
    part = cut(part.select("tag", "bucket", ahead.alias("ahead")).join(goal, "tag"), "mix-goals")
    within = Window.partitionBy("tag", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("run", F.sum("size").over(within)).join(part, ["tag", "bucket"])
    chosen = (F.col("ahead") + F.col("run") - F.col("size") / 2.0 < F.col("rest")) & (F.col("size") > 0)
    copies = F.col("epochs") + F.when(chosen, 1).otherwise(0)
    return d.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS tag,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / greatest(0.05::DOUBLE, length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::DOUBLE / greatest(length(t), 1)::DOUBLE) AS key
  FROM d),
s AS (
  SELECT tag, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY tag) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM k GROUP BY tag),
l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, tag ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
f AS (SELECT min_by(level, cap / weight) AS fill FROM l WHERE level <= cap / weight),
g AS (
  SELECT tag, source_size, CASE WHEN fill IS NULL THEN cap ELSE least(cap, fill * weight) END AS target FROM l, f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
r AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.tag ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM k JOIN e USING (tag))
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN run - size / 2.0::DOUBLE < rest AND size > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""

"""Scores, total orders, quotas and top-k selections."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import rules, text, times
from tidewire.plans.materialize import cut
from tidewire.schema import RESEARCH

ROLE_BONUS = {"primary": 14, "trusted_media": 8, "discovery": 0}
SCARCITY = 6


def completeness(excerpt: Column) -> Column:
    return F.least(F.lit(12), F.floor(F.length(F.regexp_replace(excerpt, r"(?U)^\s+|\s+$", "")) / 80)).cast("int")


def channel_key(category: Column) -> Column:
    """Channel that a category competes in; research has none."""
    return F.when(category == "Coding Agent", "Agent").when(category != RESEARCH, category)


def candidate_score(now: Column, folded: Column | None = None) -> Column:
    """Integer score of a candidate row: weight, recency, role, office, excerpt and keyword."""
    folded = text.fold_title(F.col("title")) if folded is None else folded
    bonus = F.create_map(*[F.lit(x) for pair in ROLE_BONUS.items() for x in pair])
    return (
        F.col("source_weight") * 4
        + times.recency_score(F.col("published_at"), now)
        + F.element_at(bonus, F.col("source_role"))
        + F.when(F.col("is_official_source"), 8).otherwise(0)
        + completeness(F.col("excerpt"))
        + F.when(rules.has_keyword(folded), 6).otherwise(0)
    ).cast("int")


def channel_counts(candidates: DataFrame) -> DataFrame:
    """(channel, in_channel): candidates of every channel, research left out."""
    d = candidates.select(channel_key(F.col("category_hint")).alias("channel"))
    return d.where("channel is not null").groupBy("channel").agg(F.count("*").alias("in_channel"))


def scored(candidates: DataFrame, now: Column, folded: Column | None = None) -> DataFrame:
    """Adds score, scarcity (rarer channels in this list get more) and total.

    Counts are aggregated before they are joined back, and the planner chooses how
    by their size; no row list of a channel is ever gathered.
    """
    d = candidates.withColumn("score", candidate_score(now, folded)).withColumn("channel", channel_key(F.col("category_hint")))
    d = d.join(channel_counts(candidates), "channel", "left")
    scarcity = F.when(F.col("channel").isNull(), 0).otherwise(F.greatest(F.lit(0), SCARCITY - F.least("in_channel", F.lit(SCARCITY))))
    d = d.withColumn("scarcity", scarcity.cast("int"))
    return d.withColumn("total", F.col("score") + F.col("scarcity")).drop("in_channel", "channel")


def rank_order() -> list[Column]:
    return [F.col("total").desc(), F.col("published_at").desc(), F.col("id").asc()]


def top(candidates: DataFrame, now: Column, limit: int = 30, folded: Column | None = None) -> DataFrame:
    """The best rows in rank order, with their rank."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    best = scored(candidates, now, folded).orderBy(*rank_order()).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def _per_source(d: DataFrame, cap: int) -> DataFrame:
    return d.withColumn("in_source", F.row_number().over(Window.partitionBy("source_id").orderBy(*rank_order()))).where(F.col("in_source") <= cap)


def balanced(
    candidates: DataFrame, now: Column, limit: int = 36, per_source: int = 6, unofficial_per_source: int | None = None, folded: Column | None = None
) -> DataFrame:
    """The best rows with at most so many of each source.

    The cap is a rank filter, so it is applied in every task before the shuffle.
    A source is official or not as a whole; the manifest sees to that.
    """
    if limit < 0 or per_source <= 0 or (unofficial_per_source is not None and unofficial_per_source <= 0):
        raise ValueError("limits must be positive")
    low = per_source if unofficial_per_source is None else unofficial_per_source
    d = _per_source(scored(candidates, now, folded), max(per_source, low))
    d = d.where(F.col("in_source") <= F.when(F.col("is_official_source"), per_source).otherwise(low))
    d = d.orderBy(*rank_order()).limit(limit)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def diverse(candidates: DataFrame, now: Column, limit: int, source_floor: int, folded: Column | None = None) -> DataFrame:
    """Each source's best rows first, then the best of the rest, in rank order.

    No source can place more than ``limit`` rows, so a rank filter cuts every
    source down to that in each task before the shuffle.
    """
    if limit < 0 or source_floor <= 0:
        raise ValueError("limits must be positive")
    d = _per_source(scored(candidates, now, folded), max(limit, 1))
    d = d.orderBy((F.col("in_source") > source_floor).asc(), *rank_order()).limit(limit)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def publish_order() -> list[Column]:
    return [F.col("importance").desc(), F.col("published_at").desc(), F.col("id").asc()]


def numbered(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """Adds the place (from 1) of every row in a total order, within groups.

    Rows are dealt out by ranges of group and order, so a group of any size is
    sorted by many tasks; a row's place is its place in its range plus the rows of
    its group in the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt, "rk-ranges")  # stored, as sampled ranges may differ from run to run
    own = ["_range", *by]
    sizes = dealt.groupBy(*own).agg(F.count("*").alias("_n"))
    before = sizes.select(*own, (F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_before")).toDF(*[f"_k{i}" for i in range(len(own))], "_before")
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))
    d = inside.join(before, [inside[c].eqNullSafe(before[f"_k{i}"]) for i, c in enumerate(own)])
    return d.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def paginated(df: DataFrame, order: list[Column], page_size: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds position (from 1) and page in the given order."""
    if page_size < 1:
        raise ValueError("page_size must be at least one")
    return numbered(df, order, by).withColumn("page", (F.floor((F.col("position") - 1) / page_size) + 1).cast("int"))


def page_counts(pages: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """(by, pages) of every group: as many pages as its rows fill, and one empty page where it has none."""
    last = pages.groupBy(by).agg(F.max("page").alias("_last"))
    return groups.select(by).distinct().join(last, by, "left").select(by, F.coalesce("_last", F.lit(1)).alias("pages"))


def source_quota_violations(items: DataFrame, most: int = 2) -> DataFrame:
    return items.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") > most)

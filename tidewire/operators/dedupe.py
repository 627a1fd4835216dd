"""Duplicate groups of candidates: exact keys, event keys and similar titles.

Rows that share a key are joined through one representative of the key, so a key
that a third of all rows hold costs one edge per row; groups are the connected
components of these edges and are found without gathering them.
"""

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import rules, text, urls
from tidewire.operators import grouping, ranking
from tidewire.operators.graph import connected_components
from tidewire.plans.materialize import cut, settled

THRESHOLD = 0.92
#: Bits for the numbered characters of titles below 128 characters; the next class is of twice the length and bits. Neighbours have four times as many.
BITS = 128
#: Rows of a block of titles: no more, and, so that there are tasks enough, no more than one of so many parts of them, but not too few.
BLOCK_ROWS, PARTS, LEAST_ROWS = 65536, 24, 1024
#: Titles of one length are held in the order of how many of these they have; any letters are right, these tell some languages apart.
LETTERS = "bdghknrstwy"


def preference() -> list[Column]:
    """Total order in which rows of a group are preferred."""
    role = F.when(F.col("source_role") == "primary", 0).when(F.col("source_role") == "trusted_media", 1).otherwise(2)
    trimmed = F.length(F.regexp_replace("excerpt", r"(?U)^\s+|\s+$", ""))
    return [
        role.asc(), F.col("is_official_source").desc(), F.col("discovery_verified").desc(), F.col("source_weight").desc(), trimmed.desc(),
        F.col("published_at").desc(), F.col("id").asc(), F.col("source_id").asc(), F.col("source_name").asc(), F.col("title").asc(),
        F.col("excerpt").asc(), F.col("category_hint").asc(), F.col("is_official_source").asc(), F.col("url").asc(),
    ]


def preference_key() -> Column:
    """The order of ``preference`` as an array of texts and one of numbers, smaller first, for code that compares rows one by one."""
    role = F.when(F.col("source_role") == "primary", 0).when(F.col("source_role") == "trusted_media", 1).otherwise(2)
    trimmed = F.length(F.regexp_replace("excerpt", r"(?U)^\s+|\s+$", ""))
    down = [F.col("is_official_source").cast("long"), F.col("discovery_verified").cast("long"), F.col("source_weight").cast("long"), trimmed.cast("long"), F.unix_micros("published_at")]
    last = F.lit(2**62)  # nulls come last where larger values come first
    text = [F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("")) for c in ("id", "source_id", "source_name", "title", "excerpt", "category_hint", "url")]
    return F.struct(F.array(role.cast("long"), *[F.coalesce(-x, last) for x in down]).alias("n"), F.array(*text).alias("t"))


def preferred(rows: DataFrame, *group: str) -> DataFrame:
    """The preferred row of every group.

    Ranked within a task first (a rank filter is applied before the shuffle), so
    a group of any size sends one row per task.
    """
    w = Window.partitionBy(*group).orderBy(*preference())
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def first_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def difference(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that ``other`` does not hold; both have the same columns, and nulls are equal to each other."""
    both = [rows[c].eqNullSafe(other[c]) for c in rows.columns]
    return rows.distinct().join(other, both, "left_anti")


def components(rows: DataFrame, node: str, keys: list[Column]) -> DataFrame:
    """(node, component) of rows that share any of the keys, directly or through others; null keys join nothing."""
    each = F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{i}|"), k)) for i, k in enumerate(keys)])
    held = rows.select(F.col(node).alias("n"), F.explode(each).alias("k")).where("k is not null")
    held = cut(held, "dd-keys")
    hub = cut(held.groupBy("k").agg(F.min("n").alias("hub"), F.max("n").alias("last")).where("hub < last").select("k", "hub"), "dd-hubs")
    found = connected_components(held.join(hub, "k").select("n", "hub"), "n", "hub")
    out = rows.select(F.col(node).alias("node")).join(found, "node", "left")
    return out.select(F.col("node").alias(node), F.coalesce("component", "node").alias("component"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds a 64-bit row number that reruns agree on: rows are stored with it."""
    return cut(rows.withColumn("_row", F.monotonically_increasing_id()), "dd-rows")


def title_key(folded: Column) -> Column:
    return F.concat(urls.host(F.col("canonical_url")), F.lit("|"), folded)


def exact_winners(candidates: DataFrame, folded: Column | None = None) -> DataFrame:
    """First phase: one row per group of equal address or equal host and title."""
    folded = text.fold_title(F.col("title")) if folded is None else folded
    rows = _numbered(candidates.withColumn("_folded", folded))
    found = components(rows, "_row", [F.col("canonical_url"), title_key(F.col("_folded"))])
    return preferred(rows.join(found, "_row"), "component").drop("_row", "component", "_folded")


def event_winners(winners: DataFrame, folded: Column | None = None) -> DataFrame:
    """Second phase, on the winners of the first: the event key joins rows as well."""
    folded = text.fold_title(F.col("title")) if folded is None else folded
    rows = _numbered(winners.withColumn("_folded", folded))
    keys = [F.col("canonical_url"), title_key(F.col("_folded")), rules.event_key(F.col("_folded"))]
    found = components(rows, "_row", keys)
    return preferred(rows.join(found, "_row"), "component").drop("_row", "component", "_folded")


def similar(a: str, b: str, threshold: float = THRESHOLD) -> bool:
    """Equal titles, or a matching ratio of at least the threshold in both directions."""
    return a == b or all(SequenceMatcher(None, x, y).ratio() >= threshold for x, y in ((a, b), (b, a)))


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def marks(text: str, width: int) -> np.ndarray:
    """Whether an odd number of a text's characters (``width`` bits) and of its pairs of neighbours (four times as many), each with its count so far, fall on each bit."""
    out = []
    for parts, bits in ((text, width), (zip(text, text[1:]), 4 * width)):
        seen: dict = {}
        at = []
        for x in parts:
            k = seen[x] = seen.get(x, 0) + 1
            code = ord(x) if isinstance(x, str) else ord(x[0]) * 1114112 + ord(x[1])
            at.append((code * 1021 + k) * 0x9E3779B97F4A7C15 >> 40 & bits - 1)
        out.append(np.packbits((np.bincount(np.array(at, int), minlength=bits) & 1).astype(bool), bitorder="little").view(np.int64))
    return np.concatenate(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _marks(value: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([marks(v, w) for v, w in zip(value, width, strict=True)], dtype=object)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int32)


def _meeting(threshold: float, once: int = 64, wide: int = 4096, sent: int = 100_000):
    """Of two blocks of titles of one class, or of one, the pairs that the marks leave; ``once`` longer and ``wide`` shorter titles are held against each other at a time."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        node, n, s, block = (rows[c].to_numpy() for c in ("node", "n", "s", "block"))
        order = np.lexsort((node, s, n, block))
        node, n, s, block = node[order], n[order].astype(np.int64), s[order].astype(np.int64), block[order]
        words = rows["marks"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)[order]
        del rows
        one = words.shape[1] // 5  # words of numbered characters
        half = one // 2
        low = 32 * one if 64 * one > BITS else 0  # a pair belongs to the class of its longer title
        first = np.ascontiguousarray(words[:, :half].T)
        cut_at = int(np.searchsorted(block, block[-1]))  # from here on the later block, of the longer titles
        same = cut_at == 0
        end = len(n) if same else cut_at
        key = n[:end] << 32 | s[:end]
        lengths = np.unique(n[:end])
        diff, some, bits = (np.empty(once * wide, kind) for kind in (np.uint64, np.uint8, np.int32))
        found: list[np.ndarray] = []
        held = 0
        x0 = cut_at
        while x0 < len(n):
            long = n[x0]
            x1 = min(x0 + once, int(np.searchsorted(n[cut_at:], long, "right")) + cut_at)
            for short in lengths[(lengths >= (long * threshold / (2 - threshold) - 1e-6)) & (lengths <= long)] if long >= low else ():
                left_out = int((1 - threshold) * (long + short) + 1e-9)
                only_x, only_y = (left_out + long - short) // 2, (left_out - long + short) // 2
                if only_y < 0:
                    continue
                y0, y2 = np.searchsorted(key, [short << 32 | max(s[x0] - only_x, 0), (short << 32 | s[x1 - 1] + only_y) + 1])
                if same and short == long:
                    y2 = min(y2, x1)
                for y0 in range(y0, y2, wide):
                    y1 = min(y0 + wide, y2)
                    d, c, b = (m[: (x1 - x0) * (y1 - y0)].reshape(x1 - x0, -1) for m in (diff, some, bits))
                    for w in range(half):
                        np.bitwise_xor(first[w, x0:x1, None], first[w, None, y0:y1], out=d)
                        np.bitwise_count(d, out=c)
                        if half > 1:
                            np.add(b, c, out=b) if w else np.copyto(b, c)
                    x, y = np.divmod(np.flatnonzero((b if half > 1 else c) <= left_out), y1 - y0)
                    x, y = x + x0, y + y0
                    if same and short == long:
                        x, y = x[y < x], y[y < x]
                    for part, most in ((slice(0, one), left_out), (slice(one, None), 3 * left_out)):
                        kept = [_differing(words[x[i : i + wide], part], words[y[i : i + wide], part]) <= most for i in range(0, len(x), wide)]
                        kept = np.concatenate(kept) if kept else np.zeros(0, bool)
                        x, y = x[kept], y[kept]
                    if len(x):
                        found.append(np.sort(np.stack([node[x], node[y]]), axis=0))
                        held += len(x)
                    if held >= sent:
                        yield pa.RecordBatch.from_arrays(list(np.concatenate(found, axis=1)), ["a", "b"])
                        found, held = [], 0
            x0 = x1
        if held:
            yield pa.RecordBatch.from_arrays(list(np.concatenate(found, axis=1)), ["a", "b"])

    return met


def similar_pairs(titles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with a < b of (node, value) rows whose titles are similar but not equal.

    Titles x and y match at the threshold t only if at most ``(1 - t)(|x| + |y|)``
    characters stay unmatched on both sides. No key that titles share tells such pairs from the rest (a tenth of all titles
    may have one ending), so all titles of fitting lengths are held against each other, by bits of numbered characters and neighbours, of which
    each unmatched character changes one and three at most. No pair is lost. Titles are sorted by length and dealt into blocks; a task takes two
    blocks, and only what the bits leave is stored. Edit distance comes next, then the titles themselves.
    """
    t = titles.select("node", "value", F.length("value").cast("int").alias("n")).where("n > 0")
    longest = F.floor(F.col("n") * F.lit((2 - threshold) / threshold) + 1e-9)
    of = lambda n: F.greatest(F.lit(BITS), F.pow(F.lit(2.0), F.length(F.bin(n)))).cast("int")  # noqa: E731  twice the largest power of two within the length
    t = t.withColumn("width", F.explode(F.array_distinct(F.array(of(F.col("n")), of(longest)))))
    t = t.withColumn("s", F.length(F.regexp_replace("value", f"[^{LETTERS}]", "")).cast("int"))
    t = t.withColumn("marks", _marks(F.col("value"), F.col("width"))).drop("value")
    t = cut(ranking.numbered(cut(t, "fz-titles"), [F.col("n"), F.col("s"), F.col("node")], ("width",), "_at"), "fz-sorted")
    size = t.groupBy("width").agg(F.count("*").alias("all"))
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_ROWS) * BITS / F.col("width")))
    size = size.select("width", F.least(most, F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("all") / PARTS))).cast("long").alias("rows"))
    block = F.floor((F.col("_at") - 1) / F.col("rows")).cast("long").alias("block")
    ends = cut(t.join(size, "width").groupBy("width", block).agg(F.min("n").alias("least"), F.max("n").alias("most")), "fz-blocks")
    early, late = (ends.select(F.col("width"), *[F.col(c).alias(f"{c}{x}") for c in ("block", "least", "most")]) for x in "ij")
    due = early.join(late, "width").where((F.col("blocki") <= F.col("blockj")) & (F.col("leastj") * F.lit(threshold / (2 - threshold)) - 1e-6 <= F.col("mosti")))
    due = due.where((F.col("width") <= BITS) | (F.col("mostj") * 2 >= F.col("width"))).select("width", "blocki", "blockj")
    due = cut(due.withColumn("block", F.explode(F.array_distinct(F.array("blocki", "blockj")))), "fz-due")
    tasks = min(due.count(), 4000)
    rows = t.join(size, "width").select("width", block, "node", "n", "s", "marks").join(due, ["width", "block"])
    if tasks:
        rows = rows.repartition(tasks, "width", "blocki", "blockj")
    pairs = cut(rows.groupBy("width", "blocki", "blockj").applyInArrow(_meeting(threshold), "a long, b long"), "fz-pairs")
    left, right = (titles.select(F.col("node").alias(x), F.col("value").alias(f"v{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    # unmatched characters on both sides are at least as many as edits
    both = both.withColumn("most", F.floor(F.lit(1 - threshold) * (F.length("va") + F.length("vb")) + 1e-9).cast("int"))
    both = both.where(F.expr("levenshtein(va, vb, most)") >= 0)
    return both.where(_similar(F.col("va"), F.col("vb"))).select("a", "b")


def fuzzy_winners(winners: DataFrame, folded: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Third phase: rows join, in order of preference, the first group all of whose titles are similar.

    A later row of a title always ends in the group of the first, so each title is
    first cut down to its preferred row; a title that a third of all rows share is
    one row from then on. The greedy grouping works on links of similar titles, in rounds.
    """
    folded = text.fold_title(F.col("title")) if folded is None else folded

    def placed() -> DataFrame:
        rows = cut(preferred(_numbered(winners.withColumn("_folded", folded)), "_folded"), "fz-rows")
        return ranking.numbered(rows, preference(), name="_place")

    rows = settled(placed, "fz-placed")  # whole rows are kept once while their titles are compared
    pairs = cut(similar_pairs(rows.select(F.col("_place").cast("long").alias("node"), F.col("_folded").alias("value")), threshold), "fz-links")
    parts = cut(connected_components(pairs, "a", "b"), "fz-parts")
    later = grouping.greedy_heads(pairs, parts).where("row <> head").select(F.col("row").alias("_place"))
    return rows.join(later, "_place", "left_anti").drop("_row", "_folded", "_place")


def deduplicate(candidates: DataFrame, history: DataFrame, max_items: int | None = None, folded: Column | None = None) -> DataFrame:
    """Second and third phase on rows whose address is not in ``history`` (canonical_url).

    ``max_items`` restores the small pipeline's guard; without it the input may be of any size. Rows come in the order of their id.
    """
    if max_items is not None and candidates.count() > max_items:
        raise ValueError(f"at most {max_items} candidates")
    fresh = candidates.join(history.select("canonical_url").distinct(), "canonical_url", "left_anti")
    return fuzzy_winners(event_winners(fresh, folded), folded).orderBy("id")

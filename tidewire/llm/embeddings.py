"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by the order of its nearest pivots, the reference points
that the index was fitted with. Inverted lists are kept per set of ``depth``
pivots: a vector is filed under its ``depth`` nearest ones and looks for partners
under every such set of its ``width`` nearest. The depth wanted follows from the number
of vectors, so that there are about as many lists as vectors. How far to look for that is measured: the pivots' sample
is given partners at the very threshold, and the width is the smallest at which ``TARGET`` of these pairs meet and pass; where
that takes more than ``MOST_LISTS`` lists, the depth is lowered. So recall does not fall as tables grow; it is the number of
looks that grows. Two vectors that meet in a list
are compared by the number of pivots that their ``prefix`` nearest share; those
with at least ``shared`` are verified by their cosine in double precision.

Lists are looked up by narrow rows first, those that hold nobody are mostly ruled out by a bit table of fixed size before
any row travels; vectors, as they were given and with their nearest pivots alone, travel only to lists where they
meet others. Small lists are worked on many at a time; a list that holds a third
of all rows is worked on in tiles of bounded size. A tile hands on a number of
links per vector and a star per group of linked vectors, never its pairs.

The pivots come from a bounded sample of the vectors (``n_pivots`` of them, by a
hash of the id); every row is indexed. Equal vectors are one class, so copies are
compared once and counted by their number.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of another
length than the commonest are compared among themselves only (lists are kept per
length); ties of pivots go to the lower pivot; a null id is returned with no
links; repeated rows count as copies; rows of one id with unlike vectors are
compared like others; vectors of any length are read whole; an empty table gives
an empty result; labels and other columns are ignored.
"""

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import connected_components, min_labels
from tidewire.plans.materialize import cut

THRESHOLD = 0.95
PIVOTS = 256
PREFIX = 10
SHARED = 3
TILE = 1024
#: Numbers before the pivots of a vector, and bits of the table of full lists (2 MB).
HEAD, SLOTS = 5, 1 << 24
#: Measured share of sampled pairs at the threshold that must be found, and most lists that a vector may look in for it.
TARGET, MOST_LISTS = 0.97, 256


def usable(vector):
    """Whether a vector can have a cosine."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def depth_for(n: int, pivots: int) -> int:
    """The number of pivots that name a list: the smallest that makes as many lists as there are vectors."""
    depth = 1
    while depth < min(8, pivots) and comb(pivots, depth) < n:
        depth += 1
    return depth


def plan_lists(n: int, pivots: np.ndarray, sample: np.ndarray, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> tuple[int, int, int]:
    """(depth, width, least): how lists are named, how far to look and how many pivots to share, so that sampled pairs at the threshold are found."""
    rng = np.random.default_rng(7)

    def beside(v: np.ndarray, cosine: float) -> np.ndarray:
        side = rng.normal(size=v.shape)
        side -= (side * v).sum(1, keepdims=True) * v
        return cosine * v + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)

    if sample.shape[1] == 1:
        return 1, len(pivots), 1
    # first a step aside, as some of the sample are pivots themselves
    v = beside(np.repeat(sample, max(1, 400 // len(sample)), axis=0), (1 + threshold) / 2)
    other = beside(v, threshold)
    reach = min(len(pivots), max(prefix, 16))
    a, b = (np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :reach] for x in (v, other))
    # the place among the other's nearest pivots of each of one's own, or past the end
    there = [np.where((x[:, :, None] == y[:, None, :]).any(2), (x[:, :, None] == y[:, None, :]).argmax(2), reach) for x, y in ((a, b), (b, a))]
    common = (there[0][:, :prefix] < prefix).sum(1)
    least = next((s for s in range(min(shared, len(pivots)), 1, -1) if (common >= s).mean() >= (1 + TARGET) / 2), 1)
    for depth in range(depth_for(n, len(pivots)), 0, -1):
        # how far the other must look to meet one's own list
        far = np.minimum(*[x[:, :depth].max(1) for x in there])
        for width in range(min(reach, max(depth + 2, 5)), reach + 1):
            if comb(width, depth) > MOST_LISTS:
                break
            if ((far < width) & (common >= least)).mean() >= TARGET:
                return depth, width, least
    return 1, reach, least


def fit_pivots(classes: DataFrame, n: int = PIVOTS, threshold: float = THRESHOLD) -> dict[int, tuple[np.ndarray, int, int, int]]:
    """Unit pivots, depth and width of the lists, and least pivots to share, by vector length, from about 4 n vectors that a hash of the id picks."""
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 4.0 * n / c))])
    place = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    rows = classes.where(place < F.element_at(share, F.col("dim"))).select("dim", place.alias("place"), "vector").collect()
    out = {}
    for dim in counts:
        own = [r["vector"] for r in sorted((r for r in rows if r["dim"] == dim), key=lambda r: (r["place"], r["vector"]))]
        if not own:  # none of few rows was picked
            own = [r["vector"] for r in classes.where(F.col("dim") == dim).orderBy("rep", "vector").limit(n).collect()]
        sample = _unit(np.array(own, float).reshape(-1, dim))
        p = _spread(sample, n)
        out[dim] = (p, *plan_lists(counts[dim], p, sample, threshold))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _spread(v: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of v, leaving out those that lie close to one already taken."""
    taken: list[int] = []
    late: list[int] = []
    for i in range(len(v)):
        if len(taken) == n:
            break
        (late if taken and (v[taken] @ v[i]).max() > 0.8 else taken).append(i)
    return v[(taken + late)[:n]]


def _lists(order: np.ndarray, depth: int, width: int, dim: int) -> np.ndarray:
    """The lists under which each row is filed (the first) and looks, as hashes of sets of its nearest pivots."""
    out = []
    for some in combinations(range(min(order.shape[1], width)), depth):
        h = np.full(len(order), dim, np.uint64)
        for c in np.sort(order[:, some], axis=1).T:
            h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h.view(np.int64))
    return np.stack(out, 1)


def describe(classes: DataFrame, pivots: dict[int, tuple[np.ndarray, int, int, int]], prefix: int = PREFIX) -> DataFrame:
    """(cls, copies, vector, head): the components as bytes, and what ``_heads`` reads: the plan of its length and its nearest pivots."""
    held = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                v = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                v = v if v.dtype == np.float32 else v.astype(float)
                p, depth, width, shared = held.value[int(dim)]
                order = np.argsort(-(_unit(v.astype(float)) @ p.T), axis=1, kind="stable")[:, : max(prefix, width)]
                head = np.empty((len(v), HEAD + order.shape[1]), np.uint16)
                head[:, :HEAD] = depth, width, shared, min(prefix, order.shape[1]), v.dtype.itemsize
                head[:, HEAD:] = order
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x.tobytes() for x in v]), pa.array([x.tobytes() for x in head])], ["cls", "copies", "vector", "head"]
                )

    return classes.select("cls", "copies", "dim", "vector").mapInArrow(run, "cls long, copies long, vector binary, head binary")


def _heads(heads: Iterable[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(depth, width, least pivots to share, prefix, bytes of a component) and the nearest pivots of each of n vectors of one length."""
    head = np.frombuffer(b"".join(heads), np.uint16).reshape(n, -1)
    return head[0, :HEAD].astype(int), head[:, HEAD:]


def _compare(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of the verified links of the lists of one tile; a looks, b is filed."""
    none = np.zeros(0, np.int64)
    found_i, found_j = [none], [none]
    for dim in sorted(set(a.vector.str.len()) & set(b.vector.str.len())):  # lists of several lengths may be worked on together
        at_a, at_b = (np.flatnonzero((x.vector.str.len() == dim).to_numpy()) for x in (a, b))
        x, y = a.iloc[at_a], b.iloc[at_b]
        (depth, width, least, prefix, size), order_a = _heads(x["head"], len(x))
        order_b = _heads(y["head"], len(y))[1]
        ua, ub = (_unit(np.frombuffer(b"".join(z.vector), f"f{size}").astype(float).reshape(len(z), -1)) for z in (x, y))
        words = max(order_a.max(), order_b.max()) // 64 + 1
        bits = [np.zeros((len(z), words * 64), np.uint8) for z in (order_a, order_b)]
        for m, z in zip(bits, (order_a, order_b), strict=True):
            np.put_along_axis(m, z[:, :prefix].astype(np.int64), 1, axis=1)
        ma, mb = (np.packbits(m, axis=1).view(np.uint64) for m in bits)
        ids_a, ids_b, list_a, list_b = x.cls.to_numpy(), y.cls.to_numpy(), x["list"].to_numpy(), y["list"].to_numpy()
        for s in range(0, len(x), 256):
            i, j = np.nonzero(list_a[s : s + 256, None] == list_b[None, :])
            i += s
            keep = ids_a[i] != ids_b[j]
            i, j = i[keep], j[keep]
            keep = np.bitwise_count(ma[i] & mb[j]).sum(1) >= least
            i, j = i[keep], j[keep]
            for t in range(0, len(i), 65536):
                m, n = i[t : t + 65536], j[t : t + 65536]
                ok = np.einsum("ij,ij->i", ua[m], ub[n]) >= threshold
                m, n = m[ok], n[ok]
                # a pair that also meets with roles exchanged is taken where the smaller number looks
                back = (order_b[n][:, None, :width] == order_a[m][:, :depth, None]).any(2).all(1)
                ok = ~back | (ids_a[m] < ids_b[n])
                found_i.append(at_a[m[ok]]), found_j.append(at_b[n[ok]])
    return np.concatenate(found_i), np.concatenate(found_j)


def _looks(described: DataFrame, homes: bool, slots: Broadcast | None = None) -> DataFrame:
    """(cls, list, filed): the list under which each vector is filed and, unless only ``homes`` are asked for, those it looks in; of full ``slots`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            kinds = b.column(2).to_numpy()
            for kind in np.unique(np.stack([sizes, kinds], 1), axis=0):
                part = b.filter(pa.array((sizes == kind[0]) & (kinds == kind[1])))
                (depth, width, *_), order = _heads(part.column(1).to_pylist(), part.num_rows)
                lists = _lists(order, depth, depth if homes else width, int(kind[1]))
                ids = np.repeat(part.column(0).to_numpy(), lists.shape[1])
                filed = np.tile(np.arange(lists.shape[1]) == 0, part.num_rows)
                lists = lists.reshape(-1)
                if slots:
                    at = lists & (SLOTS - 1)
                    full = slots.value[at >> 6] >> (at & 63) & 1 == 1
                    ids, lists, filed = ids[full], lists[full], filed[full]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lists), pa.array(filed)], ["cls", "list", "filed"])

    return described.select("cls", "head", F.octet_length("vector").alias("size")).mapInArrow(run, "cls long, list long, filed boolean")


def _full_slots(described: DataFrame) -> Broadcast:
    """Bits of a table of fixed size: whether any vector is filed under a list of that slot. What it wrongly lets through is dropped by the join."""
    at = F.col("list").bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr("shiftleft(1L, cast(list & 63 as int))")
    found = _looks(described, True).groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    slots = np.zeros(SLOTS // 64, np.int64)
    slots[found["word"].to_numpy()] = found["bits"].to_numpy()
    return described.sparkSession.sparkContext.broadcast(slots)


def meetings(described: DataFrame, tile: int = TILE) -> DataFrame:
    """(cls, list, filed, rows, cols): where each vector is filed or looks, of lists in which it can meet another."""
    narrow = _looks(described, False, _full_slots(described))
    # one's own list is among those one looks in, so a list of one look holds nobody else
    sizes = narrow.groupBy("list").agg(F.count_if("filed").alias("home"), F.count("*").alias("looks")).where("home > 0 and looks > 1")
    sizes = sizes.select("list", F.ceil(F.col("home") / tile).cast("int").alias("rows"), F.ceil(F.col("looks") / tile).cast("int").alias("cols"))
    return narrow.join(sizes, "list").select("cls", "list", "filed", "rows", "cols")


def links(described: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(cls, other, n): n copies linked with cls in one tile (other null), or a star edge (n null)."""
    met = cut(meetings(described, tile), "emb-meet")
    parts = max(1, met.where((F.col("rows") == 1) & (F.col("cols") == 1)).count() // tile)
    spread = F.pmod(F.xxhash64("cls"), F.lit(1 << 30))
    alone = (F.col("rows") > 1) | (F.col("cols") > 1)
    own = F.when(alone, F.col("list")).otherwise(F.pmod(F.xxhash64("list"), F.lit(parts)))
    body = ["cls", "copies", "vector", "head"]
    both = met.withColumn("pack", own).withColumn("alone", alone).join(described, "cls")
    one, few = spread % F.col("rows"), spread % F.col("cols")
    filed = both.where("filed").select("alone", "pack", "list", one.alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), F.lit(0).alias("side"), *body)
    look = both.select("alone", "pack", "list", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), few.alias("c"), F.lit(1).alias("side"), *body)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.side == 1].reset_index(drop=True), rows[rows.side == 0].reset_index(drop=True)
        i, j = _compare(a, b, threshold) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
        if not len(i):
            return pd.DataFrame({"cls": [], "other": [], "n": []})
        ids, at = np.unique(np.concatenate([a.cls.to_numpy()[i], b.cls.to_numpy()[j]]), return_inverse=True)
        x, y = at[: len(i)], at[len(i) :]
        n = np.bincount(x, b.copies.to_numpy()[j], len(ids)) + np.bincount(y, a.copies.to_numpy()[i], len(ids))
        root = min_labels(x, y, len(ids))
        star = root != np.arange(len(ids))
        return pd.concat([
            pd.DataFrame({"cls": ids, "other": pd.array([None] * len(ids), "Int64"), "n": pd.array(n.astype(np.int64), "Int64")}),
            pd.DataFrame({"cls": ids[star], "other": pd.array(ids[root[star]], "Int64"), "n": pd.array([None] * int(star.sum()), "Int64")}),
        ])

    return filed.unionByName(look).groupBy("alone", "pack", "r", "c").applyInPandas(run, "cls long, other long, n long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """(id, n_links, component): one row per vector."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("id").isNotNull())
    good = rows.where("ok")
    classes = good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # numbered as stored: several classes may have the same smallest id
    classes = cut(classes.withColumn("dim", F.size("vector")).withColumn("cls", F.monotonically_increasing_id()), "emb-classes")
    described = cut(describe(classes, fit_pivots(classes, n_pivots, threshold)), "emb-index")
    found = cut(links(described, threshold), "emb-links")
    n = found.where("n is not null").groupBy("cls").agg(F.sum("n").alias("linked"))
    parts = connected_components(found.where("other is not null"), "cls", "other").withColumnRenamed("node", "cls")
    label = parts.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("label"))
    per = classes.select("vector", "rep", "copies", "cls").join(n, "cls", "left").join(parts.join(label, "component").select("cls", "label"), "cls", "left")
    per = per.select("vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component"))
    out = good.select("id", "vector").join(per, "vector", "left").select("id", "n_links", "component")
    rest = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))


#: All pairs, for small tables: exact where the index misses nothing.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.l > 0 AND b.l > 0 AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) >= 0.95::DOUBLE * a.l * b.l),
r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT k.b, r.m FROM r JOIN k ON k.a = r.n WHERE r.m < k.b),
c AS (SELECT n AS vec_id, min(m) AS component_id FROM r GROUP BY n),
d AS (SELECT a AS vec_id, count(*) AS n_links FROM k GROUP BY a)
SELECT e.vec_id, coalesce(d.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)
"""

"""SimHash near-duplicates: 64-bit fingerprints linked by a pigeonring filter.

``fingerprints`` gives every document the majority vote of the hashes of its word
shingles. ``near_duplicates`` links fingerprints that differ in at most ``tau``
bits and returns one row per document with its component.

The ring: 64 bits are cut into ``tau + 1`` segments. If two fingerprints differ
in at most ``tau`` bits, walking the ring from some segment keeps the running
difference within its proportional budget ``l * tau / (tau + 1)`` after every
``l`` segments: none in the first, one in the first two, and so on. The index key
is therefore the first segment together with the second; a probe looks up the
second segment as it is and with each one bit turned. The rest of the chain is
tested in the join, before the full distance. No pair within ``tau`` is missed.

A key of two of five segments has 26 bits, so a probe meets about N / 2^26 others by
chance and each document makes 70 probes: at a thousand million distinct
fingerprints some thousand comparisons each. Beyond that ``per_key`` = 3 makes keys of
38 bits for 20 times the probes; it changes the work and never the result.

Groups: equal fingerprints are one node, so copies cost nothing. Within an index
bucket every node is first tied to the bucket's smallest one (a star, when they
really are within ``tau``); components of those stars are then known, and the
probe join compares only nodes of different components and skips buckets that
hold the probe's component alone. A large group of near copies is joined by
stars instead of by all its pairs.

Edge cases: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle give one shingle of all words; repeated rows
share a component; a row without an id gets the component of its fingerprint, or
null where no row with an id has that, and is never dropped; an empty table gives an empty result; extra columns are
ignored.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import connected_components
from tidewire.plans.materialize import cut


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return 0
    gap = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    if len(gap) + 1 <= shingle:
        return xxhash.xxh64_intdigest(words, seed)
    begin = [0, *(gap[: len(gap) + 1 - shingle + 1] + 1).tolist()][: len(gap) + 2 - shingle]
    end = [*gap[shingle - 1 :].tolist(), len(words)]
    digest = xxhash.xxh64_intdigest
    return vote(np.fromiter((digest(words[a:b], seed) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin)))


def vote(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every document as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} long, fp long")


def _layout(tau: int) -> list[tuple[int, int]]:
    """(offset, width) of the tau + 1 ring segments."""
    n = tau + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def _segment(fp, off: int, width: int):
    return F.shiftrightunsigned(fp, off).bitwiseAND(F.lit((1 << width) - 1))


def _index_keys(fp, tau: int, per_key: int = 2):
    """One key per ring position: its number and its first ``per_key`` segments."""
    ring = _layout(tau)
    n = len(ring)
    keys = []
    for i in range(n):
        key = F.lit(i).cast("long")
        for j in range(per_key):
            off, width = ring[(i + j) % n]
            key = key * F.lit(1 << width) + _segment(fp, off, width)
        keys.append(key)
    return F.array(*keys)


def _turns(widths: list[int], tau: int, n: int) -> list[int]:
    """All bit masks of the segments after the first that keep the running difference within its budgets."""
    found = [(0, 0)]
    for step, width in enumerate(widths, 2):
        most = step * tau // n
        grown = []
        for mask, used in found:
            for k in range(min(width, most - used) + 1):
                grown += [((mask << width) + sum(1 << b for b in bits), used + k) for bits in combinations(range(width), k)]
        found = grown
    return [mask for mask, _ in found]


def _probe_keys(fp, tau: int, per_key: int = 2):
    """The index keys, each with every allowed set of bits turned."""
    ring = _layout(tau)
    n = len(ring)
    masks = [_turns([ring[(i + j) % n][1] for j in range(1, per_key)], tau, n) for i in range(n)]
    turns = F.array(*[F.array(*[F.lit(m).cast("long") for m in x]) for x in masks])
    each = F.transform(_index_keys(fp, tau, per_key), lambda k, i: F.transform(F.get(turns, i), lambda t: k.bitwiseXOR(t)))
    return F.flatten(each)


def _chain(x, tau: int):
    """Some start from which every run of segments stays within its budget."""
    ring = _layout(tau)
    n = len(ring)
    diff = [F.bit_count(_segment(x, o, w)) for o, w in ring]
    starts = []
    for i in range(n):
        total, holds = F.lit(0), F.lit(True)
        for step in range(n):
            total = total + diff[(i + step) % n]
            holds = holds & (total * n <= (step + 1) * tau)
        starts.append(holds)
    any_start = starts[0]
    for s in starts[1:]:
        any_start = any_start | s
    return any_start


def link_components(fps: DataFrame, tau: int = 4, per_key: int = 2) -> DataFrame:
    """(fp, node, component) of distinct fingerprints; nodes are the smallest ids that hold them."""
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("node")), "sh-nodes")
    index = cut(nodes.select("fp", "node", F.explode(_index_keys(F.col("fp"), tau, per_key)).alias("key")), "sh-index")
    hub = index.groupBy("key").agg(F.min_by("fp", "node").alias("hub_fp"), F.min("node").alias("hub"), F.count("*").alias("n"))
    stars = (
        index.join(hub.where("n > 1"), "key")
        .where((F.col("node") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= tau))
        .select(F.col("node").alias("src"), F.col("hub").alias("dst"))
        .distinct()
    )
    first = connected_components(stars)
    placed = nodes.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed.select("fp", "node", "component"), "sh-placed")
    held = placed.select("fp", "component", F.explode(_index_keys(F.col("fp"), tau, per_key)).alias("key"))
    span = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    probe = placed.select(
        F.col("fp").alias("p_fp"), F.col("component").alias("p_component"), F.explode(_probe_keys(F.col("fp"), tau, per_key)).alias("key")
    )
    # the planner takes an exploded table for as small as the stored one it comes from, and would broadcast the probes
    held, span = held.hint("merge"), span.hint("merge")
    useful = probe.join(span, "key").where((F.col("low") != F.col("high")) | (F.col("low") != F.col("p_component")))
    x = F.col("fp").bitwiseXOR(F.col("p_fp"))
    pairs = (
        useful.select("key", "p_fp", "p_component")
        .join(held, "key")
        .where((F.col("component") != F.col("p_component")) & (F.bit_count(x) <= tau) & _chain(x, tau))
        .select(F.col("p_component").alias("src"), F.col("component").alias("dst"))
        .distinct()
    )
    second = connected_components(pairs).select(F.col("node").alias("component"), F.col("component").alias("final"))
    joined = placed.join(second, "component", "left")
    return joined.select("fp", "node", F.coalesce("final", "component").alias("component"))


def near_duplicates(docs: DataFrame, tau: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", per_key: int = 2) -> DataFrame:
    """(id, fp, component): one row per document; component is the smallest id reachable."""
    fps = cut(fingerprints(docs, shingle, id_col, text_col).select(F.col(id_col).alias("id"), "fp"), "sh-fps")
    groups = link_components(fps.where("id is not null"), tau, per_key).select("fp", "component")
    return fps.join(groups, "fp", "left").select(F.col("id").alias(id_col), "fp", "component")


def one_per_group(docs: DataFrame, tau: int = 4, shingle: int = 4) -> DataFrame:
    """The documents that are the smallest id of their group; rows without an id stay."""
    found = near_duplicates(docs, tau, shingle)
    gone = found.where(F.col("component") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

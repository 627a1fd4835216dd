"""Benchmark decontamination by winnowing.

``fingerprint`` slides over the hashes of all k-grams of a word sequence and keeps
the smallest of each ``w`` neighbours (the last of equal ones). With
``k + w - 1 = 10`` two sequences that share ten consecutive words share a kept
hash at the same place of that span. Kept hashes of a document are looked up
among those of the benchmark items; every hit is extended to the windows on both
sides that hold it, and a window counts if it is one of the benchmark's, word by
word: ten words, or all words of an item that has fewer. Items of fewer words than
ten are looked up by the hash of all their words, since winnowing promises
nothing for them.

A window is stored once, whatever the number of items that hold it, with the list
of those items; the lists of a document's windows are united once, and equal unions
of other documents are taken from a bounded table. So a preamble of all items
costs a document no more than a rare passage, but for the ids that it reports.

The benchmark is read in blocks of bounded size, each broadcast to one pass over
the documents; the passes of a larger benchmark are chained in one stage and
hand on the spans found so far. Documents are never shuffled and a passage that
a third of them hold costs each of them one look-up.

Edge cases: null and blank texts have no words and are not contaminated; items
without words never occur; repeated items occur like others (equal ids are listed
once); items without an id are one item, counted but not listed; very long texts
are read whole; repeated documents get equal results; an empty benchmark leaves
all documents clean; an empty table gives an empty result; other columns are
ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.batches import few

WINDOW = 10
GRAM = 5
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000

_KEEP = bytearray(range(256))
for _c in range(128):
    if not (48 <= _c <= 57 or 97 <= _c <= 122):
        _KEEP[_c] = _c + 32 if 65 <= _c <= 90 else 32
_KEEP = bytes(_KEEP)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def _mixed(columns, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row of the columns."""
    h = None
    for c in columns:
        h = np.full(len(c), seed, np.uint64) if h is None else h
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def gram_hashes(ids: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive word numbers."""
    n = len(ids) - k + 1
    return _mixed((ids[j : j + n] for j in range(k)), seed) if n > 0 else np.zeros(0, np.uint64)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every w neighbours, the last of equal ones."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    if len(h) <= w:
        return np.array([len(h) - 1 - int(h[::-1].argmin())])
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(1))


class Windows:
    """The distinct windows of k words of some items, each with the items that hold it."""

    def __init__(self, k: int, sequences: list[tuple[int, np.ndarray]]):
        self.k = k
        self.flat = np.concatenate([ids for _, ids in sequences])
        begin = np.cumsum([0, *(len(ids) for _, ids in sequences)])
        start = np.concatenate([np.arange(a, b - k + 1) for a, b in zip(begin, begin[1:], strict=False)])
        item = np.repeat([n for n, _ in sequences], [len(ids) - k + 1 for _, ids in sequences])
        self.seed = 0
        while True:
            h = _mixed((self.flat[start + j] for j in range(k)), self.seed)
            order = np.argsort(h, kind="stable")
            self.hashes, first, slot = np.unique(h[order], return_index=True, return_inverse=True)
            self.place = start[order][first]
            if all((self.flat[start[order] + j] == self.flat[self.place[slot] + j]).all() for j in range(k)):
                break
            self.seed += 1  # two windows share a hash
        held = np.unique(np.stack([slot, item[order]], 1), axis=0)
        self.items = held[:, 1].astype(np.int32)
        self.ends = np.cumsum(np.bincount(held[:, 0], minlength=len(self.hashes)))

    def find(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places ``at`` begin a window, and the distinct windows there."""
        h = _mixed((ids[at + j] for j in range(self.k)), self.seed)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[slot] == h
        at, slot = at[ok], slot[ok]
        same = np.ones(len(at), bool)
        for j in range(self.k):
            same &= self.flat[self.place[slot] + j] == ids[at + j]
        return at[same], np.unique(slot[same])

    def holders(self, slots: np.ndarray) -> np.ndarray:
        """The items that hold any of the windows."""
        return np.unique(np.concatenate([self.items[self.ends[s - 1] if s else 0 : self.ends[s]] for s in slots.tolist()]))


class Index:
    """Fingerprints of a block of items, as (item_id, text) pairs."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, gram: int = GRAM, keep: int = 1000):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self.vocab: dict[bytes, int] = {}
        self.names: list[str | None] = []
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        kept = [np.zeros(0, np.uint64)]
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in words], np.uint64)
            by_length.setdefault(min(window, len(words)), []).append((len(self.names), ids))
            self.names.append(None if item_id is None else str(item_id))
            if len(words) >= window:
                h = gram_hashes(ids, gram)
                kept.append(np.unique(h[winnow(h, self.span)]))
        self.kept = np.unique(np.concatenate(kept))
        self.tables = [Windows(k, s) for k, s in sorted(by_length.items())]
        self.keep, self.unions = keep, {}

    def _places(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Where windows of k words are to be looked for."""
        n = len(ids) - k + 1
        if n <= 0 or k < self.window:
            return np.arange(max(0, n))
        h = gram_hashes(ids, self.gram)
        at = winnow(h, self.span)
        at = at[self.kept[np.minimum(np.searchsorted(self.kept, h[at]), len(self.kept) - 1)] == h[at]]
        around = np.unique(at[:, None] - np.arange(self.span))
        return around[(around >= 0) & (around < n)]

    def find(self, words: list[bytes]) -> tuple[np.ndarray, tuple[int, str]]:
        """Which words are hit, and the number and the names (sorted, parted by NUL) of the items that occur."""
        edge = np.zeros(len(words) + 1, np.int64)
        found = []
        if self.vocab and words:
            get = self.vocab.get
            ids = np.fromiter((get(x, 0) for x in words), np.uint64, len(words))
            for t, table in enumerate(self.tables):
                at = self._places(ids, table.k)
                if len(at):
                    at, slots = table.find(ids, at)
                    if len(at):
                        np.add.at(edge, at, 1), np.add.at(edge, at + table.k, -1)
                        found.append((t, slots))
        return np.cumsum(edge[:-1]) > 0, self._union(found) if found else (0, "")

    def _union(self, found: list[tuple[int, np.ndarray]]) -> tuple[int, str]:
        key = tuple((t, slots.tobytes()) for t, slots in found)
        if key not in self.unions:
            names = {self.names[n] for t, slots in found for n in self.tables[t].holders(slots).tolist()}
            if len(self.unions) >= self.keep:
                self.unions.clear()
            self.unions[key] = (len(names), "\0".join(sorted(names - {None})))
        return self.unions[key]


def blocks(benchmark: DataFrame, items: int = BLOCK_ITEMS, words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of bounded numbers of items and words, read part by part."""
    block, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "") // 4
        if len(block) >= items or size >= words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _pass(docs: DataFrame, held, extra: list[str]) -> DataFrame:
    """One block of items over all documents; spans and items of earlier blocks come in ``_hit`` and ``_items``."""
    names = [*extra, "text", "_hit", "_items"]
    schema = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            hits, items = [], []
            at = len(extra)
            for text, old, seen in zip(b.column(at), b.column(at + 1), b.column(at + 2), strict=True):
                hit, (n, listed) = held.value.find(words_of(text.as_py()))
                if old.as_py():
                    hit |= np.unpackbits(np.frombuffer(old.as_py(), np.uint8), count=len(hit)).astype(bool)
                hits.append(np.packbits(hit).tobytes() if hit.any() else b"")
                items.append([*seen.as_py(), *([f"{n}\0{listed}"] if n else [])])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(at + 1)), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names
            )

    return docs.select(*names).mapInArrow(run, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, extra: list[str] = (), window: int = WINDOW, gram: int = GRAM, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` with _hit (a bit for each word, empty if none is hit) and _items (for each block with items that occur, their number and names, parted by NUL)."""
    d = docs.select(*extra, F.col("text").cast("string").alias("text")).withColumn("_hit", F.lit(b"")).withColumn("_items", F.array().cast("array<string>"))
    for block in blocks(benchmark, block_items):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, window, gram))
        d = _pass(d, index, list(extra))
    return d


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns."""
    cols = docs.columns
    spare = [f"_{i}" for i in range(len(cols))]  # no name of the table can clash with those used here
    d = docs.toDF(*["text" if c == "text" else n for c, n in zip(cols, spare, strict=True)])
    clean = overlaps(d, benchmark, [n for c, n in zip(cols, spare, strict=True) if c != "text"]).where(F.length("_hit") == 0)
    return clean.select(*["text" if c == "text" else n for c, n in zip(cols, spare, strict=True)]).toDF(*cols)


def _united(parts: tuple[str, ...]) -> tuple[int, str]:
    """The number of items over all blocks, and the digest of their names."""
    names: set[str] = set()
    nameless = False
    for part in parts:
        n, *own = part.split("\0")
        own = own if own != [""] else []
        nameless |= int(n) > len(own)
        names.update(own)
    return len(names) + nameless, hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = overlaps(docs, benchmark, ["doc_id"], block_items=block_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, ...], tuple[int, str]] = {}
        for b in batches:
            n = [len(words_of(t.as_py())) for t in b.column(1)]
            hit = [int(np.unpackbits(np.frombuffer(x.as_py(), np.uint8)).sum()) for x in b.column(2)]
            items = []
            for x in b.column(3):
                if (key := tuple(x.as_py())) not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[key] = _united(key)
                items.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([x for x, _ in items], pa.int64()), pa.array([x for _, x in items]), pa.array([x > 0 for x in hit])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, grams.n AS n FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

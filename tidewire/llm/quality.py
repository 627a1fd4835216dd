"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into a fixed vector of counts and shares.
``Forest.fit`` grows trees of fixed depth on quantile bins of these vectors with
second-order logistic boosting; ``Forest`` keeps them as flat arrays and scores a
matrix by walking all rows down one level at a time.

Training reads at most about ``sample`` labelled documents, picked by a hash of
their id; the label table is cut down first, so documents are never shuffled.
Scoring reads every document.

Edge cases: null and empty texts are scored as texts of no words; documents with
several labels count once for each, repeated rows once in training; without labels, or with one class only, the
score is that class's share (0.5 without any); repeated rows get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 24_000
THRESHOLD = 0.3
#: Characters that are counted one by one.
MARKS = b".,;:!?|*$%#\"'()-=<>{}[]/@_&+"
N_STATS = 24 + len(MARKS)

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 continuation byte, 7 lead byte
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[128:192] = 6
_CLASS[192:] = 7


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=count, minlength=8)
    n = max(1, len(raw))
    words = raw.split()
    lines = raw.split(b"\n")
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    long_lines = [x for x in lines if x]
    seen_lines = set(long_lines)
    ends = sum(x.endswith((b".", b"!", b"?")) for x in long_lines)
    p = count[count > 0] / n
    common = sum(c * c for c in sorted_counts(words)[:5]) if words else 0
    out = [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        *(kinds / n),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        len(distinct) / n_words,
        len(distinct) / math.sqrt(n_words),
        1 - len(seen_lines) / max(1, len(long_lines)),
        n_words / n_lines,
        ends / max(1, len(long_lines)),
        float(-(p * np.log2(p)).sum()),
        math.sqrt(common) / n_words,
        len(zlib.compress(raw, 1)) / n,
        kinds[2] / max(1, kinds[1] + kinds[2]),
        float(sum(w.isupper() for w in distinct)) / max(1, len(distinct)),
    ]
    return out + (count[list(MARKS)] / n).tolist()


def sorted_counts(words: list[bytes]) -> list[int]:
    from collections import Counter

    return sorted(Counter(words).values(), reverse=True)


class Forest:
    """Boosted trees as flat arrays: node i of a tree has children 2i+1 and 2i+2."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.edges, self.feature, self.cut, self.value, self.base, self.depth = edges, feature, cut, value, base, depth

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        rows = np.arange(len(bins))
        inner = (1 << self.depth) - 1
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(bins), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (bins[rows, f[at]] > c[at])
            total += v[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, n_bins: int = 64, l2: float = 1.0, least: float = 3.0):
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, n_bins) / n_bins)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        inner = (1 << depth) - 1
        empty = np.zeros((0, inner), np.int64)
        forest = cls(edges, empty, empty, np.zeros((0, inner + 1)), math.log(p / (1 - p)), depth)
        if len(y) == 0 or y.min() == y.max():
            return forest
        bins = forest.bins(x)
        wide = bins.astype(np.int64) + np.arange(x.shape[1]) * n_bins
        size = x.shape[1] * n_bins
        feature, cuts, values = [], [], []
        margin = np.full(len(y), forest.base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            f, c = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
            at = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, nodes = (1 << level) - 1, 1 << level
                slot = ((at - first)[:, None] * size + wide).ravel()
                g = np.bincount(slot, np.repeat(grad, x.shape[1]), nodes * size).reshape(nodes, x.shape[1], n_bins)
                h = np.bincount(slot, np.repeat(hess, x.shape[1]), nodes * size).reshape(nodes, x.shape[1], n_bins)
                gl, hl = g.cumsum(2), h.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least * 0.05) | (ht - hl < least * 0.05)] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                ok = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
                f[first : first + nodes] = np.where(ok, best // n_bins, 0)
                c[first : first + nodes] = np.where(ok, best % n_bins, 255)
                at = 2 * at + 1 + (bins[np.arange(len(y)), f[at]] > c[at])
            leaf = at - inner
            v = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + l2)
            margin += v[leaf]
            feature.append(f), cuts.append(c), values.append(v)
        forest.feature, forest.cut, forest.value = np.array(feature), np.array(cuts), np.array(values)
        return forest


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], float).reshape(len(texts), N_STATS)


def training_set(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most about ``sample`` labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).distinct()
    n = known.count()
    if not n:
        return np.zeros((0, N_STATS)), np.zeros(0)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(place < min(1.0, sample / n))
    few = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x.astype("<f4").tobytes() for x in matrix(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["doc_id", "x", "y"])

    # rows of one id count once, however often they are repeated
    rows = few.mapInArrow(run, "doc_id long, x binary, y double").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    order = np.lexsort((rows["y"].to_numpy(), rows["doc_id"].to_numpy()))
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").reshape(-1, N_STATS).astype(float)
    return x[order], rows["y"].to_numpy()[order]


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = matrix(part.column(1)).astype("<f4").astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    forest = Forest.fit(*training_set(docs, labels.where(fold != 0), "quality"))
    found = score(docs, forest)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

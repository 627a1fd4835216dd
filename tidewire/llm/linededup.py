"""Line dedup by pairwise alignment.

Lines are compared by the hash of their text without white space at its ends;
blank lines part nothing and weigh nothing. A run of neighbouring lines is one
*block* if its words reach ``min_words``. Single lines may be common, so the index
holds runs that are long enough to be rare: for every line the shortest run of
``min_words`` words that begins there, and the shortest that ends there. Every line
of a common block, however long, lies in such a run inside that block: two
documents share a block if and only if they share a run's hash, and no line of a
common block is outside all shared runs.

Each later holder of a run is paired with the run's first holder (smallest id).
A passage in a third of all documents thus makes one pair per document, never all
pairs of its holders. Of a paired document only the lines inside shared runs
travel on, so a long first holder costs no more than what it shares.

A pair is aligned with patience diff: common ends first, then the lines that are
unique on both sides, in their longest common order, and so on in the gaps.
Aligned blocks are deleted from the later document. An alignment keeps the order
and needs a unique line to hold on to, so blocks that were moved, or that the
earlier document repeats, are then looked up by the pair's shared runs. The
outcome is exact: a line goes if and only if it lies in a block that a document
of smaller id holds too. Each deleted line is left in the first document that
has it.

Edge cases: null and empty texts have no lines to lose; rows without an id, and
rows of equal id against each other, are not compared; repeated rows lose the
same lines and are aligned once; blank lines between deleted neighbours go with
them; a document whose every line is in earlier ones is left with an empty text;
documents are never compared by anything but their text; an empty table gives an
empty result; extra columns are passed on by ``deduplicated``.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.batches import SENT, few
from tidewire.plans.materialize import cut

MIN_WORDS = 30


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Lines unique on both sides, in their longest common order."""
    once_a, once_b = Counter(a), Counter(b)
    at_b = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    pairs = [(i, at_b[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in at_b]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        back[n] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(j), ends.append(n)
        else:
            tails[k], ends[k] = j, n
    out = []
    n = ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, by patience diff."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        left, low = a0, b0
        found = _anchors(a[a0:a1], b[b0:b1])
        if not found:
            continue
        for i, j in found:
            i, j = a0 + i, b0 + j
            out.append((i, j))
            todo.append((left, i, low, j))
            left, low = i + 1, j + 1
        todo.append((left, a1, low, b1))
    return sorted(out)


def aligned_blocks(pos: np.ndarray, later: list, words: np.ndarray, pos_b: np.ndarray, earlier: list, min_words: int) -> np.ndarray:
    """Which of the later lines are in aligned blocks; ``pos`` tells which lines are neighbours."""
    hit = np.zeros(len(later), bool)
    found = align(later, earlier)
    if not found:
        return hit
    i, j = np.array(found).T
    run = np.concatenate([[0], np.cumsum((np.diff(pos[i]) != 1) | (np.diff(pos_b[j]) != 1))])
    hit[i] = np.bincount(run, words[i])[run] >= min_words
    return hit


def lines_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the number of words of every line; blank lines have neither."""
    lines = [x.strip() for x in raw.split(b"\n")]
    words = np.fromiter((len(x.split()) for x in lines), np.int32, len(lines))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64), words


def runs(hashes: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the shortest runs of ``min_words`` words from and up to every line, of lines with words."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = len(words)
    begin = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words)
    ok = end <= n
    stop = np.arange(1, n + 1)
    start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    back = start >= 0
    both = np.unique(np.concatenate([begin[ok] * (n + 1) + end[ok], start[back] * (n + 1) + stop[back]]))
    a, b = both // (n + 1), both % (n + 1)
    raw = np.ascontiguousarray(hashes).tobytes()
    return a, b, np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * x : 8 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a)).view(np.int64)


def _ints(values, kind=None):
    return pa.array(values, pa.list_(kind or pa.int32()))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, hashes, words): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            found = [lines_of(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), _ints([h for h, _ in found], pa.int64()), _ints([w for _, w in found])], ["doc_id", "row_key", "hashes", "words"]
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text.alias("text"))
    return d.mapInArrow(run, "doc_id long, row_key long, hashes array<long>, words array<int>")


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _worded(hashes, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, hashes and sizes of the lines that have words."""
    h, w = hashes.values.to_numpy(), words.values.to_numpy()
    no = np.flatnonzero(w)
    return no, h[no], w[no]


def _shared_runs(table: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row_key, h, earlier, earlier_row): the runs that several documents hold, with their first holder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            keys = [np.unique(runs(*_worded(h, w)[1:], min_words)[2]) for h, w in zip(b.column(2), b.column(3), strict=True)]
            own = np.repeat(np.arange(b.num_rows), [len(x) for x in keys])
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own)), pa.array(flat)], ["doc_id", "row_key", "h"])

    held = cut(table.where("doc_id is not null").mapInArrow(run, "doc_id long, row_key long, h long"), "ld-held")
    first = held.groupBy("h").agg(F.min("doc_id").alias("earlier"), F.min_by("row_key", "doc_id").alias("earlier_row"), F.max("doc_id").alias("last"))
    first = cut(first.where("earlier < last").select("h", "earlier", "earlier_row"), "ld-first")
    return cut(held.join(first, "h").select("doc_id", "row_key", "h", "earlier", "earlier_row"), "ld-shared-runs")


def _shared_lines(table: DataFrame, shared: DataFrame, min_words: int) -> DataFrame:
    """One row per distinct document with shared runs: its lines inside them (place, number, hash, words) and the runs."""
    keys = shared.groupBy("doc_id", "row_key").agg(F.collect_set("h").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                no, h, w = _worded(b.column(2)[i], b.column(3)[i])
                begin, end, key = runs(h, w, min_words)
                keep = np.isin(key, b.column(4)[i].values.to_numpy())
                begin, end, key = begin[keep], end[keep], key[keep]
                pos = np.flatnonzero(np.cumsum(np.bincount(begin, minlength=len(h) + 1) - np.bincount(end, minlength=len(h) + 1))[:-1])
                out.append((pos, no[pos], h[pos], w[pos], begin, end, key))
            kinds = (None, None, pa.int64(), None, None, None, pa.int64())
            cols = [_ints([x[k].astype(np.int64 if kind else np.int32) for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "row_key", "pos", "no", "hash", "words", "begin", "end", "key"])

    # rows that repeat each other are one, whatever their number
    whole = table.join(keys, ["doc_id", "row_key"]).groupBy("doc_id", "row_key").agg(*[F.first(c).alias(c) for c in ("hashes", "words", "keys")])
    schema = "doc_id long, row_key long, pos array<int>, no array<int>, hash array<long>, words array<int>, begin array<int>, end array<int>, key array<long>"
    return cut(whole.mapInArrow(run, schema), "ld-shared-lines")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The line table, and (doc_id, row_key, gone, mask, earlier): deleted lines, as numbers and as flags, and the documents that keep them."""
    table = cut(line_table(docs), "ld-lines", SENT)
    shared = _shared_runs(table, min_words)
    lines = _shared_lines(table, shared, min_words)
    pairs = shared.where("doc_id > earlier").select(F.col("doc_id").alias("later"), F.col("row_key").alias("later_row"), "earlier", "earlier_row").distinct()
    left = lines.select(F.col("doc_id").alias("later"), F.col("row_key").alias("later_row"), "pos", "no", "hash", "words", "begin", "end", "key")
    right = lines.select(F.col("doc_id").alias("earlier"), F.col("row_key").alias("earlier_row"), F.col("pos").alias("pos_b"), F.col("hash").alias("hash_b"), F.col("key").alias("key_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for i in range(b.num_rows):
                pos, no, h, w, begin, end, key, pos_b, h_b, key_b = (b.column(c)[i].values.to_numpy() for c in range(3, 13))
                hit = aligned_blocks(pos, h.tolist(), w, pos_b, h_b.tolist(), min_words)
                more = np.isin(key, key_b)  # blocks out of order, or without a unique line in the earlier document
                first, past = (np.searchsorted(pos, x[more]) for x in (begin, end))
                hit |= np.cumsum(np.bincount(first, minlength=len(h) + 1) - np.bincount(past, minlength=len(h) + 1))[:-1] > 0
                gone.append((pos[hit].astype(np.int64) << 32) + no[hit])
            keep = pa.array([len(x) > 0 for x in gone], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), _ints(gone, pa.int64())], ["doc_id", "row_key", "earlier", "gone"]).filter(keep)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, masks = [], []
            for x in b.column(2):
                at = np.unique(x.values.flatten().to_numpy())
                pos, no = at >> 32, at & (1 << 32) - 1
                mask = np.zeros(int(no[-1]) + 1, bool)
                mask[no] = True
                for k in np.flatnonzero((np.diff(pos) == 1) & (np.diff(no) > 1)).tolist():
                    mask[no[k] : no[k + 1]] = True
                numbers.append(np.flatnonzero(mask).astype(np.int32)), masks.append(mask)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _ints(numbers), _ints(masks, pa.bool_()), b.column(3)], ["doc_id", "row_key", "gone", "mask", "earlier"])

    both = pairs.join(left, ["later", "later_row"]).join(right, ["earlier", "earlier_row"])
    both = both.select("later", "later_row", "earlier", "pos", "no", "hash", "words", "begin", "end", "key", "pos_b", "hash_b", "key_b")
    found = both.mapInArrow(run, "doc_id long, row_key long, earlier long, gone array<long>")
    found = found.groupBy("doc_id", "row_key").agg(F.collect_list("gone").alias("gone"), F.array_sort(F.collect_set("earlier")).alias("earlier"))
    found = found.mapInArrow(union, "doc_id long, row_key long, gone array<int>, mask array<boolean>, earlier array<long>")
    return table, cut(found, "ld-gone")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with the deleted lines taken out of the text (and of n_chars, where there is such a column).

    Documents that this leaves without any word are dropped, unless ``drop_emptied`` is false.
    """
    used = ("doc_id", "text", "n_chars")
    names = [c if c in used else f"_{i}" for i, c in enumerate(docs.columns)]  # no name can clash with those used here
    columns, docs = docs.columns, docs.toDF(*names)
    _, found = deletions(docs, min_words)
    found = found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("mask").alias("_gone"))
    d = docs.withColumn("_row", row_key())
    d = d.join(found, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_row") == F.col("_key")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.get("_gone", i), F.lit(False))), "\n")
    cut_ = F.col("_gone").isNotNull()
    d = d.withColumn("text", F.when(cut_, left).otherwise(F.col("text")))
    if drop_emptied:
        d = d.where(~cut_ | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("_gone").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*names).toDF(*columns)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: lines and words, those deleted, their numbers, and the documents that keep them."""
    table, found = deletions(docs, min_words)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x).cast("long")
    d = table.join(found.drop("mask"), ["doc_id", "row_key"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return d.select(
        "doc_id",
        F.size("hashes").cast("long").alias("n_lines"),
        total(F.col("words")).alias("n_words"),
        F.size(gone).cast("long").alias("n_deleted_lines"),
        total(F.transform(gone, lambda i: F.get("words", i))).alias("n_deleted_words"),
        F.array_join(gone.cast("array<string>"), ",").alias("deleted_lines"),
        F.array_join(F.coalesce("earlier", F.array().cast("array<long>")).cast("array<string>"), ",").alias("kept_in"),
    )


def op10_lines(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))

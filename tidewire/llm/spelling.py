"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

Two words that differ by one inserted, deleted or replaced code point part at a node of
the trie of all words. At every node one child is heavy; a word that leaves the
heavy path there goes through a light one, and its subtree is merged with one character
replaced by any other, skipped, or preceded by the heavy child's. Where the merged word
ends on another word's end, the two are one edit apart. Of two words that part at a node at
most one is on the heavy path, so every pair is met by a light word, and exactly
once. The heavy child is the largest, so only small subtrees move into large ones:
a word is light at no more than log2(n) nodes of its path.

Spark cuts the sorted words into ranges. A node below which all words are in one range is
merged there. A node on the way to a range's first word may reach over several
ranges: all of them take as heavy the child with most first words below, so they
agree without an exchange, and the merged words of such nodes are looked up
by a join with the word table. Two light words with one character replaced meet by a
join on the word with a mark in that place: at most as many as there are
letters share one. The driver holds the ranges' first words, one for ``RANGE_WORDS`` words.

``spellings`` names for each word the nearest one that is much more frequent, and follows such
names to the root in doubling steps; frequencies at least double on the way, so a
few steps reach the end whatever the table's size.

Edge cases: null or empty texts have no words; rows without an id count their runs as
they are; repeated rows count each; a word of any length is one word; an empty table
gives an empty result; ties go to the smaller word in code-point order; extra columns
are ignored.
"""

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.materialize import Stored, cut, settled

#: Words in a range, and partial counts that a task holds at once.
RANGE_WORDS, HELD_COUNTS = 20_000, 200_000
#: Stands for any character in a merged word; no word holds it.
ANY = "*"
_RUN = re.compile(rb"[a-z\xC0-\xFF]+")


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of Latin letters, A-Z lower-cased, one byte a code point."""
    return _RUN.findall(text.encode("latin-1", "replace").lower())


def planted(doc_id: int | None, run: bytes, every: int) -> bytes:
    """The run, or, where its digest with the document's id is divisible by ``every``, the run without one letter."""
    if doc_id is None:
        return run
    h = zlib.crc32(b"%d:%b" % (doc_id, run if run.isascii() else run.decode("latin-1").encode()))
    return run if h % every else run[: (k := h % len(run))] + run[k + 1 :]


def word_counts(docs: DataFrame, least: int = 3, min_length: int = 5, every: int = 97) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points and ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for w, n in Counter(runs_of(text.as_py() or "")).items():
                    if len(w) >= min_length and len(w := planted(doc_id, w, every)) >= min_length:
                        held[w] += n
                if len(held) >= HELD_COUNTS:
                    yield flush()
        if held:
            yield flush()

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _shared(a: str, b: str, d: int) -> int:
    """Length of the common prefix, known to be at least ``d``."""
    n = min(len(a), len(b))
    if a[d:n] == b[d:n]:
        return n
    while a[d] == b[d]:
        d += 1
    return d


def _children(words: list[str], lo: int, hi: int, d: int) -> list[tuple[str, int, int]]:
    """(character, from, to) of the sorted words after a common prefix of ``d``; the empty character ends there."""
    out = []
    while lo < hi:
        w = words[lo]
        end = bisect_left(words, w[:d] + chr(ord(w[d]) + 1), lo, hi) if len(w) > d else lo + 1
        out.append((w[d : d + 1], lo, end))
        lo = end
    return out


def light_edges(words: list[str], firsts: list[str]) -> Iterator[tuple[int, list[tuple[str, int, int]], str, bool]]:
    """(depth, light children, heavy character, reaches over ranges) of every node where words of one range leave the heavy path.

    ``words`` are sorted and distinct; ``firsts`` are the sorted first words of all ranges.
    """
    todo = [(0, len(words), 0, len(firsts), 0)] if words else []
    while todo:
        lo, hi, f, g, d = todo.pop()
        if f == g and hi - lo == 1:
            continue
        ends = [words[hi - 1]] + ([firsts[f], firsts[g - 1]] if f < g else [])
        d = min(_shared(words[lo], e, d) for e in ends)
        far = {c: (a, b) for c, a, b in _children(firsts, f, g, d)}
        kids = _children(words, lo, hi, d)
        sizes = [(a - b, c) for c, (a, b) in far.items() if c] or [(a - b, c) for c, a, b in kids if c]
        if not sizes:
            continue
        heavy = min(sizes)[1]
        light = [k for k in kids if k[0] != heavy]
        if light:
            yield d, light, heavy, any(far)
        todo.extend((a, b, *far.get(c, (0, 0)), d + 1) for c, a, b in kids if c)


def merged(word: str, d: int, heavy: str) -> Iterator[str]:
    """What a light word becomes at the node of depth ``d``: heavy character put first, first character replaced by it, or skipped."""
    yield word[:d] + heavy + word[d:]
    if len(word) > d:
        yield word[:d] + heavy + word[d + 1 :]
        if word[d + 1 : d + 2] != word[d]:  # otherwise the same word comes from skipping the next one
            yield word[:d] + word[d + 1 :]


def errata(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words one edit apart."""
    n_words = words.count()
    ranges = words.repartitionByRange(max(1, -(-n_words // RANGE_WORDS)), "word").withColumn("part", F.spark_partition_id())
    ranges = cut(ranges, "sp-ranges")  # stored, as sampled ranges may differ from run to run
    firsts = sorted(r.first for r in ranges.groupBy("part").agg(F.min("word").alias("first")).collect())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word", kind="stable")
        held, counts = rows.word.tolist(), rows.n.tolist()
        here = dict(zip(held, counts, strict=True))
        out: list[tuple[str, int, str, int | None, bool]] = []
        for d, light, heavy, over in light_edges(held, firsts):
            marks: dict[str, list[int]] = {}
            for c, a, b in light:
                for i in range(a, b):
                    for other in merged(held[i], d, heavy):
                        if over:
                            out.append((held[i], counts[i], other, None, False))
                        elif other in here:
                            out.append((held[i], counts[i], other, here[other], False))
                    if c and (over or len(light) > 1):
                        mark = held[i][:d] + ANY + held[i][d + 1 :]
                        if over:
                            out.append((held[i], counts[i], mark, None, True))
                        else:
                            out.extend((held[i], counts[i], held[j], counts[j], False) for j in marks.setdefault(mark, []))
                            marks[mark].append(i)
        return pd.DataFrame(out, columns=["word", "n", "other", "other_n", "marked"]).astype({"n": "int64", "other_n": "Int64", "marked": "bool"})

    found = cut(ranges.groupBy("part").applyInPandas(run, "word string, n long, other string, other_n long, marked boolean"), "sp-merged")
    ahead = found.where("other_n is null and not marked").select("word", "n", "other")
    looked = ahead.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")
    one_way = found.where("other_n is not null").select("word", "n", "other", "other_n").unionByName(looked)
    marks = found.where("marked")
    twin = marks.select(F.col("other").alias("mark"), "word", "n")
    twins = twin.join(twin.toDF("mark", "other", "other_n"), "mark").where("word < other").select("word", "n", "other", "other_n")
    one_way = one_way.unionByName(twins)
    return one_way.unionByName(one_way.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that starts at ``word`` ends."""
    at = Stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "sp-roots")
    while not at.df.where("moved").isEmpty():
        ahead = at.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.df.drop("moved").join(ahead, "root", "left")
        new = Stored(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "sp-roots")
        at.drop()
        at = new
    return at.df.select("word", "root")


def spellings(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""

    def build() -> DataFrame:
        held = cut(words.select("word", "n"), "sp-words")
        best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
        near = cut(errata(held).groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("n_near"), best.alias("best")), "sp-near")
        much = -F.col("best.less") >= times * F.col("n")
        named = near.select("word", "n_near", F.when(much, F.col("best.form")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))
        ends = roots(named.where("form is not null"))
        rows = held.join(named, "word", "left").join(ends, "word", "left")
        return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")

    return settled(build, "spellings")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spellings(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: CRC-32 is written out over the UTF-8 bytes; pairs share a word with one place skipped or marked.
OP12_SQL = r"""
WITH RECURSIVE steps(b, i, c) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) r(b) UNION ALL
  SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
tokens AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
runs AS (SELECT doc_id, w, count(*) AS n FROM tokens WHERE length(w) >= 5 GROUP BY ALL),
digested AS (
  SELECT w, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [192 + (unicode(x) >> 6)::UBIGINT, 128 + (unicode(x) & 63)::UBIGINT] END))),
      lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)::BIGINT])), 4294967295::UBIGINT) END AS h
  FROM runs, crc_table),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM digested),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM places),
marks AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM marks a JOIN marks b USING (k) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON b.word = a.k
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON b.word = a.k),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
named AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root FROM named UNION ALL SELECT k.word, n.form FROM walk k JOIN named n ON n.word = k.root WHERE n.form IS NOT NULL),
ends AS (SELECT k.word, k.root FROM walk k JOIN named n ON n.word = k.root WHERE n.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM named JOIN ends USING (word)
"""

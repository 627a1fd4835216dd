"""Language identification by compression.

Each language has a raw-content zstandard dictionary made from sample texts of
its own; a text is encoded with every dictionary and the language whose
dictionary gives the smallest encoding wins. Texts are lower-cased and reduced to
their letters and the marks on them first, and encoded in chunks, so that a long text is measured
against the dictionary rather than against its own beginning. Where the runner-up comes closer
than ``margin`` (a share of the smallest encoding) the document is rejected.

The sample is bounded: per language about ``sample_docs`` documents picked by a hash of their id,
whole and of any length, in that order until a dictionary holds ``dict_chars`` characters. So the driver gets
so many characters and one document more per language. Prediction encodes whole texts.

Edge cases: a null text, or one without letters (Unicode category L), is ``und``
with score 0 and is rejected; a language is learned from one document
if that is long enough; equal sizes go to the language with more sample documents, then by
name; without any labelled row every text is ``und``; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.batches import few

SAMPLE_DOCS = 400
DICT_CHARS = 400_000
LEVEL = 6
CHUNK = 2048
MARGIN = 0.002
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
ASCII_OTHER = regex.compile(r"[^a-z]+")


def letters(text: str) -> bytes:
    """Lower-cased words of letters and their marks alone, a space between them; empty without any letter."""
    low = text.lower()
    if low.isascii():
        return ASCII_OTHER.sub(" ", low).strip().encode()
    return OTHER.sub(" ", low).strip().encode("utf-8", "replace") if LETTER.search(low) else b""


def train_dictionaries(
    labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_chars: int = DICT_CHARS
) -> dict[str, bytes]:
    """Language to dictionary content, most frequent language first, from (doc_id, text, lang) rows."""
    known = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.25 * sample_docs / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(place < F.element_at(share, F.col("lang"))).select(
        "lang", place.alias("place"), F.col("text").cast("string").alias("text")
    ).distinct()  # copies of a row count once
    own = Window.partitionBy("lang").orderBy("place", "text")
    before = F.sum(F.length("text")).over(own) - F.length("text")
    used = picked.withColumn("before", before).withColumn("nth", F.row_number().over(own)).where((F.col("before") < dict_chars) & (F.col("nth") <= sample_docs))
    parts: dict[str, list[bytes]] = {k: [] for k in sorted(counts, key=lambda k: (-counts[k], k))}
    for r in sorted(used.collect(), key=lambda r: r["nth"]):
        parts[r["lang"]].append(letters(r["text"]))
    return {k: b" ".join(v) for k, v in parts.items() if v}


class Coders:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = list(dictionaries)
        self.coders = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False).compress)

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected) of one text."""
        raw = letters(text or "")
        if not raw or not self.coders:
            return "und", 0.0, True
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        sizes = [sum(len(c(x)) for x in parts) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        low = sizes[best]
        score = 1.0 / sum(math.exp(max(-50.0, (low - s) / 4.0)) for s in sizes)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=low * 2)
        return self.names[best], score, (rest - low) < margin * low


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score and rejected to (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(held.value)
        for b in batches:
            out = [coders.predict(t.as_py(), margin) for t in b.column(1)]
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "lang_pred", "score", "rejected"])

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fold(folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(held.value)
        for b in few(batches):
            keep = pa.array([not coders.predict(t.as_py(), margin)[2] for t in b.column(at)], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train_dictionaries(docs.where(fold(4) != 2)))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")

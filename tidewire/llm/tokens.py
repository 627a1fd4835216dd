"""Token counts through a digest cache.

A count is stored under the digest of a text and the digest of the tokenizer's
file and settings. ``count_tokens`` joins the documents' digests to the cache,
encodes one text for each digest that is missing, appends those counts to the
cache and joins them back. Copies are thus encoded once, and a later run over a
grown corpus encodes only what is new.

The normalised content is the text with null read as empty: nothing more may be
changed, as white space and case alter the count. Only (digest, id) is
aggregated, so the copies of one text never meet in a task; texts travel once,
and only those that represent a missing digest are encoded, rows that repeat each
other once.

The cache is a table of Parquet files that runs append to. Two runs at a time may
both append a digest; it is read as one count. The registered query keeps one cache for
each corpus in the shared folder, so that a second run over it encodes nothing;
``count_tokens`` takes any cache, also one that corpora share.

``PieceCounter`` encodes a text in pieces. This model never merges a space into
the end of a piece, adds one space in front of a text and does no further
normalising, so a text can be cut before every run of spaces without changing
its tokens; counts of pieces are kept in a bounded table. For a model without
these properties whole texts are encoded.

Edge cases: null and empty texts have 0 tokens; repeated rows and equal texts
share one count; an empty table gives an empty result and leaves the cache as
it is; other columns are ignored.
"""

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.materialize import cut, shared_dir

LIMIT = 4096
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def _model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counts the tokens of texts with one sentencepiece model."""

    def __init__(self, path: str, keep: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.keep, self.known = keep, {}
        spec = pb.ModelProto()
        spec.ParseFromString(raw)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        self.cuts = (
            train.model_type == train.BPE
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and not train.treat_whitespace_as_suffix
            and not any("▁" in p.piece.lstrip("▁") for p in spec.pieces)
            and not any(p.type == p.USER_DEFINED for p in spec.pieces)
        )

    def whole(self, text: str) -> int:
        return len(self.model.encode(text)) if text else 0

    def _piece(self, piece: str) -> int:
        if not piece:  # one space at the end of a text
            return self.whole("a ") - self.whole("a")
        if (n := self.known.get(piece)) is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            n = self.model.encode(piece)
            n = self.known[piece] = len(n)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts or "▁" in text:
            return self.whole(text)
        if "  " not in text and text[0] != " " and text[-1] != " ":
            pieces = text.split(" ")
        else:  # each piece: spaces but for the one that the model adds itself, then the rest
            pieces = [m[1:] for m in re.findall(r" +[^ ]*", " " + text)]
        known = self.known.get
        total = 0
        for p in pieces:
            n = known(p)
            total += self._piece(p) if n is None else n
        return total


def tokenizer_digest(path: str) -> str:
    """Digest of the model's file, library version and encoding settings."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode() + b"|plain").hexdigest()


def encoded(batches: Iterator[pa.RecordBatch], count: Callable[[str], int]) -> Iterator[pa.RecordBatch]:
    """(content, text) batches to (content, n_tokens); neighbouring rows of one content are counted once."""
    last, n = None, 0
    for b in batches:
        out = []
        for content, text in zip(b.column(0), b.column(1), strict=True):
            if (content := content.as_py()) != last:
                last, n = content, count(text.as_py())
            out.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["content", "n_tokens"])


def encode_counts(texts: DataFrame, path: Callable[[], str]) -> DataFrame:
    """(content, text) rows to (content, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, PieceCounter(path()).count)

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str | None) -> DataFrame | None:
    """The cache table at a path, or None where nothing has been stored yet."""
    if not cache:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(docs: DataFrame, cache: str | None = None, path: Callable[[], str] = _model_path) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document; new counts are appended to ``cache``."""
    spark = docs.sparkSession
    version = tokenizer_digest(path())
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("content", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))
    keys = cut(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "tok-keys")
    stored = read_cache(spark, cache)
    wanted = keys
    if stored is not None:
        stored = stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        wanted = keys.join(stored, "content", "left_anti")
    pick = wanted.groupBy("content").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("pick"))
    misses = rows.withColumn("pick", F.coalesce("doc_id", F.lit(0))).join(pick, ["content", "pick"], "left_semi")
    new = encode_counts(misses, path).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    fresh = new.select("content", F.lit(version).alias("tokenizer"), "n_tokens")
    fresh = cut(fresh, "tok-new")
    if cache:
        fresh.write.mode("append").parquet(cache)
    counts = fresh.select("content", "n_tokens")
    if stored is not None:
        counts = counts.unionByName(stored).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")


def cache_dir(spark: SparkSession, corpus: str) -> str:
    """Where the registered query keeps the counts of a corpus."""
    return f"{shared_dir(spark)}/tidewire/token-counts/{hashlib.sha256(corpus.encode()).hexdigest()[:16]}"


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, cache_dir(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)

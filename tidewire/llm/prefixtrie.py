"""Conversation prefix trie by partition refinement: which openings are shared, and what sharing them saves.

``keyed_turns`` gives every turn its place in its conversation and a digest of role
and text; ``branched`` derives conversations that open like another one;
``prefix_trie`` returns one row per distinct opening.

Refinement: at first all conversations are in one class, the root. Each round
looks at the next turn of the classes that still hold several different
conversations, and splits them by that turn's digest; a class is named by its
smallest conversation. A class left with one conversation is retired: the rest of
that conversation is a chain without branches, read off its turns at once, however
long it is. When no class is active, the rounds are folded back from the deepest
to the root: children, leaves and saved words are summed per parent.

Equal conversations are one item with a weight from the start, so a group of
copies is retired as soon as it is alone. The number of rounds is the length of
the longest opening that two different conversations share, and each round holds
only the conversations that still share one. All sums are combined before their
shuffle; joins go by the conversation or by the class and turn, against one row per
key, so adaptive execution can split a large class. Places are counted over ranges,
sums along a chain over blocks of turns, so one very long conversation is many
tasks. The ids that end in a node are written as pieces of text by ranges and only
the pieces of a node are hashed in order: SHA-256 can't be split further, and a
piece stands for thousands of ids.

Edge cases: null role or text is empty; a null turn comes first; turns of equal
number go by role, then digest, and repeated rows are turns of their own; rows without a
conversation id belong to none and are left out; a conversation without turns is a
member of the root alone; an empty table has no members, so no root either; extra
columns are ignored, whatever their names.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.ranking import numbered
from tidewire.plans.materialize import Stored, cut, settled

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a chain that are summed in one piece, and ids in a piece of text that is hashed.
BLOCK_TURNS, PIECE_IDS = 4096, 8192
NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep"]


def keyed_turns(table: DataFrame) -> DataFrame:
    """(conv, pos, k1, k2, words): places from 1, a 128-bit digest of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = table.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit(1), text, role).alias("k2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return numbered(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("k1"), F.col("k2")], ("conv",), "pos").select("conv", F.col("pos").cast("long").alias("pos"), "k1", "k2", "words")


def _opening(conv):
    """How many turns a conversation takes from its model."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def branched(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the conversation ``conv - conv % every``.

    Returns the turns and a table of all conversations, also those left without turns.
    """
    sizes = cut(turns.groupBy("conv").agg(F.count("*").alias("n")), "trie-sizes")
    model = (F.col("conv") - F.col("conv") % every).alias("model")
    heads = sizes.select("conv", _opening(F.col("conv")).alias("h"), model).where("h > 0 and model <> conv")
    first = turns.where("pos <= 3").select(F.col("conv").alias("model"), "pos", "k1", "k2", "words")
    taken = heads.join(first, "model").where("pos <= h").select("conv", "pos", "k1", "k2", "words")
    had = heads.join(sizes.select(F.col("conv").alias("model"), F.col("n").alias("had")), "model", "left")
    short = had.where("coalesce(had, 0) < h").select("conv", (F.col("h") - F.coalesce("had", F.lit(0))).alias("less"))
    own = turns.where((model == F.col("conv")) | (F.col("pos") > _opening(F.col("conv")))).join(short, "conv", "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "k1", "k2", "words")
    return taken.unionByName(own), sizes.select("conv")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, first, ids): the sorted ids of one range as pieces of text, none of two groups."""
    for b in batches:
        rep, conv = b.column(0).to_pylist(), b.column(1).to_pylist()
        cuts = [i for i in range(len(rep)) if not i or rep[i] != rep[i - 1] or i % PIECE_IDS == 0] + [len(rep)]
        parts = [(rep[i], conv[i], ",".join(map(str, conv[i:j]))) for i, j in zip(cuts, cuts[1:], strict=False)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*parts, strict=True)], ["rep", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sha): SHA-256 over the pieces of each group as they come, in order."""
    at, sha = None, None

    def done(rep: int, sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()])], ["rep", "sha"])

    for b in batches:
        for rep, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if rep != at:
                if sha:
                    yield done(at, sha)
                at, sha = rep, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha:
        yield done(at, sha)


def group_digests(members: DataFrame) -> DataFrame:
    """(rep, sha): SHA-256 of each group's ids in ascending order, joined by commas."""
    ranges = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv")
    pieces = ranges.mapInArrow(_pieces, "rep long, first long, ids string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_digests, "rep long, sha string")


def _chains(turns: DataFrame, retired: DataFrame) -> DataFrame:
    """The nodes of retired conversations from the turn that set them apart to their last."""
    rows = retired.join(turns, F.col("rep") == F.col("conv")).where("pos >= at")
    rows = rows.select("rep", "m", "len", "at", "up", "pos", "words", F.floor(F.col("pos") / BLOCK_TURNS).alias("block"))
    copied = rows.where("m > 1")
    sums = copied.groupBy("rep", "block").agg(F.sum("words").alias("s"))
    later = F.sum("s").over(Window.partitionBy("rep").orderBy(F.desc("block"))) - F.col("s")
    inside = F.sum("words").over(Window.partitionBy("rep", "block").orderBy(F.desc("pos")))
    summed = copied.withColumn("inside", inside).join(sums.select("rep", "block", later.alias("later")), ["rep", "block"])
    summed = summed.withColumn("saved", (F.col("m") - 1) * (F.col("inside") + F.col("later"))).select("rep", "m", "len", "at", "up", "pos", "saved")
    rows = rows.where("m = 1").select("rep", "m", "len", "at", "up", "pos", F.lit(0).cast("long").alias("saved")).unionByName(summed)
    last = F.col("pos") == F.col("len")
    return rows.select(
        F.col("pos").alias("depth"),
        F.col("rep").alias("conv_id"),
        F.when(F.col("pos") == F.col("at"), F.col("up")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(last, F.col("rep")).alias("end_rep"),
        (F.col("pos") == F.col("at")).alias("top"),
    )


def _trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    digest = turns.groupBy("conv").agg(
        F.count("*").alias("len"), F.bit_xor(F.xxhash64("pos", "k1", "k2")).alias("d1"), F.bit_xor(F.xxhash64("k2", "pos", "k1")).alias("d2")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("len", "d1", "d2")]
    ends = cut(convs.join(digest, "conv", "left").select("conv", *zero), "trie-ends")
    groups = cut(ends.groupBy("len", "d1", "d2").agg(F.min("conv").alias("rep"), F.count("*").alias("m")), "trie-items")
    shas = cut(group_digests(ends.join(groups.where("m > 1"), ["len", "d1", "d2"])), "trie-shas")
    root = groups.agg(F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.max(F.expr("if(len = 0, rep, null)")).alias("end_rep")).where("conv_id is not null")
    name = root.first()
    levels = [root.select("conv_id", F.lit(None).cast("long").alias("up"), "n_convs", F.lit(0).cast("long").alias("words"), "end_rep")]
    retired = []
    active = groups.select("rep", "m", "len", F.lit(name.conv_id if name else None).cast("long").alias("cls"))
    while True:
        d = len(levels)
        step = cut(active.where(F.col("len") >= d).join(turns.where(F.col("pos") == d).select(F.col("conv").alias("rep"), "k1", "k2", "words"), "rep"), "trie-step")
        split = step.groupBy("cls", "k1", "k2").agg(
            F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.count("*").alias("items"), F.max("words").alias("words"),
            F.max("len").alias("len"), F.max(F.when(F.col("len") == d, F.col("rep"))).alias("end_rep"),
        )
        split = cut(split, "trie-split")
        retired.append(split.where("items = 1").select(F.col("conv_id").alias("rep"), F.col("n_convs").alias("m"), "len", F.lit(d).cast("long").alias("at"), F.col("cls").alias("up")))
        shared = split.where("items > 1")
        if shared.isEmpty():
            break
        levels.append(shared.select("conv_id", F.col("cls").alias("up"), "n_convs", "words", "end_rep"))
        active = step.join(shared.select("cls", "k1", "k2", "conv_id"), ["cls", "k1", "k2"]).select("rep", "m", "len", F.col("conv_id").alias("cls"))
    gone = retired[0]
    for r in retired[1:]:
        gone = gone.unionByName(r)
    chains = cut(_chains(turns, gone), "trie-chains")
    nodes = chains.select(*NODE)
    below = chains.where("top and depth = " + str(len(levels))).select(*NODE)
    for d in range(len(levels) - 1, -1, -1):
        kids = below.groupBy("parent_conv_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        level = levels[d].join(kids, F.col("conv_id") == F.col("parent_conv_id"), "left").select(
            F.lit(d).cast("long").alias("depth"), "conv_id", F.col("up").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("below", F.lit(0))).alias("saved_tokens"), "end_rep",
        )
        level = cut(level, "trie-level")
        nodes = nodes.unionByName(level)
        below = level.unionByName(chains.where(f"top and depth = {d}").select(*NODE))
    own = F.sha2(F.col("end_rep").cast("string").cast("binary"), 256)
    sha = F.when(F.col("end_rep").isNull(), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", own))
    return nodes.join(shas.withColumnRenamed("rep", "end_rep"), "end_rep", "left").select(*NODE[:-1], sha.alias("ends_sha256"))


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per distinct opening of the conversations in ``turns`` (conv, pos, k1, k2, words).

    ``convs`` lists all conversations, where some have no turns. Columns: depth,
    conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """

    def build() -> DataFrame:
        rows = cut(turns, "trie-turns")
        return _trie(rows, convs if convs is not None else rows.select("conv").distinct())

    return settled(build, "trie")


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        turns = Stored(keyed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-keyed")
        return prefix_trie(*branched(turns.df))

    return settled(build, "trie-nodes")


#: CRC-32 is written out over the bytes of the decimal id; a node is named by a digest of its opening.
OP13_SQL = r"""
WITH RECURSIVE steps(b, i, c) AS (
  SELECT b, 0, b::UBIGINT FROM range(256) r(b) UNION ALL
  SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 20 AS p, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)::BIGINT])), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM o), crc_table),
a AS (
  SELECT i.c, o.pos, o.role, o.text FROM ids i JOIN o ON o.c = i.p WHERE o.pos <= i.h
  UNION ALL SELECT i.c, 1000000 + o.pos, o.role, o.text FROM ids i JOIN o ON o.c = i.c WHERE o.pos > i.h),
r AS (
  SELECT c, text, row_number() OVER w AS d, sha256(array_to_string(list(sha256(role || chr(1) || text)) OVER w, '')) AS k
  FROM a WINDOW w AS (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (
  SELECT c, 0 AS d, '' AS k, '' AS text FROM ids UNION ALL SELECT c, d, k, text FROM r),
l AS (SELECT c, max(d) AS d FROM m GROUP BY c),
n AS (
  SELECT m.d, m.k, min(m.c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE l.d = m.d), '')) AS ends_sha256,
    (count(*) - 1) * len(regexp_extract_all(any_value(m.text), '[^\x20\x09-\x0D]+')) AS own
  FROM m JOIN l USING (c) GROUP BY m.d, m.k),
up AS (SELECT n.d, n.k, n.conv_id, n.own, m.d AS top, m.k AS above FROM n JOIN m ON m.c = n.conv_id AND m.d <= n.d),
kids AS (SELECT top AS d, above AS k, count(*) AS n_children FROM up WHERE d = top + 1 GROUP BY ALL),
parents AS (SELECT up.d, up.k, p.conv_id AS parent_conv_id FROM up JOIN n p ON p.d = up.top AND p.k = up.above WHERE up.top = up.d - 1),
sums AS (
  SELECT up.top AS d, up.above AS k, count(*) FILTER (WHERE kids.n_children IS NULL) AS n_leaves, sum(up.own) AS saved
  FROM up LEFT JOIN kids ON kids.d = up.d AND kids.k = up.k GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, parents.parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children,
  sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k LEFT JOIN parents ON parents.d = n.d AND parents.k = n.k JOIN sums ON sums.d = n.d AND sums.k = n.k
"""

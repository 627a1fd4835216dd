"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Four plain patterns (e-mail, IP address, card and phone number) find the seeds.
Around each seed, and around every other number-like or spelled-out string, the
neighbouring words form lexical patterns: the word before, the two words before,
the word after, and the words on both sides. A context ends at the next match of
the same kind of string. Patterns and the values they surround form a bipartite
graph, scored in rounds:

* a pattern's confidence for a kind is the weight of the values of that kind
  among all distinct values it surrounds and ``prior`` more that do not speak for
  it, so a pattern needs several values before it is believed;
* a value's score for a kind that its shape allows is one minus the chance that
  all the confident patterns around it are wrong.

Values of high score become spans of that kind; the seeds' spans always stay.
Confidences are computed anew in each round, so values found in one round lead to
patterns in the next. Sums are combined before each shuffle.

Offsets are in code points, end exclusive. They come from splitting a text at a
pattern's matches: pieces and matches alternate, so lengths add up to places,
first over blocks of pieces and then inside each, in time linear in the text. The
patterns are written with possessive repeats and look-behinds that change no
match but keep long runs of digits or letters linear. Which strings touch a base
span is found from the ends of the spans sorted before and after them.

Edge cases: null reads as empty; texts without data have empty spans and the
digest of the empty string; repeated rows get equal results; spans of one kind
never overlap, those of different kinds may; ties of kinds follow the listed
order; a text of any length and any number of matches is one row; an empty table
gives an empty result; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.materialize import cut

KINDS = ("email", "ip", "card", "phone")

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Strings that look like an identifier but need not be one, and the kinds that each can be.
NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9][0-9().\x20/-]{5,}[0-9](?![0-9A-Za-z])"
SPELLED = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[a-z0-9-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[a-z0-9-]++)++"
DEFANGED = r"(?i)(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|[\[({]dot[\])}])\x20?[0-9]{1,3}){3}(?![0-9.])"
BASE_SHAPE, NUMBER_SHAPE, SPELLED_SHAPE, DEFANGED_SHAPE = range(4)

PRIOR = 3.0
MIN_CONFIDENCE = 0.6
MIN_SCORE = 0.8
ROUNDS = 3
REACH = 64
BLOCK = 256

_SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> Column:
    """(start, end, m, before, after) of the leftmost non-overlapping matches in the column named ``text``, with what stands around them."""
    p = _quoted(pattern)
    long = "length(y.piece) + coalesce(length(y.m), 0)"
    part = f"slice(x, i * {BLOCK} + 1, {BLOCK})"
    inside = f"""
      aggregate({part}, named_struct('pos', pos, 'out', cast(array() AS {_SPAN})),
        (a, y) -> named_struct('pos', a.pos + {long}, 'out', if(y.m IS NULL, a.out, concat(a.out, array(named_struct(
          'start', a.pos + length(y.piece), 'end', a.pos + {long}, 'm', y.m, 'before', right(y.piece, {REACH}), 'after', left(y.next, {REACH})))))),
        a -> a.out)"""
    blocks = f"""
      aggregate(sequence(0, cast((size(x) - 1) div {BLOCK} AS int)), named_struct('pos', 0, 'out', cast(array() AS array<struct<i:int,pos:int>>)),
        (a, i) -> named_struct('pos', a.pos + aggregate({part}, 0, (n, y) -> n + {long}), 'out', concat(a.out, array(named_struct('i', i, 'pos', a.pos)))),
        a -> a.out)"""
    # arrays of one element bind a value once
    zipped = f"""
      transform(array(split({text}, {p}, -1)), s -> transform(
        arrays_zip(s, regexp_extract_all({text}, {p}, 0), slice(s, 2, size(s))),
        y -> named_struct('piece', y.s, 'm', y.`1`, 'next', y.`2`)))"""
    within = inside.replace("'pos', pos,", "'pos', b.pos,").replace("i *", "b.i *")
    return F.expr(f"transform({zipped}, x -> flatten(transform({blocks}, b -> {within})))[0]")


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]+", ""))


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn test."""
    d = F.reverse(F.regexp_replace(m, "[^0-9]+", ""))
    each = F.transform(F.split(d, ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(found: Column, kind: int, holds) -> Column:
    good = F.filter(found, lambda s: holds(s["m"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after")))


def base_spans(text: str) -> Column:
    """(start, kind, end, m, before, after) of the plain patterns, by start and then kind."""
    some = F.col(text)
    digit = some.rlike("[0-9]")
    rules = [
        (EMAIL, some.contains("@"), lambda m: F.lit(True)),
        (IP, digit & some.contains("."), lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        (CARD, digit, lambda m: F.when(_digits(m).between(12, 19), luhn(m)).otherwise(False)),
        (PHONE, some.contains("+"), lambda m: _digits(m).between(9, 15)),
    ]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,m:string,before:string,after:string>>")
    parts = []
    for kind, (pattern, guard, holds) in enumerate(rules):
        parts.append(F.coalesce(_valid(F.when(guard, matches(text, pattern)), kind, holds), none))
    return F.array_sort(F.concat(*parts))


def _loose(text: str) -> Column:
    """(start, end, m, before, after, shape) of identifier-like strings, whether or not a base span is there."""
    some = F.col(text)
    rules = [
        (NUMBER_SHAPE, NUMBER, some.rlike("[0-9]")),
        (SPELLED_SHAPE, SPELLED, some.rlike(r"(?i)[\[({]at[\])}]")),
        (DEFANGED_SHAPE, DEFANGED, some.rlike(r"(?i)[0-9]\x20?[\[({](?:\.|dot)[\])}]")),
    ]
    none = F.array().cast(_SPAN)
    tag = lambda a, v: F.transform(a, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "m", "before", "after")], F.lit(v).alias("shape")))
    return F.concat(*[tag(F.coalesce(F.when(guard, matches(text, pattern)), none), shape) for shape, pattern, guard in rules])


def _context(before: Column, after: Column) -> Column:
    """Patterns of what stands around a string: words before, after, and on both sides."""
    fold = lambda x: F.split(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}]+", " ")), " ")
    before, after = fold(before), fold(F.coalesce(after, F.lit("")))
    one, two, nxt = F.element_at(before, -1), F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2), " "), F.get(after, 0)
    two = F.when(F.size(before) > 1, two)
    sides = F.array(
        F.when(one != "", F.concat(F.lit("L1 "), one)),
        F.concat(F.lit("L2 "), two),
        F.when(nxt != "", F.concat(F.lit("R1 "), nxt)),
        F.when((one != "") & (nxt != ""), F.concat(F.lit("LR "), one, F.lit(" | "), nxt)),
    )
    return F.filter(sides, lambda x: x.isNotNull())


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base spans and, for each identifier-like string, its value, kind (-1: none yet), shape and patterns."""
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("base", base_spans("text")).withColumn("loose", _loose("text"))

    def node(s, kind, shape):
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), shape.alias("shape"),
            F.regexp_replace(F.lower(s["m"]), r"[^\p{L}0-9@.]+", "").alias("value"), _digits(s["m"]).alias("digits"), _context(s["before"], s["after"]).alias("patterns"),
        )

    nodes = F.concat(
        F.transform("base", lambda s: node(s, s["kind"], F.lit(BASE_SHAPE))),
        F.transform("loose", lambda s: node(s, F.lit(-1), s["shape"])),
    )
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return d.select("doc_id", "row_key", base.alias("base"), nodes.alias("nodes"))


def _apart(nodes: DataFrame) -> DataFrame:
    """The nodes without those loose ones that touch a base span of their document."""
    own = Window.partitionBy("doc_id", "row_key")
    seed = F.col("kind") >= 0
    up = own.orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    down = own.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    d = nodes.withColumn("reach", F.max(F.when(seed, F.col("end"))).over(up)).withColumn("next", F.min(F.when(seed, F.col("start"))).over(down))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return d.where(seed | free).drop("reach", "next")


def _kinds() -> Column:
    """The kinds that a node can be."""
    some = F.filter(F.array(F.when(F.col("digits").between(12, 19), F.lit(2)), F.when(F.col("digits").between(7, 15), F.lit(3))), lambda x: x.isNotNull())
    spelled, defanged = (F.col("shape") == x for x in (SPELLED_SHAPE, DEFANGED_SHAPE))
    return F.when(F.col("kind") >= 0, F.array("kind")).when(spelled, F.array(F.lit(0))).when(defanged, F.array(F.lit(1))).otherwise(some)


def discover(found: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(doc_id, row_key, start, kind, end) of the spans that the patterns add."""
    nodes = found.select("doc_id", "row_key", F.explode("nodes").alias("n")).select("doc_id", "row_key", "n.*").distinct()
    nodes = cut(_apart(nodes).withColumn("kinds", _kinds()), "pii-nodes")
    edges = cut(nodes.select("value", "kind", "kinds", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    size = cut(edges.groupBy("pattern").agg(F.count_distinct("value").alias("around")), "pii-size")
    links = cut(edges.select("pattern", "value", (F.col("kind") >= 0).alias("seed"), F.explode("kinds").alias("k")).distinct(), "pii-links")
    scores = links.where("seed").select("value", "k").distinct().withColumn("score", F.lit(1.0))
    fixed = scores
    for _ in range(ROUNDS):
        weight = links.join(scores, ["value", "k"]).select("pattern", "value", "k", "score").distinct().groupBy("pattern", "k").agg(F.sum("score").alias("weight"))
        trusted = weight.join(size, "pattern").withColumn("confidence", F.col("weight") / (F.col("around") + prior))
        trusted = trusted.where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "k", "confidence")
        reached = links.where("not seed").join(trusted, ["pattern", "k"]).groupBy("value", "k")
        new = reached.agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = cut(fixed.unionByName(new.join(fixed, ["value", "k"], "left_anti")), "pii-scores")
    good = scores.where(F.col("score") >= MIN_SCORE).groupBy("value").agg(F.min_by("k", F.struct(-F.col("score"), F.col("k"))).alias("k"))
    added = nodes.where("kind < 0").join(good, "value").where(F.array_contains("kinds", F.col("k")))
    return added.select("doc_id", "row_key", "start", F.col("k").alias("kind"), "end")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, all spans, and the number that patterns added."""
    found = cut(found_spans(docs), "pii-found")
    added = discover(found).distinct()
    added = added.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "added")
    d = found.select("doc_id", "row_key", "base").join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    more = F.coalesce("added", none)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", more))).alias("spans"),
        F.size(more).cast("long").alias("n_added"),
    )


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

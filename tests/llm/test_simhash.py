import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, tau=4):
    label = {i: i for i, _ in pairs}
    ids, fps = [i for i, _ in pairs], np.array([f for _, f in pairs], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            low = min(label[ids[b]] for b in np.flatnonzero(near[a]))
            if low < label[ids[a]]:
                label[ids[a]], changed = low, True
    return label


def test_fingerprint_matches_plain_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 6, 40):
        text = "".join(rng.choice("abÄé \t\n XY") for _ in range(n * 6))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, texts[0]), (1002, texts[0])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component int")
    got = simhash.near_duplicates(df).collect()
    want = brute_components([(i, simhash.fingerprint(t)) for i, t in rows])
    assert len(got) == len(rows)
    assert {r.doc_id: r.component for r in got} == want


def test_dense_groups_and_far_bits(spark):
    rng = random.Random(3)
    fps = {}
    for g in range(4):
        base = rng.getrandbits(64)
        for _ in range(150):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps[x] = len(fps)
    pairs = [(i, f) for f, i in fps.items()]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs], "id long, fp long")
    for per_key in (2, 3):
        got = {r.node: r.component for r in simhash.link_components(df, per_key=per_key).collect()}
        assert got == brute_components(pairs)


def test_turned_bits_stay_within_the_budgets():
    assert len(simhash._turns([13], 4, 5)) == 14 and len(simhash._turns([13, 13], 4, 5)) == 1 + 13 + 78 + 13 * 14


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [(1, text), (2, text + " end"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].fp & (1 << 64) - 1 == simhash.fingerprint(text) == brute_fingerprint(text)
    assert got[2].component == 1 and got[4].component == 3


def test_empty_and_survivors(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(2, "a b c d e f g"), (1, "a b c d e f g"), (3, "other words here now"), (None, "a b c d e f g")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in simhash.one_per_group(df).collect()) == [0, 1, 3]


def test_probes_are_never_broadcast(spark, monkeypatch):
    plans = []
    found = simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda e: plans.append(e._jdf.queryExecution().executedPlan().toString()) or found(e))
    simhash.link_components(spark.range(2000).select("id", F.xxhash64("id").alias("fp"))).count()
    assert "SortMergeJoin" in plans[1] and "Broadcast" not in plans[1]

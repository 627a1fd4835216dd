import hashlib
import random
import re

from tidewire.llm import decontaminate as d


def brute(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, text in docs:
        w, hit, ids = low(text), set(), set()
        for item, t in items:
            v = low(t)
            n = min(10, len(v))
            for q in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[q : q + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out.append((i or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_against_brute_force_in_blocks(spark):
    rng = random.Random(11)
    words = ["Aa", "bb", "É", "c3", "dd"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 9, 10, 11, 14, 30]))) for i in range(40)] + [(40, None), (41, "..."), (7, text(12)), (42, "aa " * 40)]
    docs = [(i, text(rng.choice([0, 2, 9, 10, 40, 120]))) for i in range(40)]
    docs += [(100 + i, f"zz zz {t} zz") for i, (_, t) in enumerate(items) if t][:30] + [(200, None), (201, ""), (201, ""), (None, items[0][1]), (202, "aa " * 300)]
    df = spark.createDataFrame([(i, t, "x", b"1") for i, t in docs], "doc_id long, text string, n_hit string, _hit binary").drop("_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (1000, 7):
        got = d.report(df, bench, block_items=size).collect()
        assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in got) == want
    clean = d.decontaminated(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == sum(not w[-1] for w in want)


def test_winnowing_guarantee():
    rng = random.Random(2)
    import numpy as np

    for _ in range(200):
        shared = np.array([rng.randrange(1, 9) for _ in range(10)], np.uint64)
        a, b = (np.concatenate([np.array([rng.randrange(1, 9) for _ in range(rng.randrange(20))], np.uint64), shared, np.array([rng.randrange(1, 9) for _ in range(rng.randrange(20))], np.uint64)]) for _ in "ab")
        ha, hb = d.gram_hashes(a, 5), d.gram_hashes(b, 5)
        assert set(ha[d.winnow(ha, 6)].tolist()) & set(hb[d.winnow(hb, 6)].tolist())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.report(docs, none).collect()[0].contaminated is False
    assert d.report(docs.limit(0), none).count() == 0
    clash = docs.selectExpr("doc_id", "text", "'h' AS _hit", "array(1) AS _items", "2 AS _0", "3 AS _1")
    assert d.decontaminated(clash, none).collect() == clash.collect()


def test_shared_preamble_nameless_items_and_very_long_texts(spark):
    import time

    preamble = "please answer the question below in one short sentence and explain why"
    items = [(i, f"{preamble} item number {i}") for i in range(20_000)]
    begin = time.perf_counter()
    index = d.Index(items)
    built = time.perf_counter() - begin
    words = d.words_of(f"{preamble} " * 25)
    begin = time.perf_counter()
    hit, (n, names) = index.find(words)
    assert hit.all() and n == 20_000 and names.count("\0") == 19_999
    for _ in range(20):
        index.find(words)
    assert time.perf_counter() - begin < 1 and built < 20
    rows = [(1, "x " * 400_000 + preamble + " y" * 400_000), (2, f"say {preamble}"), (3, "clean words")]
    bench = spark.createDataFrame([(None, preamble), (None, "two words"), (7, preamble), (8, None)], "item_id long, text string")
    got = {r.doc_id: r for r in d.report(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got[1].n_words == 800_012 and got[1].n_hit == 12 and got[1].n_items == got[2].n_items == 2
    assert got[1].items_sha256 == hashlib.sha256(b"7").hexdigest() and not got[3].contaminated


def test_blocks_list_equal_ids_once(spark):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, text), (2, text), (1, text), (None, text), (None, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for size in (1, 2, 10):
        r = d.report(docs, bench, block_items=size).first()
        assert r.n_items == 3 and r.items_sha256 == hashlib.sha256(b"1,2").hexdigest() and r.n_hit == 10

import random
import re

from tidewire.llm import licenses


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_against_plain_scan(spark):
    rng = random.Random(8)
    bits = ["MIT", "License", "gnu", "general", "public", "apache", "CC-BY", "by", "cc", "é", "K", "x1", ". ", "the"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "MIT-License\nmit license"), (1002, "MIT-License\nmit license"), (1003, "a" * 30000), (None, "cc by")]
    df = spark.createDataFrame([(i, t, "l", 1.0, 1) for i, t in rows], "doc_id long, text string, labels string, score double, w int")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in licenses.scan(df).collect()))
    want = []
    for i, t in rows:
        w = words_of(t)
        hits = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        want.append((i or 0, len(w), len(hits), min([p for p, _ in hits], default=-1), max([p for p, _ in hits], default=-1), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want)


def test_notices(spark):
    rows = [(i, f"some text. {n.upper()}, and more") for i, (_, n, _) in enumerate(licenses.NOTICES)]
    rows.append((90, "redistribution of food and use in the kitchen"))
    rows.append((91, "permission is hereby granted to nobody"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(licenses.NOTICES):
        assert label in got[i].labels.split(","), label
        assert got[i].score > 0.99
    assert got[90].labels == "" and got[90].score == 0 and got[91].labels == ""
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_labels(text):
    """Labels and best cover by trying every notice at every place of its key phrase."""
    w = words_of(text)
    index = licenses.Index(licenses.NOTICES)
    labels = {label for phrase, label in licenses.PHRASES.items() if any(w[p : p + len(phrase.split())] == phrase.split() for p in range(len(w)))}
    best = 0.5 if labels else 0.0
    covers = []
    for t, words in enumerate(index.words):
        at, n = index.keys[t]
        total = sum(index.idf[x] for x in words)
        for p in range(len(w) - n + 1):
            if w[p : p + n] == words[at : at + n]:
                o = p - at
                covers.append((sum(index.idf[x] for j, x in enumerate(words) if 0 <= o + j < len(w) and w[o + j] == x) / total, index.labels[t]))
    kept = [(c, x) for c, x in covers if c >= licenses.MIN_COVER]
    return ",".join(sorted(labels | {x for _, x in kept})), max([c for c, _ in kept], default=best)


def test_labels_and_score_against_all_places(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(licenses.NOTICES)[1].split()
            if rng.random() < 0.6:
                words = [x if rng.random() < 0.9 else "other" for x in words[rng.randrange(3) : len(words) - rng.randrange(3)]]
            text += words + ["filler"] * rng.randrange(4)
        rows.append((i, " ".join(text)))
    got = {r.doc_id: (r.labels, round(r.score, 6)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (x, round(min(1.0, s), 6)) for i, t in rows for x, s in [brute_labels(t)]}


def test_a_text_of_notices_alone_takes_linear_time(spark):
    import time

    took = []
    for n in (10_000, 100_000):
        df = spark.createDataFrame([(1, "released under the mit license. " * n)], "doc_id long, text string")
        begin = time.perf_counter()
        assert licenses.scan(df).first().n_base == n
        took.append(time.perf_counter() - begin)
    assert took[1] < 10 * took[0] + 30

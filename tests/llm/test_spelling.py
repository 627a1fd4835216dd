import random
import re
import zlib
from collections import Counter

import pytest

from tidewire.llm import spelling


def brute_counts(docs):
    found = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def got(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("size", [7, 1000])
def test_pairs_in_many_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "RANGE_WORDS", size)
    rng = random.Random(size)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 8))): rng.choice([1, 1, 2, 3, 9, 40]) for _ in range(160)} | {"a" * i: i for i in range(1, 30)}
    rows = got(spelling.spellings(spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, form string, other int")))
    assert set(rows) == brute(words) and len(rows) == len(words)


def test_every_pair_is_met_once_and_work_stays_small():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(4000)})
    light = sum(b - a for _, kids, *_ in spelling.light_edges(words, words[:1]) for _, a, b in kids)
    assert light <= len(words) * len(words).bit_length()


def test_whole_operator(spark):
    rng = random.Random(3)
    base = ["colour", "color", "colours", "center", "centre", "straße", "strasse", "÷×äöü", "überall", "Überall", "naïve"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", "s", "", ""]) for _ in range(200)), "x", 1) for i in range(40)]
    docs += [(None, "nameless nameless nameless", "x", 1), (90, None, "x", 1), (91, "", "x", 1), (92, "日本語 １２３ short tiny", "x", 1), (7, docs[7][1], "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n int")
    rows = got(spelling.spellings(spelling.word_counts(df)))
    assert set(rows) == brute(brute_counts(docs)) and len(rows) == len(set(rows))
    assert any(r[0] == "nameless" and r[3] == 3 for r in rows)


def test_chain_of_forms_and_ties(spark):
    chain = {"aaaaaa": 1, "aaaaab": 2, "aaaabb": 4, "aaabbb": 8, "aabbbb": 16, "abbbbb": 32, "bbbbbb": 64, "bbbbbc": 64, "zzzzz": 5}
    rows = got(spelling.spellings(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert set(rows) == brute(chain)
    assert {r[0]: r[2] for r in rows}["aaaaaa"] == "bbbbbb"


def test_very_long_word_and_empty_tables(spark):
    long = "ab" * 200_000
    docs = [(i, f"{long} {long}x") for i in range(3)]
    counts = brute_counts(docs)
    rows = got(spelling.spellings(spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert {(r[0], r[3]) for r in rows} == set(counts.items()) and all(r[4] == 1 for r in rows if len(counts) == 2)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(spelling.spellings(spelling.word_counts(none))) == []

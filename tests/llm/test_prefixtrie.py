import hashlib
import random
import re
import zlib

import pytest

from tidewire.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, pos int, words string, depth string"


def rebuilt(rows):
    """Conversations by id after branching, as lists of (role, text)."""
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + v[h:]
    return out


def brute(convs):
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    own = {p: (len(m) - 1) * len(re.findall(prefixtrie.WORD, p[-1][1])) if p else 0 for p, m in nodes.items()}
    kids = {p: [] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own[p] + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(convs[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.append((len(p), min(nodes[p]), up, len(nodes[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie(spark, rows, branch=True):
    turns = prefixtrie.keyed_turns(spark.createDataFrame(rows, SCHEMA))
    found = prefixtrie.prefix_trie(*(prefixtrie.branched(turns) if branch else (turns, None)))
    return sorted(tuple(r) for r in found.select(*prefixtrie.NODE[:-1], "ends_sha256").collect())


def row(c, t, role, text):
    return (c, t, role, text, 7, "x", "y")


def shapes(seed):
    rng = random.Random(seed)
    talk = [[("user" if i % 2 else "assistant", rng.choice(["a b", "a  b", "c\td", "", "é x y"])) for i in range(rng.randint(1, 6))] for _ in range(9)]
    rows = []
    for c in rng.sample(range(0, 90), 50):
        for i, (role, text) in enumerate(rng.choice(talk) if rng.random() < 0.6 else [(rng.choice("ab"), rng.choice("xyz")) for _ in range(rng.randint(1, 4))]):
            rows.append(row(c, i, role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = shapes(seed)
    assert trie(spark, rows) == brute(rebuilt(rows))


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [row(None, 1, "user", "lost"), row(3, None, None, None), row(3, 2, "user", "b"), row(3, 2, "user", "b"), row(3, -1, "u", None), row(-21, 5, "user", "q r")]
    # a model without turns of its own, models shorter than the opening, conversations that lose all turns
    rows += [row(c, 0, "user", "only turn") for c in range(100, 140)]
    want = brute(rebuilt_truncating(rows))
    assert trie(spark, rows) == want
    assert any(d == 0 and h != hashlib.sha256(b"").hexdigest() for d, *_, h in want)


def rebuilt_truncating(rows):
    """As ``rebuilt``, with the remainder of a negative id towards zero, as SQL has it."""
    fixed = {c: c + 0 for c, *_ in rows if c is not None}
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in fixed:
        h = zlib.crc32(str(c).encode()) % 4
        model = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(model, [])[:h] + own[c][h:]
    return out


def test_long_conversation_copies_and_digest_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE_IDS", 3)
    monkeypatch.setattr(prefixtrie, "BLOCK_TURNS", 8)
    rows = [row(c, i, "user", f"turn {i} of it") for c in (4, 11, 7, 2, 13, 21, 30) for i in range(40)] + [row(5, i, "user", f"turn {i}") for i in range(3)]
    assert trie(spark, rows, branch=False) == brute({c: [("user", f"turn {i} of it") for i in range(40)] for c in (4, 11, 7, 2, 13, 21, 30)} | {5: [("user", f"turn {i}") for i in range(3)]})


def test_empty_table_and_one_conversation(spark):
    assert trie(spark, []) == []
    one = [row(8, 0, "user", "a b c")]
    assert trie(spark, one, branch=False) == brute({8: [("user", "a b c")]})

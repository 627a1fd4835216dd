import random

from tidewire.llm import linededup as ld


def test_align_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(14))] for _ in "ab")
        pairs = ld.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert ld.align([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert ld.align([9, 5, 6, 7, 8], [1, 5, 6, 2, 7]) == [(1, 1), (2, 2), (3, 4)]


def kept_rows(ld, df):
    return ld.deduplicated(df).collect()


def test_planted_passages(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = [line(30), "", line(25)]
    boiler = "all rights reserved here"
    rows, carries = [], []
    for i in range(60):
        own = [line(12) for _ in range(6)] + [boiler]
        if i % 3 == 0:
            at = rng.randrange(len(own))
            own[at:at] = [x + " " * (i % 2) for x in passage]
            carries.append(i)
        rows.append((i, "\n".join(own)))
    rows += [(100, rows[5][1]), (101, rows[5][1] + "\n" + line(40)), (102, None), (103, ""), (104, rows[0][1]), (104, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, t, "g", len(t or ""), 1) for i, t in rows], "doc_id long, text string, gone string, n_chars long, words int")
    got = {r.doc_id: r for r in ld.report(df).collect()}
    assert len(rows) == ld.report(df).count()
    for i in range(60):
        want = 3 if i in carries[1:] else 0
        assert got[i].n_deleted_lines == want, i
    assert got[carries[3]].kept_in == "0"
    assert got[100].n_deleted_lines == 7 and got[101].n_deleted_lines == 7
    assert got[None].n_deleted_lines == 0 and got[102].n_deleted_lines == 0
    kept = {r.doc_id: r for r in ld.deduplicated(df).collect()}
    assert ld.deduplicated(df).columns == df.columns
    assert 100 not in kept and 104 not in kept and 102 in kept and 103 in kept and None in kept
    for i in range(60):
        text = kept[i].text
        assert boiler in text and kept[i].n_chars == len(text)
        assert (passage[0] in text) == (i == carries[0])
    assert ld.deduplicated(df, drop_emptied=False).count() == len(rows)
    assert ld.report(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "'h' AS _gone", "1 AS _id", "2 AS _key", "3 AS _row", "4 AS row_key")
    assert ld.deduplicated(clash).columns == clash.columns and ld.deduplicated(clash).count() == len(kept_rows(ld, df))


def brute(rows, min_words):
    """Line numbers that lie in a run of min_words words that a document of smaller id holds, over all pairs."""
    lines = {}
    for i, t in rows:
        lines[i] = [(no, x.strip(" \t\x0b\x0c\r"), len(x.split())) for no, x in enumerate((t or "").split("\n")) if x.split()]
    out = {}
    for i, a in lines.items():
        gone = set()
        for j, b in lines.items():
            if j >= i:
                continue
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n][1] == b[y + n][1]:
                        n += 1
                    if sum(k[2] for k in a[x : x + n]) >= min_words:
                        gone |= set(range(x, x + n))
        full = set()
        for k in gone:
            full |= set(range(a[k][0], a[k + 1][0])) if k + 1 in gone else {a[k][0]}
        out[i] = ",".join(map(str, sorted(full)))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(12)
    pool = [" ".join(f"p{k}x{n}" for n in range(rng.randrange(1, 14))) for k in range(24)]
    rows = []
    for i in range(240):  # passages moved, repeated, chained, cut short, and split over several earlier documents
        at, t = rng.randrange(24), []
        for _ in range(rng.randrange(9)):
            t.append(rng.choice(["", " ", pool[at % 24], pool[at % 24] + "\t", f"own {i} {rng.random()}"]))
            at += rng.choice([1, 1, 1, 1, 7, -3])
        rows.append((i, "\n".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.deleted_lines for r in ld.report(df, 12).collect()}
    want = brute(rows, 12)
    assert sum(bool(x) for x in want.values()) > 40
    assert got == want


def test_passages_whose_lines_were_seen_elsewhere(spark):
    line = lambda c, n=12: " ".join(f"{c}{k}" for k in range(n))
    x, y, z = map(line, "xyz")
    rows = [(0, f"{x}\n{y}"), (1, f"{y}\n{z}"), (2, f"{x}\n{y}\n{z}"), (3, f"{x}\n{y}\n{z}")]
    eight = [line(f"e{k}q", 7) for k in range(8)]
    rows += [(10 + k, f"{eight[k]}\n{eight[k + 1]}") for k in range(7)] + [(20, "\n".join(eight)), (21, "head\n" + "\n".join(eight))]
    a, b = "\n".join(line(f"a{k}q") for k in range(5)), "\n".join(line(f"b{k}q") for k in range(5))
    rows += [(30, f"{a}\n{a}\n{b}\nmid"), (31, f"top\n{b}\n{a}"), (32, f"{a}\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_deleted_lines for r in ld.report(df).collect()}
    assert got[2] == 0 and got[3] == 3 and got[20] == 0 and got[21] == 8 and got[31] == 10 and got[32] == 5


def test_repeated_and_very_long_rows(spark):
    passage = "\n".join(f"w{k} of the passage that is shared" for k in range(8))
    rows = [(1, passage)] * 300 + [(2, "x\n" + passage)] * 300 + [(1, f"other text {k}\n{passage}") for k in range(20)]
    rows += [(3, "\n".join(f"line {k % 40000} of a very long text" for k in range(120_000)) + "\n" + passage), (4, "a\n" * 50_000 + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.report(df).collect()
    assert len(got) == len(rows)
    assert {r.n_deleted_lines for r in got if r.doc_id == 1} == {0} and {r.n_deleted_lines for r in got if r.doc_id != 1} == {8}
    left = {r.doc_id: r.text for r in ld.deduplicated(df).where("doc_id > 2").collect()}
    assert left[4] == "\n".join(["a"] * 50_000) and left[3].count("\n") == 119_999

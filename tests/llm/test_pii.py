import hashlib
import re

from tidewire.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_match_plain_patterns(spark):
    texts = [
        "a@b.c%d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.3.255", "+1 (555) 222-3333 ++1-23-456-7890-", "4111 1111 1111 1111 é🙂 x@y.zz 4111-1111-1111-1112",
        "a@b..c@d.e @x.y a@b.c.@d.e", "9" * 5000 + " " + "a" * 5000 + "@x.y", "", None, "1234567890123456789012 4111111111111111-", "+" * 50 + "1" * 12, "4111111111111111 4111111111111111",
        "é" * 40000 + " me@you.org", "+1 23 (", "%@-.-.", "1.1.1.1.1", "+4111111111111111",
    ]
    rows = [(i, t, "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "s", 0), (None, "z@z.zz", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base int")
    got = pii.scan(df).collect()
    assert len(got) == len(rows)
    text = dict(enumerate(texts)) | {None: "z@z.zz"}
    for r in got:
        want = brute(text[r.doc_id] or "")
        assert r.spans == listed(want), r
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)]
    assert pii.scan(df.limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"note {i}: please call extension +1 (55{i % 10}) 555-{1000 + i * 7} today") for i in range(30)]
    rows += [(100, "please call extension 555-867-5309 today"), (101, "row 8675309123 of the table"), (102, "write to jane [at] example [dot] org")]
    rows += [(200 + i, f"reach the owner user{i}@mail.org soon") for i in range(30)] + [(300, "reach the owner jane [at] example [dot] org soon")]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:22:34" and got[100].n_phone == 0 and got[100].n_added == 1
    assert got[101].spans == "" and got[300].spans == "email:16:43"
    assert all(got[i].n_added == 0 for i in range(30))


def test_found_values_lead_to_further_patterns(spark):
    rows = [(i, f"note {i}: please call extension +1 (55{i % 10}) 555-{1000 + i * 7} today") for i in range(30)]
    rows += [(100 + i, f"please call extension 555-867-{5300 + i} today") for i in range(10)]
    rows += [(200 + i, f"leave word at desk line 555-867-{5300 + i} overnight") for i in range(10)]
    rows += [(300, "leave word at desk line 555-444-1234 overnight"), (301, "row 8675309123 of the table")]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300].spans == "phone:24:36" and got[300].n_phone == 0 and got[301].spans == ""


def test_defanged_addresses_are_reached(spark):
    rows = [(i, f"note: login from host 10.0.{i}.7 was refused") for i in range(12)] + [(100, "login from host 10[.]9[.]8[.]7 was refused"), (101, "see 10[.]9[.]8[.]7")]
    rows += [(200, "part 1 [dot] 2 [dot] 3 [dot] 4 of it")]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "ip:16:30" and got[100].n_ip == 0 and got[101].spans == "ip:4:18" and got[200].spans == ""


def test_many_matches_in_one_text(spark):
    import time

    parts = [f"user{i}@mail.org 10.0.{i % 256}.1 call 555-{i:07d} " for i in range(50_000)]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text), (1, text), (2, "a@b.c")], "doc_id long, text string")
    begin = time.perf_counter()
    got = pii.scan(df).orderBy("doc_id").collect()
    assert time.perf_counter() - begin < 60
    assert got[0].n_email == got[0].n_ip == 50_000 and got[0].base_sha256 == hashlib.sha256(listed(brute(text)).encode()).hexdigest()
    assert got[0] == got[1] and got[2].spans == "email:0:5"

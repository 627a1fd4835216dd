from tidewire.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op6_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and held
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) / len(got) < 0.02


def test_edges(spark):
    rows = [(1, "the cat and the dog " * 5, "en"), (2, "le chat et le chien " * 5, "fr"), (3, None, "en"), (4, "123 !!", "fr"), (5, "", None), (6, "the dog " * 20000, None), (6, "the dog " * 20000, None)]
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    dicts = langid.train_dictionaries(df)
    got = {r.doc_id: r for r in langid.identify(df, dicts).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr" and got[6].lang_pred == "en"
    for i in (3, 4, 5):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(df, dicts)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6}
    assert langid.identify(df, {}).where("lang_pred <> 'und'").count() == 0
    empty = df.limit(0)
    assert langid.train_dictionaries(empty) == {} and langid.identify(empty, dicts).count() == 0


def test_und_exactly_without_letters(spark):
    import unicodedata

    odd = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]  # unassigned ones may be letters of a later standard
    for c in odd:
        assert bool(langid.letters(c)) == any(unicodedata.category(x).startswith("L") for x in c.lower()), hex(ord(c))
    rows = [(i, t, None) for i, t in enumerate(["½ ① ²", "Ⅳ ★ \u0301", "हिन्दी में", "ภาษาไทย", "ª", "_9"])] + [(10 + i, t, l) for i in range(3) for t, l in (("the cat and dog", "en"), ("नमस्ते दुनिया में", "hi"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train_dictionaries(df)).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, False, False, False, True] and got[2] == "hi"
    assert "हिन्दी में".encode() == langid.letters("हिन्दी, में!")


def test_ties_and_whole_training_texts(spark):
    rows = [(i, "same words here", "bb") for i in range(3)] + [(10 + i, "same words here", "aa") for i in range(3)] + [(20, "x" * 70_000, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = langid.train_dictionaries(df)
    assert list(dicts) == ["aa", "bb", "zz"] and dicts["aa"] == dicts["bb"] and len(dicts["zz"]) == 70_000
    assert {(r.lang_pred, r.rejected) for r in langid.identify(df.where("doc_id < 20"), dicts).collect()} == {("aa", True)}
    long = spark.createDataFrame([(1, "word " * 9000 + "ending", "en")], "doc_id long, text string, lang string")
    assert langid.train_dictionaries(long)["en"].endswith(b"ending")


def test_query_equals_encoding_each_document(spark, sf):
    import math
    import unicodedata
    import zlib

    import zstandard

    table = spark.read.parquet(f"{sf}/documents.parquet")
    dicts = langid.train_dictionaries(table.where(langid.fold(4) != 2))
    coders = {k: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in dicts.items()}
    got = {r.doc_id: r for r in langid.op6_language(spark, sf).collect()}
    for r in table.collect():
        low = (r.text or "").lower()
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in low)
        raw = " ".join(kept.split()).encode()
        own = got[r.doc_id]
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not raw:
            assert own.lang_pred == "und"
            continue
        size = {k: sum(len(c.compress(raw[i : i + langid.CHUNK])) for i in range(0, len(raw), langid.CHUNK)) for k, c in coders.items()}
        low = min(size.values())
        assert size[own.lang_pred] <= low * 1.002
        assert abs(own.score - 1 / sum(math.exp(max(-50, (low - x) / 4)) for x in size.values())) < 0.2

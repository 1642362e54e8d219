import pytest

from sparkloka.llm import languages as G


def test_filters_return_what_was_added():
    f = G.Filters()
    f.add("=yang", 0)
    f.add("=the", 1)
    f.add("=yang", 2)
    assert f.languages("=yang") == 0b101 and f.languages("=the") == 0b10 and f.languages("=zzz") == 0
    assert all(0 <= r < 1e-9 for r in f.false_rates())


def test_false_positives_are_predicted():
    f = G.Filters()
    for i in range(120_000):
        f.add(f"g{i}", 3)
    rate = sum(f.languages(f"other{i}") >> 3 & 1 for i in range(20_000)) / 20_000
    assert rate == pytest.approx(f.false_rates()[3], rel=0.2)


def test_codes(spark):
    df = spark.createDataFrame([(x,) for x in ["id-ID", "IND", "in", "Javanese", "en_US", "und", "", None, " ZH-cn ", "xx"]], "c string")
    assert [r[0] for r in df.select(G.code(df["c"])).collect()] == ["id", "id", "id", "jv", "en", None, None, None, "zh", "xx"]


@pytest.fixture(scope="module")
def tables(spark, tiny):
    import os

    d = tiny.replace("sf0.001", "sf0.01")
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in ("weak_labeled", "language_tags", "documents")]


def test_held_out_accuracy(tables):
    """Most tags are right, so a right detector agrees with most; texts of unmistakable scripts must all be right."""
    weak, tags, docs = tables
    out = G.labelled(weak, tags, docs).filter("n_segments = 1 AND tag IS NOT NULL").toPandas()
    assert (out["lang"] == out["tag"]).mean() > 0.86
    texts = dict(weak.select("row_id", "text").collect())
    for lang, lo, hi in (("th", 0xE00, 0xE7F), ("ru", 0x400, 0x4FF), ("ar", 0x600, 0x6FF)):
        for r in out.itertuples():
            t = texts[r.row_id]
            if sum(lo <= ord(c) <= hi for c in t) > 0.6 * sum(c.isalpha() for c in t):
                assert r.lang == lang


def test_passages_and_edges(spark, tables):
    _, _, docs = tables
    rows = [
        (1, "Rasane enak tenan, mung panggonane sumpek. Kenapa belum ada kedai kopi yang murah di dekat sini?", 0),
        (2, "It was the best, and I don't regret the choice. ร้านส้มตำอร่อยและราคาถูกจริงๆครับ", 0),
        (3, None, 0), (4, "", 0), (5, "12345 😍", 0), (6, "这里的豆花真的太香了！", 0), (6, "这里的豆花真的太香了！", 0),
    ]
    df = spark.createDataFrame(rows, "row_id long, text string, tag int")
    tags = spark.createDataFrame([(6, "zh", "2024-01-01 00:00:00"), (6, None, "2023-01-01 00:00:00"), (1, "jv", None)], "row_id long, lang string, tagged_at string").withColumn("x", tags_null())
    got = sorted((r["row_id"], r["seg_no"], r["lang"]) for r in G.found(df, tags, docs).collect())
    assert got == [(1, 1, "jv"), (1, 2, "id"), (2, 1, "en"), (2, 2, "th")]
    assert G.found(df.limit(0), tags.limit(0), docs.limit(0)).count() == 0


def test_texts_without_evidence_stay(spark, tables):
    texts = ["Qzxwv Xqzjk", "नमस्ते दुनिया", "ԱԲԳ", "ឃឃ", "ヸヹ 丟", "丟丣", "12345 😍", "https://a.example/xyz", "  "]
    detector = G.Detector(G.Filters())
    want = ["id", "id", "id", "id", "ja", "zh"]
    assert [[(G.LANGUAGES[x], c, n) for x, c, n in detector.passages(t)] for t in texts] == [[(w, 0.0, 1)] for w in want] + [[], [], []]
    assert G.LANGUAGES[detector.passages("Жжж ъъ")[0][0]] == "ru" and detector.passages("Qzxwv. Xqzjk qq. Zzz") == [(0, 0.0, 3)]
    _, tags, docs = tables
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = {r["row_id"]: (r["seg_no"], r["lang"]) for r in G.found(df, tags.limit(0), docs.limit(0)).collect()}
    assert set(got) == set(range(6)) and got[1] == (1, "id")


def tags_null():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_fit_sample_is_never_empty_however_many_documents(spark, monkeypatch):
    for n in (1, 1_600, 10**9, 1_600_000_001, 10**12, 10**17):
        assert 0 < G.share_of_hash(400, n) < 1 << 63
    docs = spark.createDataFrame([(i, "id", "x" * 30_000 + str(i)) for i in range(30)], "doc_id long, lang string, text string")
    got = G.fit_rows(docs, 5)
    assert len(got) == 5 and all(len(t) == G.FIT_CHARS for _, t in got)

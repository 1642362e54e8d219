"""Text, rules, rows, scores, places, entities, sources: hand-made cases, with nulls, ties and empty tables."""

import math
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloka.functions import text as T
from sparkloka.operators import entities, evaluation, learning, places, rows, rules, scoring
from sparkloka.sources import files, pages
from sparkloka.streaming import events as E


def one(spark, fn, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_and_normalize(spark):
    assert one(spark, T.clean_text, "Enak BGT 😍 http://a.b/c @müller #Kopi_Enak <b>x</b>!", None, "  ") == ["enak bgt kopi enak x !", "", ""]
    assert one(spark, T.normalize_text, "yg murmer bgt, gk ada . tp ok!") == ["yang murah meriah banget, gak ada tapi ok!"]


def test_slang_sets_one_mark_aside(spark):
    assert one(spark, T.normalize_text, "bgt!", "bgt!!", "!") == ["banget!", "bgt!!", ""]


def test_hashtags_offsets_pii_url(spark):
    assert one(spark, T.hashtags, "#A #b #a", None) == [["a", "b"], []]
    assert [(x["token"], x["start"], x["stop"]) for x in one(spark, T.offsets, "aa a, aa")[0]] == [("aa", 0, 2), ("a", 3, 4), (",", 4, 5), ("aa", 6, 8)]
    assert one(spark, T.redact, "nik 1234567890123456 hp 081234567890 x@y.co rekening 1234567890") == ["nik [NIK_REDACTED] hp [PHONE_REDACTED] [EMAIL_REDACTED] rekening [BANK_REDACTED]"]
    assert one(spark, T.canonical_url, " //M.Instagram.com/p/X/?a=1#b", "HTTP://www.A.b/", None, "a.b/c") == ["https://instagram.com/p/X", "http://www.a.b", "", "https://a.b/c"]
    assert one(spark, T.unix_to_iso, "1727740800", "0", "", None, "2024", "kemarin") == ["2024-10-01T00:00:00Z", "", "", "", "1970-01-01T00:33:44Z", "kemarin"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_stable_split_matches_hash(spark, texts):
    import hashlib

    want = ["train" if (v := int(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 100) < 80 else "validation" if v < 90 else "test" for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert one(spark, T.stable_split, *[t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]) == want if want else True


def labels(spark, *texts, context=None):
    df = spark.createDataFrame([(i, t, context) for i, t in enumerate(texts)], "i int, text string, query string")
    return [(r["label"], r["confidence"]) for r in rules.label(df, "text", "query").orderBy("i").collect()]


def test_rules(spark):
    assert labels(spark, "zonk", None, "", "tidak ada apa-apa") == [("COMPLAINT", 0.6), ("NEUTRAL", 0.0), ("NEUTRAL", 0.0), ("NEUTRAL", 0.0)]
    assert labels(spark, "enak banget, mantap, juara")[0] == ("DEMAND_PRESENT", 1.0)
    assert labels(spark, "enak banget tapi zonk")[0] == ("NEUTRAL", 0.0)  # each vetoes the other
    assert labels(spark, "penenakan bangetan")[0] == ("NEUTRAL", 0.0)  # inside words nothing counts
    assert labels(spark, "enak, banget")[0] == ("NEUTRAL", 0.0)  # a comma parts a keyword
    assert labels(spark, "x", context="butuh kopi")[0] == ("DEMAND_UNMET", 0.6)
    assert labels(spark, "di mana-mana ada")[0][0] == "COMPETITION_HIGH"


def test_keep_one_and_quota(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, None), (None, 4, 1)], "k string, id long, v int")
    assert sorted((r["k"] or "", r["id"]) for r in rows.keep_one(df, ["k"], [F.col("id")]).collect()) == [("", 4), ("a", 1), ("b", 3)]
    assert rows.keep_one(df.limit(0), ["k"], [F.col("id")]).count() == 0
    assert rows.top_per(df, "k", [F.col("id")], 1).count() == 3


def test_split_keeps_all_rows_and_shares(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 2, "rare").otherwise("common").alias("lab"))
    out = rows.hash_rank_split(df, "lab", "id")
    n = {(r["lab"], r["split"]): r["count"] for r in out.groupBy("lab", "split").count().collect()}
    assert n["rare", "train"] == 2 and sum(n.values()) == 2000
    assert abs(n["common", "train"] - 1399) <= 1 and abs(n["common", "validation"] - 300) <= 1


def test_donor_comes_from_validation_first(spark):
    df = spark.createDataFrame([(1, "a", "test"), (2, "a", "validation"), (3, "b", "train")], "id long, lab string, split string")
    assert sorted((r["id"], r["split"]) for r in rows.donate(df, "lab", "id").collect()) == [(1, "test"), (2, "train"), (3, "train")]


def test_scores_stay_in_bounds(spark):
    data = [("M", "L", "kopi", "DEMAND_UNMET", "2025-11-01T00:00:00Z")] * 3 + [("M", "K", "kopi", "COMPETITION_HIGH", "zzz")] * 3 + [("M", "S", "kopi", "WHAT", None)] * 3 + [(None, "S", "kopi", "TREND", None)] * 3 + [("M", "T", "mie", "TREND", None)] * 2
    df = spark.createDataFrame(data, "city string, area_hint string, business_hint string, final_signal string, timestamp string")
    poi = spark.createDataFrame([("M", "kopi", True)], "city string, business_hint string, is_franchise boolean")
    got = {r["area_hint"]: r for r in scoring.scores(df, poi, "2025-12-01 00:00:00").collect()}
    assert set(got) == {"L", "K", "S"}
    assert got["L"]["opportunity_score"] == pytest.approx((0.30 - 0.10 + 0.30) / 0.60, abs=1e-3) and got["K"]["opportunity_score"] == 0.0
    assert got["L"]["avg_decay_weight"] == pytest.approx(math.exp(-math.log(2)), abs=1e-3) and got["K"]["avg_decay_weight"] == 1.0
    assert scoring.scores(df.limit(0), None, "2025-12-01 00:00:00").count() == 0


def test_intent(spark):
    df = spark.createDataFrame([("saya ingin memulai bisnis kedai kopi di Malang",), ("mau buka laundry di Lowokwaru",), ("rekomendasi usaha dong",), (None,)], "q string")
    got = [(r["intent_city"], len(r["scope"]), r["intent_business"], r["fallback"]) for r in places.intent(df, "q").collect()]
    assert got == [("Malang", 5, "kedai kopi", False), ("Malang", 1, "laundry", False), ("Malang", 5, "kuliner", True), ("Malang", 5, "kuliner", True)]


POI = [(1, "Malang", "Klojen", "Warung Ayu", 1.0, 2.0, "gmaps_place"), (2, "Malang", "Klojen", "warung  ayu!", 3.0, 4.0, "gmaps_place"), (3, "Malang", None, "Warung Ayu", 9.0, 9.0, "overpass_poi"), (4, "Bandung", "Coblong", "Warung Ayu", 5.0, 6.0, "overpass_poi"), (5, "Bandung", "Coblong", "Kopi Tua", 7.0, 8.0, "overpass_poi"), (6, "Bandung", None, "!!!", 7.0, None, "overpass_poi")]
POI_COLS = "ord long, city string, area string, name string, lat double, lng double, source string"


def test_resolution(spark):
    cases = [
        ("butuh tempat nongkrong deket lowokwaru", None, None, ("Malang", "Lowokwaru", "text_proximity_pattern")),
        ("laundry di gubeng lagi rame", "", None, ("Surabaya", "Gubeng", "text_area_match")),  # three words follow "di"
        ("laundry di lowokwarru", "", None, ("Malang", "Lowokwaru", "text_fuzzy_match")),
        ("gubeng", "Malang", "Sukun", ("Surabaya", "Gubeng", "area_catalog")),  # not in the city, but a district
        ("Malang!", "Bandung", None, ("Malang", "", "city_catalog")), ("Warung Ayu", "Malang", "Sukun", ("Malang", "Sukun", "gmaps_place")), ("kopi tua", None, None, ("", "", "overpass_poi")),
        ("warung ayu", None, None, ("", "", "unresolved")),  # two cities have it
        ("apa saja", "Malang", "Klojen", ("Malang", "Klojen", "area_centroid")), ("apa saja", "Bandung", "Coblong", ("Bandung", "Coblong", "city_centroid")), ("x", "Malang", None, ("Malang", "", "city_centroid")),
        (None, "Malang", "Klojen", ("Malang", "Klojen", "unresolved")), (None, None, None, ("", "", "unresolved")), ("apa", "Jakarta", None, ("Jakarta", "", "unresolved")),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, text string, city string, lat string")
    out = places.resolve(df.withColumnRenamed("lat", "area"), "text", "city", "area", spark.createDataFrame(POI, POI_COLS)).orderBy("i").collect()
    assert [(r["resolved_city"], r["resolved_area"], r["source"]) for r in out] == [c[3] for c in cases]
    assert [(r["lat"], r["lng"]) for r in out[5:11]] == [(3.0, 4.0), (7.0, 8.0), (None, None), (2.0, 3.0), (19 / 3, 7.0), (13 / 3, 5.0)]
    assert places.resolve(df.limit(0), "text", "city", "lat").count() == 0


def test_close_districts_are_those_of_the_standard_library():
    from difflib import get_close_matches

    names = ["lowokwarru", "klojn", "gubeng", "bandung wtan", "semarang tenga", "candisary", "zzz", "sukunn", "wonokrmo", "kota gede", "", "gajah mungkur"]
    for n in names:
        for cut in (0.88, 0.9):
            assert places.close_area(n, cut)[:1] == get_close_matches(n, list(places._KEYS), n=1, cutoff=cut)


def test_choice_of_districts(spark):
    rows = spark.createDataFrame([(1, "apa saja", "Klojen"), (2, "enak di lowokwaru", "Gubeng"), (3, "apa saja", None), (4, "di gubeng", None), (5, "x", "Klojen")], "row_id long, text string, area_hint string")
    poi = spark.createDataFrame(POI, POI_COLS)
    at = lambda out: {r["row_id"]: (r["resolved_area"], r["source"], r["lat"]) for r in out.collect()}
    assert at(places.choose(rows, "Malang", ["Klojen", "Lowokwaru"], poi)) == {1: ("Klojen", "seed_area_hint", 2.0), 2: ("Lowokwaru", "text_proximity_pattern", 13 / 3), 5: ("Klojen", "seed_area_hint", 2.0)}
    named = spark.createDataFrame([(5, 0, "Gubeng"), (5, 1, "Lowokwaru"), (3, 0, "zzz")], "row_id long, pos int, entity string")
    assert at(places.choose(rows, "Malang", ["Klojen", "Lowokwaru"], poi, named))[5] == ("Lowokwaru", "area_catalog", 13 / 3)
    one = at(places.choose(rows, "Malang", ["Klojen"], poi))
    assert one[3] == ("Klojen", "query_scope_fallback", 2.0) and one[1][1] == "seed_area_hint" and 2 not in one


def test_gazetteer_places(spark):
    df = spark.createDataFrame([(1, "Kedai Kopi, kopi; xkopi kopi_"), (2, None), (3, "")], "id long, text string")
    got = sorted((r["start"], r["stop"], r["term"]) for r in places.gazetteer(df, "id", "text", [("kopi", "ORG"), ("kedai kopi", "ORG")]).collect())
    assert got == [(0, 10, "kedai kopi"), (6, 10, "kopi"), (12, 16, "kopi")]


def test_fuzzy(spark):
    df = spark.createDataFrame([(1, "enak di Lowokwarru nih"), (2, "Gubeng"), (3, "zzz"), (4, None)], "id long, name string")
    got = {(r["id"], r["window"]): (r["area"], r["ratio"]) for r in places.fuzzy_area(df, "id", "name").collect()}
    assert got == {(1, "lowokwarru"): ("Lowokwaru", round(SequenceMatcher(None, "lowokwaru", "lowokwarru").ratio(), 6)), (2, "gubeng"): ("Gubeng", 1.0)}


def test_bio(spark):
    df = spark.createDataFrame([(1, ["B-LOC", "I-LOC", "O", "I-PER", "B-PER", "B-PER", "I-LOC"]), (2, []), (3, ["O"])], "i int, tags array<string>")
    got = {r["i"]: [(x["type"], x["start"], x["stop"]) for x in r["s"]] for r in df.select("i", evaluation.spans(F.col("tags")).alias("s")).collect()}
    assert got == {1: [("LOC", 0, 2), ("PER", 4, 5), ("PER", 5, 6)], 2: [], 3: []}
    assert one(spark, entities.normalize_tag, "b-gpe", "I-COMPANY", "B-DATE", "", None, "B-XYZ") == ["B-LOC", "I-ORG", "O", "O", "O", "O"]


def test_spans_painted_and_decoded_again(spark):
    toks = spark.createDataFrame([(1, 0, "kedai", 0, 5), (1, 1, "kopi", 6, 10), (1, 2, "x", 11, 12)], "s long, pos long, token string, start long, stop long")
    sp = spark.createDataFrame([(1, 0, 10, "ORG"), (1, 6, 10, "ORG")], "s long, start long, stop long, label string")
    assert [r["tag"] for r in entities.paint(toks, sp, "s").orderBy("pos").collect()] == ["B-ORG", "B-ORG", "O"]


def test_spans_of_all_terms_are_painted(spark, tmp_path):
    from sparkloka.plans.registry import QUERIES

    rows = [(1, "Kopi di Bandung Wetan!", "Bandung", None), (2, "ke Warung Si-Ayu, tebet timur", "Malang", " Tebet Timur "), (3, "ke Warung Si-Ayu", "Bandung", "Sukun"), (4, None, "Malang", "Sukun"), (5, "", None, ""), (6, "xwarung si-ayu dan tebet timuran", "Malang", "Tebet Timur"), (7, "warung si-ayu", "Malang", "")]
    spark.createDataFrame(rows, "row_id long, text string, city string, area_hint string").write.parquet(f"{tmp_path}/signal_val.parquet")
    spark.createDataFrame([("Malang", "Warung Si-Ayu "), ("malang", "WARUNG SI-AYU"), ("Malang", "ke"), (None, "Kopi di"), ("Malang", None)], "city string, place_name string").write.parquet(f"{tmp_path}/documents.parquet")
    got: dict = {}
    for r in QUERIES["span_paint"](spark, str(tmp_path)).orderBy("row_id", "pos").collect():
        got.setdefault(r["row_id"], []).append(r["tag"])
    o, b, i, lb, li = "O", "B-ORG", "I-ORG", "B-LOC", "I-LOC"
    assert got == {1: [b, o, lb, li, o], 2: [o, b, i, i, i, o, lb, li], 3: [o] * 5, 6: [o] * 7, 7: [b, i, i, i]}


def test_report_zero_divisions(spark):
    r = {x["label"]: x for x in evaluation.class_report(spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "truth string, guess string"), ["a", "b", "c", "d"]).collect()}
    assert (r["a"]["prec"], r["a"]["recall"], r["a"]["f1"]) == (0.5, 0.5, 0.5) and r["b"]["f1"] == r["c"]["f1"] == r["d"]["f1"] == 0.0
    assert evaluation.class_report(spark.createDataFrame([], "truth string, guess string"), ["a"]).count() == 1


def test_classifier_learns(spark):
    data = [(i, "enak banget murah " + str(i % 7) if i % 2 else "mahal jelek kotor " + str(i % 5), "P" if i % 2 else "N") for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, text string, final_signal string")
    out = learning.predict(learning.fit(df.filter("row_id < 150")), df.filter("row_id >= 150"))
    assert out.filter("truth = guess").count() == 50


def test_self_training_filters_first_and_caps_then(spark):
    rows = [(i, 0, f"t{i:03}", "TREND", "TREND", 0.9, 0.5, 1.0) for i in range(130)]
    rows += [(200, 0, "a", "TREND", "COMPLAINT", 0.99, 0.9, 9.0), (201, 0, "b", "TREND", "TREND", 0.8399999, 0.5, 9.0), (202, 0, "c", "TREND", "TREND", 0.95, 0.07, 9.0), (203, 0, "d", "COMPLAINT", "COMPLAINT", 0.92, 0.15, 1.0), (204, 0, "e", "TREND", "TREND", 0.84, 0.08, 9.0)]
    df = spark.createDataFrame(rows, "row_id long, pos int, text string, hint string, guess string, confidence double, margin double, score double")
    kept = {r["row_id"]: r["rank_in_group"] for r in learning.agreed(df).collect()}
    assert set(kept) == {*range(100), 203} and kept[0] == 1  # 204 is sure enough but comes behind the cap
    assert {r["row_id"] for r in learning.agreed(df.filter("row_id >= 200")).collect()} == {203, 204}


def test_self_training_candidates(spark):
    pool = [(1, "warung ini zonk dan kami kecewa banget deh"), (2, "Warung ini zonk dan kami kecewa banget deh!"), (3, "kapan buka cabang di sini ya kak, butuh banget"), (4, "warung ini udah lama di jalan itu"), (5, None), (6, "this place is really zonk and bad"), (7, "tempat ini viral dan rame banget ya kak")]
    pool += [(100 + i, f"kopi nomor {i} ini viral banget dan enak untuk kami") for i in range(250)]
    known = spark.createDataFrame([("tempat ini viral, dan rame banget ya kak",), (None,)], "text string")
    got = learning.hinted(spark.createDataFrame(pool, "row_id long, text string").withColumn("source", F.when(F.col("row_id") >= 320, "tiktok_scrapling")), known).collect()
    by = {r["row_id"]: r["hint"] for r in got if r["row_id"] < 100}
    assert by == {1: "COMPLAINT", 3: "DEMAND_UNMET"}
    assert sum(r["hint"] == "TREND" for r in got) == 220  # the quota of the label
    assert {r["row_id"] for r in got} > set(range(320, 350))  # the better source comes first


def test_self_training_keeps_what_model_and_rules_agree_on(spark):
    data = [(i, f"tempat ini viral dan rame banget ya kak {i}" if i % 2 else f"makanan ini zonk dan kecewa untuk kami {i}", "TREND" if i % 2 else "COMPLAINT") for i in range(100)]
    train = spark.createDataFrame(data, "row_id long, text string, final_signal string")
    pool = spark.createDataFrame([(1, "yang viral dan rame banget ya kak"), (2, "makanan zonk dan kecewa untuk kami, tapi viral viral"), (3, "butuh makanan ini dan zonk untuk kami")], "row_id long, text string").withColumn("source", F.lit("x"))
    got = {r["row_id"]: r["label"] for r in learning.pseudolabels(train, pool, train).collect()}
    assert got.get(1) == "TREND" and 3 not in got  # 3: the rules and the model can't agree, for the model has no such label


def test_explanations_find_the_keyword(spark):
    df = spark.createDataFrame([(1, "tempat ini zonk sekali ya"), (2, None), (3, "")], "row_id long, text string")
    out = learning.explain(df).collect()
    assert {r["row_id"] for r in out} == {1} and max(out, key=lambda r: abs(r["weight"]))["token"] == "zonk"


def test_masked_texts_are_scored_by_the_model(spark):
    from pyspark.ml.feature import HashingTF

    words = ["ke", "", "a", "ab", "abc", "abcd", "kecewa!", "warung-makan", "éß", "日本"]
    assert [learning._bucket(w, 1 << 14) for w in words] == [HashingTF(numFeatures=1 << 14).indexOf(w) for w in words]
    data = [(i, f"ke warung {('enak murah', 'zonk kotor', 'viral rame')[i % 3]} x{i % 7}", "PNT"[i % 3]) for i in range(120)]
    for kinds in ("PNT", "PN"):
        df = spark.createDataFrame([r for r in data if r[2] in kinds], "row_id long, text string, final_signal string")
        model = learning.fit(df)
        text = "ke warung zonk zonk enak kotor x1"
        vocab = list(dict.fromkeys(text.split()))
        label, score = learning.ModelScorer(model).of(text.split(), vocab)
        masks = [[1] * len(vocab), [0, 1, 1, 0, 1, 1], [0, 0, 1, 1, 0, 1]]
        masked = [(i, " ".join(w for w in text.split() if m[vocab.index(w)]), label) for i, m in enumerate(masks)]
        asked = {r["row_id"]: r["confidence"] if r["guess"] == label else None for r in learning.predict(model, spark.createDataFrame(masked, "row_id long, text string, final_signal string")).collect()}
        assert label == "N" and [round(float(x), 6) for x in score(learning.np.array(masks, float))] == pytest.approx([asked[i] for i in range(3)], abs=2e-6)
        got = learning.explain(spark.createDataFrame([(1, text)], "row_id long, text string"), model).collect()
        assert len(got) == 3 and {"zonk", "kotor"} <= {r["token"] for r in got if r["weight"] > 0}


def test_rule_scores_of_words_are_the_rule_book(spark):
    texts = ["zonk", "gak worth it, mahal banget", "enak banget tapi zonk", "tempat ke pasar", "di mana-mana ada", "fyp viral", "pelayanan lama dan porsi kecil", "ga ada di sini, udah ada"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {r["i"]: (r["label"], r["score"]) for r in rules.label(df, "text").collect()}
    for i, t in enumerate(texts):
        scores = {n: rules.score_words(t.split(), n) for n in rules.RULES}
        best = max(scores, key=lambda n: (scores[n], rules.PRIORITY[n]))
        assert (best if scores[best] else "NEUTRAL", scores[best]) == want[i]


def test_explanations_of_phrases_vetoes_and_long_texts(spark):
    texts = [(1, "ke pasar untuk jalan"), (2, "warung mahal banget sekali"), (3, "ke " + " ".join(f"w{i}" for i in range(80)) + " zonk")]
    got = [(r["row_id"], r["label"], r["token"]) for r in learning.explain(spark.createDataFrame(texts, "row_id long, text string")).collect()]
    assert {r for r, _, _ in got} == {2, 3}  # no hit, no weights
    assert {"mahal", "banget"} <= {t for r, _, t in got if r == 2} and (3, "COMPLAINT", "zonk") in got


def test_missing_files_and_bad_cells(spark, tmp_path):
    assert files.read_csv(spark, f"{tmp_path}/none*.csv", ["a", "b"]).count() == 0
    (tmp_path / "x.csv").write_text('id,name\n"01","a ""b""\nc"\n2,\n')
    got = sorted((r["id"], r["name"]) for r in files.read_csv(spark, f"{tmp_path}/*.csv", ["id", "name"]).collect())
    assert got == [("01", 'a "b"\nc'), ("2", "")]
    assert [r["id"] for r in files.typed(files.read_csv(spark, f"{tmp_path}/*.csv", ["id", "name"]), id="int").orderBy("id").collect()] == [1, 2]


def test_place_elements_and_admin_keys(spark):
    js = '{"elements":[{"type":"node","id":1,"lat":1.5,"lon":2.5,"tags":{"name":"A"}},{"type":"way","id":2,"center":{"lat":3.0,"lon":4.0}},{"type":"way","id":3}]}'
    got = sorted((r["osm_id"], r["lat"], r["name"]) for r in files.flatten_elements(spark.createDataFrame([(js,), ("broken",), (None,)], "j string"), "j").collect())
    assert got == [(1, 1.5, "A"), (2, 3.0, None)]
    tr = '<tr class="table_content"><td>11</td><td>ACEH</td><td>01</td><td>R</td><td>010</td><td>D</td><td>001</td><td>V</td></tr>'
    got = sorted((r["id"], r["parent_id"], r["name"]) for r in files.administrative_keys(spark.createDataFrame([(tr + tr.replace("ACEH", "Aceh"),)], "h string"), "h").collect())
    assert got == [("11", None, "Aceh"), ("1101", "11", "R"), ("1101010", "1101", "D"), ("1101010001", "1101010", "V")]


def test_pages(spark):
    html = "<html><title>T &amp; U</title><meta property='og:description' content='enak &quot;sekali&quot;'><a href='//m.a.b/p/1?x=1#y'>1</a><a href=\"https://a.b/p/1/\">1</a><script type='application/json'>{\"a\":[{\"desc\":\"long enough\"},{\"b\":{\"desc\":\"the longest of them\"}}]}</script></html>"
    df = spark.createDataFrame([("https://a.b/@me/video/77", html), ("https://a.b/x", "please log in to continue"), ("https://a.b/y", "")], "url string, html string")
    got = {r["url"]: r for r in pages.records(df).collect()}
    r = got["https://a.b/@me/video/77"]
    assert (r["text"], r["author"], r["item_id"], r["title"], r["blocked"]) == ('enak "sekali"', "me", "77", "T & U", None)
    assert got["https://a.b/x"]["blocked"] == "challenge" and got["https://a.b/y"]["blocked"] == "no_text"
    assert [x["target"] for x in pages.links(df, "url", "html", "^https://[^/]+/p/").collect()] == ["https://a.b/p/1"]
    assert [x["desc"] for x in pages.longest_description(df).collect()] == ["the longest of them"]


def test_model_replies(spark):
    labels = ["TREND", "COMPLAINT"]
    got = one(spark, lambda c: pages.reply_label(c, labels), '{"label":"trend","confidence":0.9}', "```json\n{'label': 'COMPLAINT', 'confidence': 0.7}\n```", "I say COMPLAINT", "nothing", None)
    assert [(x["label"], x["confidence"]) if x else None for x in got] == [("TREND", 0.9), ("COMPLAINT", 0.7), ("COMPLAINT", 0.5), None, None]


def test_append_mode_withholds_the_open_window(spark, tiny):
    done = E.run(E.tumbling(E.read(spark, tiny)).select("window.start", "event_type", "n"), "append")
    assert 0 < done.count() < spark.read.parquet(f"{tiny}/events.parquet").select(F.to_date("ts"), "event_type").distinct().count()


def test_two_keys_in_order(spark):
    import random

    rng = random.Random(2)
    data = [(i, rng.choice(["", None, *"abcdefghij"]), rng.choice(["", None, *"uvwxyz"])) for i in range(120)] + [(200 + i, f"k{(i + 1) // 2}", f"l{i // 2}") for i in range(12)]
    a, b, want = set(), set(), []
    for i, x, y in data:
        if not ((x and x in a) or (y and y in b)):
            want.append(i)
            a |= {x} if x else set()
            b |= {y} if y else set()
    df = spark.createDataFrame(data, "i long, x string, y string")
    assert sorted(r["i"] for r in rows.fold_two_keys(df, "i", "x", "y").collect()) == want
    assert rows.fold_two_keys(df.limit(0), "i", "x", "y").count() == 0


def test_streams_go_on_where_they_ended(spark, tmp_path):
    import glob
    import os
    import uuid

    name, src = f"test-{uuid.uuid4().hex}", f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema("id long, v string").json(src)
    add = lambda lo, hi: spark.range(lo, hi).select("id", F.when(F.col("id") % 5 > 0, "x").alias("v")).coalesce(1).write.mode("append").json(src)
    add(0, 10)
    one = E.collect(stream(), "append", name, F.col("v").isNotNull())
    assert one.finished and one.rows.count() == 8 and one.rejected.count() == 2
    add(10, 20)
    two = E.collect(stream(), "append", name, F.col("v").isNotNull(), seconds=120)
    assert sorted(r["id"] for r in two.rows.collect()) == [i for i in range(20) if i % 5] and two.rejected.count() == 4
    from sparkloka.runtime import shared_dir

    state = f"{shared_dir(spark).removeprefix('file://')}/sparkloka/streams/{name}/state/commits"
    last = max((f for f in os.listdir(state) if f.isdigit()), key=int)
    for f in glob.glob(f"{state}/*{last}*") + glob.glob(f"{state}/.{last}*"):
        os.remove(f)  # as if the run had broken off before it was told done
    assert E.collect(stream(), "append", name, F.col("v").isNotNull()).rows.count() == 16


def test_streamed_dedupe_with_bounded_state(spark, tiny):
    out = E.run(E.dedupe(E.read(spark, tiny), ["user_id", "event_type"], "2 days"), "append")
    assert out.count() > 0 and out.columns == ["user_id", "event_type", "ts"]


def test_prompts_end_at_words(spark):
    from sparkloka.operators import pool

    assert one(spark, lambda c: pool.prompt(c, 10), "abc defgh ijk", "abcdefghijklm", " ab ", None, "abcdefghij k") == ["abc defgh", "abcdefghij", "ab", None, "abcdefghij"]

"""The whole way from a question to scores, with injected rows and labels."""

import json

from pyspark.sql import functions as F

from sparkloka.plans.analyze import analyze

COLS = "row_id long, text string, query string, city string, area_hint string, business_hint string, timestamp string"
LABELS = ["DEMAND_UNMET", "DEMAND_PRESENT", "COMPLAINT", "TREND"]


def rows(spark, city, areas, n=12):
    return spark.createDataFrame([(i * 100 + k, f"kopi enak nomor {k}", "kedai kopi", city, a, "kedai kopi", "2025-11-01T00:00:00Z") for i, a in enumerate(areas) for k in range(n)], COLS)


def cycle(df):
    return df.withColumn("label", F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod("row_id", F.lit(4)) + 1).cast("int")))


def test_scores_three_districts(spark):
    corpus = rows(spark, "Malang", ["Lowokwaru", "Klojen", "Blimbing"])
    r = analyze(spark, "saya ingin memulai bisnis kedai kopi di Malang", corpus, "2025-12-01 00:00:00", scorer=cycle)
    assert r["error"] == "" and len(r["scores"]) == 3 and sum(x["total_signals"] for x in r["scores"]) == 36
    assert len(json.loads(r["map"])["features"]) == 3 and "Malang" in r["explanation"]


def test_single_scope_collector_and_failure(spark):
    one = analyze(spark, "mau buka laundry di Gubeng", rows(spark, "Surabaya", ["Gubeng"]), "2025-12-01 00:00:00", scorer=cycle, least_rows=10)
    assert one["error"] == "" and [x["area_hint"] for x in one["scores"]] == ["Gubeng"]
    asked = []
    r = analyze(spark, "kopi di Malang", rows(spark, "Malang", []), "2025-12-01 00:00:00", collector=lambda s, i: asked.append(i["city"]) or rows(s, "Malang", ["Klojen"], 5))
    assert asked == ["Malang"] and "needed" in r["error"] and r["scores"] == []


def test_callbacks_and_artifacts(spark, tmp_path):
    from sparkloka.plans.analyze import per_worker

    corpus = rows(spark, "Malang", ["Lowokwaru", "Klojen", "Blimbing"])
    scorer = per_worker(lambda: ["DEMAND_UNMET", "TREND"], lambda m, texts: [(m[len(t) % 2], 0.9) for t in texts])
    tagger = lambda df: df.filter("row_id < 4").select("row_id", F.lit(0).alias("pos"), F.lit("Sukun").alias("entity"))
    explainer = lambda df: df.select("row_id", F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(w).alias("weight")) for t, w in (("kopi", 0.25), ("enak", -0.5))])).alias("x")).select("row_id", F.lit("TREND").alias("label"), "x.*")
    points = spark.createDataFrame([(1, "Malang", "Klojen", "A", -7.0, 112.0, "gmaps_place")], "ord long, city string, area string, name string, lat double, lng double, source string")
    r = analyze(spark, "mau buka kedai kopi di Malang", corpus, "2025-12-01 00:00:00", scorer=scorer, tagger=tagger, explainer=explainer, points=points, out_dir=f"file://{tmp_path}")
    assert r["error"] == "" and {x["area_hint"]: x["total_signals"] for x in r["scores"]} == {"Lowokwaru": 8, "Klojen": 12, "Blimbing": 12, "Sukun": 4}
    assert r["explanation"].startswith("=== Analisis Peluang Bisnis: kedai kopi di Malang ===\nData dianalisis secara offline (airgap) dari 36 sinyal pada 4 kecamatan.")
    assert r["explanation"].count("Sinyal kata utama: enak (-0.500), kopi (+0.250).") == 4 and r["explanation"].count("Rekomendasi: ") == 4
    at = tmp_path / r["run"]
    assert json.loads((at / "result.json").read_text())["scores"] == r["scores"] and (at / "map.html").read_text().count("<circle") == 4
    assert spark.read.option("header", True).csv(f"file://{at}/scores").count() == 4 and spark.read.option("header", True).csv(f"file://{at}/rows").count() == 36

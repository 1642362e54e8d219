"""Time-decayed opportunity scores by city, district and business.

Defined results: null group keys are dropped; unreadable times count as age 0; unknown labels weigh only in the
denominator; groups under three rows are left out; a business without points of interest has no penalty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloka.constants import ADVICE, BRANDS, GREEN, HALF_LIFE_DAYS, MAX_RAW, MIN_RAW, PENALTY, SIGNAL_NAMES, STATUS_NAMES, WEIGHTS, YELLOW

GROUP = ["city", "area_hint", "business_hint"]


def age_days(ts: Column, as_of: str) -> Column:
    """Days from a time string (ISO, UTC where it has no zone) to ``as_of``; 0 for later and unreadable times."""
    us = F.unix_micros(F.try_to_timestamp(ts))
    return F.coalesce(F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - us) / 8.64e10, F.lit(0.0)), F.lit(0.0))


def decay(age: Column) -> Column:
    return F.exp(-math.log(2) / HALF_LIFE_DAYS * age)


def weight(label: Column) -> Column:
    w = F.lit(0.0)
    for name, x in WEIGHTS.items():
        if x:
            w = F.when(label == name, x).otherwise(w)
    return w


def is_franchise(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(b.replace(".", r"\.") for b in BRANDS)), F.lit(False))


def scores(signals: DataFrame, poi: DataFrame | None, as_of: str, label: str = "final_signal", least: int = 3) -> DataFrame:
    """One row a group. ``poi`` has (city, business_hint, is_franchise) and is reduced to one row a key before the join."""
    rows = signals.dropna(subset=GROUP).select(*GROUP, F.col(label).alias("label"), age_days(F.col("timestamp"), as_of).alias("age"))
    rows = rows.withColumn("d", decay(F.col("age")))
    g = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("total_signals"), F.sum("d").alias("sd"), F.sum(F.col("d") * weight(F.col("label"))).alias("sw"), F.avg("age").alias("avg_age"), F.avg("d").alias("avg_decay")).filter(F.col("total_signals") >= least)
    if poi is None:
        g = g.withColumn("ratio", F.lit(0.0))
    else:
        per = poi.groupBy("city", "business_hint").agg(F.avg(F.col("is_franchise").cast("double")).alias("ratio"))
        g = g.join(per, ["city", "business_hint"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    raw = F.col("sw") / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    after = raw - PENALTY * F.col("ratio")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (after - MIN_RAW) / (MAX_RAW - MIN_RAW)))
    return g.select(
        *GROUP, "total_signals", F.round(score, 3).alias("opportunity_score"),
        F.when(score >= GREEN, "green").when(score >= YELLOW, "yellow").otherwise("red").alias("color"),
        F.when(score >= GREEN, "Strong Opportunity").when(score >= YELLOW, "Moderate Opportunity").otherwise("Saturated / Risky").alias("label"),
        F.round(raw, 4).alias("raw_signal_score"), F.round(after, 4).alias("raw_score_after_penalty"), F.round("ratio", 3).alias("franchise_ratio"),
        F.round("avg_age", 2).alias("avg_age_days"), F.round("avg_decay", 4).alias("avg_decay_weight"),
    )


def breakdown(signals: DataFrame, label: str = "final_signal") -> DataFrame:
    """(group, label, n, dominant): counts by label, and whether it is the group's commonest (ties: by name)."""
    n = signals.dropna(subset=[*GROUP, label]).groupBy(*GROUP, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*GROUP).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top"))
    return n.join(top, GROUP).select(*GROUP, "label", "n", (F.col("label") == F.col("top")).alias("dominant"))


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def _hundredths(c: Column) -> Column:
    """A number of three digits with two, halves up."""
    n = F.floor((F.round(c * 1000).cast("long") + 5) / 10).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def stories(scored: DataFrame, parts: DataFrame, words: DataFrame | None = None, top: int = 5, mode: str = "offline (airgap)") -> DataFrame:
    """(city, business_hint, story, signals, areas): for each business and city what is told of its best districts.

    ``scored`` as of ``scores``, ``parts`` as of ``breakdown``; ``words`` has (group, words) to be named as main words.
    Districts of equal score come by name; a district without labels counts as NEUTRAL with 0."""
    key = scored.withColumn("__k", F.concat_ws("\u0001", "city", "business_hint"))
    best = key.withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(F.desc("opportunity_score"), "area_hint"))).filter(F.col("__r") <= top).drop("__k")
    best = best.join(parts.filter("dominant").select(*GROUP, F.col("label").alias("__label"), "n"), GROUP, "left")
    best = best.join(words, GROUP, "left") if words is not None else best.withColumn("words", F.lit(None).cast("string"))
    label = F.coalesce("__label", F.lit("NEUTRAL"))
    advice = F.replace(_named(label, ADVICE), F.lit("{business}"), F.col("business_hint"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.col("area_hint"), F.lit(" - skor "), _hundredths(F.col("opportunity_score")), F.lit(" - "), _named(F.col("label"), STATUS_NAMES)),
        F.concat(F.lit("  Total sinyal: "), F.col("total_signals").cast("string"), F.lit(". Dominan: "), _named(label, SIGNAL_NAMES), F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(".0).")),
        F.concat(F.lit("  Rekomendasi: "), advice),
        F.when(F.col("franchise_ratio") > 0, F.concat(F.lit("  Rasio waralaba terpantau: "), _hundredths(F.col("franchise_ratio")), F.lit("."))),
        F.concat(F.lit("  Sinyal kata utama: "), F.col("words"), F.lit(".")),
    )
    told = best.groupBy("city", "business_hint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", lines.alias("l")))), lambda x: x["l"]), "\n\n").alias("body"), F.sum("total_signals").alias("signals"), F.count(F.lit(1)).alias("areas"))
    head = F.concat(F.lit("=== Analisis Peluang Bisnis: "), "business_hint", F.lit(" di "), "city", F.lit(f" ===\nData dianalisis secara {mode} dari "), F.col("signals").cast("string"), F.lit(" sinyal pada "), F.col("areas").cast("string"), F.lit(" kecamatan.\n\n"))
    return told.select("city", "business_hint", F.concat(head, "body").alias("story"), "signals", "areas")


def popup(c: str = "label") -> Column:
    """A marker's text as HTML; ``scores`` columns and the dominant label."""
    esc = lambda x: F.replace(F.replace(F.replace(F.col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(
        F.lit("<b>"), esc("area_hint"), F.lit("</b><br>"), esc("business_hint"), F.lit("<br>Skor: "), F.format_string("%.3f", "opportunity_score"), F.lit("<br>Status: "), _named(F.col(c), STATUS_NAMES),
        F.lit("<br>Sinyal: "), F.col("total_signals").cast("string"), F.lit("<br>Rasio waralaba: "), F.format_string("%.3f", "franchise_ratio"),
    )

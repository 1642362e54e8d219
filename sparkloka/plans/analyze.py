"""From a question to scored districts: one plan up to the aggregate, then a small result on the driver.

Models and collectors come as callbacks from frame to frame: ``scorer`` adds labels, ``tagger`` names entities,
``explainer`` weighs words, ``collector`` gives rows for an intent. ``per_worker`` makes such a callback from a model that
is loaded once a worker."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloka.constants import CITY_POINTS
from sparkloka.operators import places, rules, scoring
from sparkloka.runtime import stage
from sparkloka.sources import files

Collector = Callable[[SparkSession, dict[str, Any]], DataFrame]
Scorer = Callable[[DataFrame], DataFrame]
Tagger = Callable[[DataFrame], DataFrame]
Explainer = Callable[[DataFrame], DataFrame]

#: Rows that a question looks at most, and how many it needs: the feature is a top-k retrieval.
TOP_K, LEAST_ROWS = 180, 30
#: Models by callback, once loaded in this worker.
_loaded: dict[str, Any] = {}


def _label(rows: DataFrame) -> DataFrame:
    return rules.label(rows, "text", "query")


def per_worker(load: Callable[[], Any], predict: Callable[[Any, list[str]], list[tuple[str, float]]], text: str = "text") -> Scorer:
    """A scorer from a model: ``load`` is called once in each worker process, ``predict`` gives (label, confidence) for a
    batch of texts. Null texts are given as ''."""
    name = uuid.uuid4().hex

    @F.pandas_udf("label string, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = load()
        for batch in batches:
            yield pd.DataFrame(predict(_loaded[name], [t or "" for t in batch]), columns=["label", "confidence"])

    return lambda rows: rows.withColumn("__p", run.asNondeterministic()(F.col(text))).withColumns({"label": F.col("__p.label"), "confidence": F.col("__p.confidence")}).drop("__p")


def _main_words(rows: DataFrame, explainer: Explainer) -> DataFrame:
    """(group, words): the words that move the label of the surest row of each district most."""
    sure = F.col("confidence") if "confidence" in rows.columns else F.lit(0.0)
    one = rows.groupBy(*scoring.GROUP).agg(F.min_by(F.struct("row_id", "text"), F.struct(-sure, F.col("row_id"))).alias("x")).select(*scoring.GROUP, "x.*")
    w = explainer(one.select("row_id", "text")).select("row_id", "token", "weight").groupBy("row_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("o"), "token", "weight"))), 1, 3).alias("w"))
    told = F.array_join(F.transform("w", lambda x: F.concat(x["token"], F.lit(" ("), F.format_string("%+.3f", x["weight"]), F.lit(")"))), ", ")
    return one.join(w, "row_id").select(*scoring.GROUP, told.alias("words"))


def analyze(
    spark: SparkSession, query: str, corpus: DataFrame, as_of: str, collector: Collector | None = None, scorer: Scorer = _label, poi: DataFrame | None = None, least_rows: int = LEAST_ROWS,
    points: DataFrame | None = None, tagger: Tagger | None = None, explainer: Explainer | None = None, out_dir: str | None = None,
) -> dict[str, Any]:
    """Intent, scores by district, their explanation and a GeoJSON of markers; problems are told in ``error``.

    ``corpus`` has row_id, text, query, city, area_hint, business_hint, timestamp. Rows that resolve outside the asked
    districts are left out. ``poi`` (city, business_hint, is_franchise) gives the penalty for chains, ``points`` (see
    ``places.points_of``) where things lie. With ``out_dir`` the labelled rows, scores, result and map are written there
    under an id of the run."""
    found = places.intent(spark.createDataFrame([(query,)], "q string"), "q").first()
    intent = {"city": found["intent_city"], "scope": list(found["scope"]), "business": found["intent_business"], "fallback": found["fallback"], "query": query}
    mode = "live publik" if collector else "offline (airgap)"
    out: dict[str, Any] = {"intent": intent, "mode": mode, "scores": [], "explanation": "", "map": None, "error": "", "run": None}
    rows = collector(spark, intent) if collector else corpus
    ranked = places.relevance(rows, intent["city"], intent["scope"], intent["business"], query).orderBy(F.desc("relevance"), F.desc_nulls_last("timestamp"), "row_id").limit(TOP_K)
    scored = scorer(ranked)
    placed = places.choose(scored, intent["city"], intent["scope"], points, tagger(ranked) if tagger else None)
    more = [c for c in ("confidence",) if c in placed.columns]
    signals = placed.select("row_id", "text", F.col("resolved_city").alias("city"), F.col("resolved_area").alias("area_hint"), F.lit(intent["business"]).alias("business_hint"), F.col("label").alias("final_signal"), *more, "timestamp", "lat", "lng", "source")
    signals = stage(signals, "analyze")  # at most TOP_K rows
    n = signals.count()
    if n < least_rows:
        out["error"] = f"{n} usable rows; {least_rows} are needed"
        return out
    scores = scoring.scores(signals, poi, as_of)
    listed = [r.asDict() for r in scores.orderBy(F.desc("opportunity_score"), "area_hint").collect()]  # at most the scope's districts
    least_areas = 1 if len(intent["scope"]) == 1 else 3
    if len(listed) < least_areas:
        out["error"] = f"{len(listed)} districts scored; {least_areas} are needed"
        return out
    told = scoring.stories(scores, scoring.breakdown(signals), _main_words(signals, explainer) if explainer else None, mode=mode).first()
    out |= {"scores": listed, "explanation": told["story"] if told else "", "map": geojson(spark, listed)}
    if out_dir:
        out["run"] = uuid.uuid4().hex
        at = f"{out_dir.rstrip('/')}/{out['run']}"
        files.write_csv(signals, f"{at}/rows", signals.columns)
        files.write_csv(scores, f"{at}/scores", scores.columns)
        files.write_document(spark, f"{at}/result.json", json.dumps(out, ensure_ascii=False, indent=2))
        files.write_document(spark, f"{at}/map.html", map_page(out["map"], intent))
    return out


def map_page(features: str, intent: dict[str, Any]) -> str:
    """A page with one marker a district, drawn to scale, its text on pointing at it; needs no network."""
    marks, size = json.loads(features)["features"], 640
    xs, ys = ([m["geometry"]["coordinates"][i] for m in marks] or [0.0] for i in (0, 1))
    place = lambda v, every: 60 + (v - min(every)) / ((max(every) - min(every)) or 1) * (size - 120)
    dots = "".join(
        f'<circle cx="{place(m["geometry"]["coordinates"][0], xs):.1f}" cy="{size - place(m["geometry"]["coordinates"][1], ys):.1f}" r="14" fill="{m["properties"]["color"]}" opacity="0.8"><title>{html.escape(str(m["properties"]["area_hint"]))}: {m["properties"]["opportunity_score"]:.3f}, {html.escape(m["properties"]["label"])}</title></circle>'
        for m in marks
    )
    title = html.escape(f"{intent['business']} - {intent['city']}")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><svg width="{size}" height="{size}">{dots}</svg><script type="application/geo+json">{features.replace("</", "<" + chr(92) + "/")}</script></body></html>'


def geojson(spark: SparkSession, scores: list[dict[str, Any]]) -> str:
    """Markers of the scored districts, shifted from their city's point by the district's hash."""
    from hashlib import md5

    features = []
    for r in scores:
        if r["city"] not in CITY_POINTS:
            continue
        h = md5(r["area_hint"].encode()).hexdigest()
        lat, lng = (p + (int(h[i : i + 4], 16) / 65535 - 0.5) * 0.05 for p, i in zip(CITY_POINTS[r["city"]], (0, 4)))
        features.append({"type": "Feature", "geometry": {"type": "Point", "coordinates": [lng, lat]}, "properties": {k: r[k] for k in ("area_hint", "opportunity_score", "color", "label")}})
    return json.dumps({"type": "FeatureCollection", "features": features})



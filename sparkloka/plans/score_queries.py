"""Scores, their parts, and what is told about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloka.constants import ADVICE, BRANDS, CITIES, CITY_POINTS, SIGNAL_NAMES, STATUS_NAMES
from sparkloka.functions.text import jitter
from sparkloka.operators import scoring
from sparkloka.plans.registry import query
from sparkloka.runtime import table

AS_OF = "2025-12-01 00:00:00"
_AGE = f"coalesce(greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(try_cast(replace(replace(timestamp, 'T', ' '), 'Z', '') AS TIMESTAMP))) / 8.64e10, 0), 0)"
_D = f"exp(-ln(2) / 30 * {_AGE})"
_W = "CASE final_signal WHEN 'DEMAND_UNMET' THEN 0.30 WHEN 'DEMAND_PRESENT' THEN 0.15 WHEN 'TREND' THEN 0.10 WHEN 'COMPETITION_HIGH' THEN -0.20 WHEN 'COMPLAINT' THEN -0.10 WHEN 'SUPPLY_SIGNAL' THEN -0.05 ELSE 0 END"
_G = "city, area_hint, business_hint"
_NN = "city IS NOT NULL AND area_hint IS NOT NULL AND business_hint IS NOT NULL"
_ISF = "regexp_matches(lower(place_name), '" + "|".join(["depot", "café"]) + "')"
_POI = f"SELECT city, business_hint, avg(CASE WHEN {_ISF} THEN 1.0 ELSE 0.0 END) AS ratio FROM (SELECT DISTINCT city, business_hint, place_name FROM documents WHERE place_name IS NOT NULL) GROUP BY 1, 2"
_SCORE = f"""
WITH g AS (SELECT {_G}, count(*) AS total_signals, sum({_D}) AS sd, sum({_D} * {_W}) AS sw, avg({_AGE}) AS avg_age, avg({_D}) AS avg_decay FROM signal_train WHERE {_NN} GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT g.*, coalesce(p.ratio, 0) AS ratio, sw / CASE WHEN sd = 0 THEN 1 ELSE sd END AS raw FROM g LEFT JOIN ({_POI}) p USING (city, business_hint)),
z AS (SELECT *, raw - 0.10 * ratio AS after, greatest(0, least(1, (raw - 0.10 * ratio + 0.30) / 0.60)) AS score FROM r)
SELECT {_G}, total_signals, round(score, 3) AS opportunity_score, CASE WHEN score >= 0.65 THEN 'green' WHEN score >= 0.40 THEN 'yellow' ELSE 'red' END AS color,
CASE WHEN score >= 0.65 THEN 'Strong Opportunity' WHEN score >= 0.40 THEN 'Moderate Opportunity' ELSE 'Saturated / Risky' END AS label,
round(raw, 4) AS raw_signal_score, round(after, 4) AS raw_score_after_penalty, round(ratio, 3) AS franchise_ratio, round(avg_age, 2) AS avg_age_days, round(avg_decay, 4) AS avg_decay_weight FROM z
"""


def places(s, d):
    """Points of interest: distinct places of the documents, with a flag for two name types that stand in for chains."""
    p = table(s, d, "documents").filter("place_name IS NOT NULL").select("city", "business_hint", "place_name").distinct()
    return p.withColumn("is_franchise", F.lower("place_name").rlike("depot|café"))


@query("opportunity_score", _SCORE)
def opportunity_score(s, d):
    return scoring.scores(table(s, d, "signal_train"), places(s, d), AS_OF)


@query("signal_breakdown", f"SELECT {_G}, final_signal AS label, n, (row_number() OVER (PARTITION BY {_G} ORDER BY n DESC, final_signal) = 1) AS dominant FROM (SELECT {_G}, final_signal, count(*) AS n FROM signal_train WHERE {_NN} AND final_signal IS NOT NULL GROUP BY ALL)")
def signal_breakdown(s, d):
    return scoring.breakdown(table(s, d, "signal_train"))


@query("decay_stats", f"SELECT final_signal, count(*) AS n, round(avg({_AGE}), 4) AS avg_age, round(avg({_D}), 6) AS avg_weight FROM signal_train GROUP BY 1")
def decay_stats(s, d):
    age = scoring.age_days(F.col("timestamp"), AS_OF)
    return table(s, d, "signal_train").select("final_signal", age.alias("age")).groupBy("final_signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 4).alias("avg_age"), F.round(F.avg(scoring.decay(F.col("age"))), 6).alias("avg_weight"))


@query("franchise_names", "SELECT p_partkey, p_name, regexp_matches(lower(p_name), '" + "|".join(b.replace(".", r"\.") for b in BRANDS) + "') AS is_franchise FROM part")
def franchise_names(s, d):
    return table(s, d, "part").select("p_partkey", "p_name", scoring.is_franchise(F.col("p_name")).alias("is_franchise"))


_TOP = f"SELECT * FROM ({_SCORE}) QUALIFY row_number() OVER (ORDER BY opportunity_score DESC, {_G}) <= 5"


@query("top_areas", _TOP)
def top_areas(s, d):
    """The five best areas: a top-k report."""
    return opportunity_score(s, d).orderBy(F.desc("opportunity_score"), "city", "area_hint", "business_hint").limit(5)


@query("area_sample", "SELECT city, area_hint, row_id FROM weak_labeled WHERE city IS NOT NULL AND area_hint IS NOT NULL AND confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city, area_hint ORDER BY confidence DESC, row_id) = 1")
def area_sample(s, d):
    """The most confident record of each area."""
    t = table(s, d, "weak_labeled").filter("city IS NOT NULL AND area_hint IS NOT NULL AND confidence IS NOT NULL")
    return t.groupBy("city", "area_hint").agg(F.min_by("row_id", F.struct(-F.col("confidence"), F.col("row_id"))).alias("row_id"))


def _case(col: str, values: dict[str, str], other: str | None = None) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + f" ELSE {other or col} END"


_HUND = lambda c: f"(((round({c} * 1000)::BIGINT + 5) // 10) // 100)::VARCHAR || '.' || lpad((((round({c} * 1000)::BIGINT + 5) // 10) % 100)::VARCHAR, 2, '0')"
_DOM = f"SELECT {_G}, final_signal AS dom, n FROM (SELECT {_G}, final_signal, count(*) AS n FROM signal_train WHERE {_NN} AND final_signal IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY n DESC, final_signal) = 1"
_STORY = f"""
WITH r AS (SELECT s.*, coalesce(dom, 'NEUTRAL') AS dom, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY s.city, s.business_hint ORDER BY opportunity_score DESC, s.area_hint) AS k FROM ({_SCORE}) s LEFT JOIN ({_DOM}) d ON s.city = d.city AND s.area_hint = d.area_hint AND s.business_hint = d.business_hint),
t AS (SELECT city, business_hint, k, total_signals, area_hint || ' - skor ' || {_HUND('opportunity_score')} || ' - ' || {_case('label', STATUS_NAMES)} || chr(10) || '  Total sinyal: ' || total_signals || '. Dominan: ' || {_case('dom', SIGNAL_NAMES)} || ' (' || n || '.0).' || chr(10) || '  Rekomendasi: ' || replace({_case('dom', ADVICE)}, '{{business}}', business_hint) || CASE WHEN franchise_ratio > 0 THEN chr(10) || '  Rasio waralaba terpantau: ' || {_HUND('franchise_ratio')} || '.' ELSE '' END AS line FROM r WHERE k <= 5)
SELECT city, business_hint, '=== Analisis Peluang Bisnis: ' || business_hint || ' di ' || city || ' ===' || chr(10) || 'Data dianalisis secara offline (airgap) dari ' || sum(total_signals)::BIGINT || ' sinyal pada ' || count(*) || ' kecamatan.' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY k) AS story, sum(total_signals)::BIGINT AS signals, count(*) AS areas FROM t GROUP BY 1, 2
"""


@query("explain_text", _STORY)
def explain_text(s, d):
    """For each business and city what is told of its five best districts: rating, main signal, advice, chains."""
    return scoring.stories(opportunity_score(s, d), signal_breakdown(s, d))


_ESC = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("popup_html", f"SELECT {_G}, '<b>' || {_ESC('area_hint')} || '</b><br>' || {_ESC('business_hint')} || '<br>Skor: ' || printf('%.3f', opportunity_score) || '<br>Status: ' || {_case('label', STATUS_NAMES)} || '<br>Sinyal: ' || total_signals || '<br>Rasio waralaba: ' || printf('%.3f', franchise_ratio) AS popup FROM ({_SCORE})")
def popup_html(s, d):
    return opportunity_score(s, d).select("city", "area_hint", "business_hint", scoring.popup().alias("popup"))


_PTS = ", ".join(f"('{c}', {a}, {b})" for c, (a, b) in CITY_POINTS.items())


@query("jitter_points", f"SELECT area, round(lat + (('0x' || substr(md5(area), 1, 4))::BIGINT / 65535.0 - 0.5) * 0.05, 9) AS lat, round(lng + (('0x' || substr(md5(area), 5, 4))::BIGINT / 65535.0 - 0.5) * 0.05, 9) AS lng FROM (SELECT DISTINCT city, area_hint AS area FROM signal_train WHERE area_hint IS NOT NULL) JOIN (VALUES {_PTS}) AS p(city, lat, lng) USING (city)")
def jitter_points(s, d):
    """Marker places of the areas: the city's point, shifted by the area's hash."""
    pts = s.createDataFrame([(c, a, b) for c, (a, b) in CITY_POINTS.items()], "city string, lat double, lng double")
    areas = table(s, d, "signal_train").filter("area_hint IS NOT NULL").select("city", F.col("area_hint").alias("area")).distinct()
    return areas.join(F.broadcast(pts), "city").select("area", F.round(F.col("lat") + jitter(F.col("area"), 1), 9).alias("lat"), F.round(F.col("lng") + jitter(F.col("area"), 5), 9).alias("lng"))


assert set(CITY_POINTS) == set(CITIES)

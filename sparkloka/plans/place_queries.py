"""Intent, retrieval, places and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloka.constants import ALIASES, BUSINESSES, CITIES, CITY_POINTS, PROXIMITY, TEMPLATES
from sparkloka.functions import text as T
from sparkloka.operators import places
from sparkloka.operators.places import ALIAS_ORDER, AREAS, BUSINESS_ORDER
from sparkloka.plans import sql_text as S
from sparkloka.plans.corpus_queries import _CORPUS, corpus
from sparkloka.plans.registry import query
from sparkloka.runtime import table


def _case(options) -> str:
    return "CASE " + " ".join(f"WHEN contains(n, '{k}') THEN '{v}'" for k, v in options) + " END"


def _list(areas) -> str:
    return "[" + ", ".join(f"'{a}'" for a in areas) + "]"


_CITY = _case([(c.lower(), c) for c in CITIES])
_ACITY = _case([(a.lower(), c) for c, a in AREAS])
_BIZ = f"coalesce({_case([(b, b) for b in BUSINESS_ORDER])}, {_case(ALIAS_ORDER)})"
_SCOPE = "CASE acity " + " ".join(f"WHEN '{c}' THEN list_filter({_list(a)}, lambda x: contains(n, lower(x)))" for c, a in CITIES.items()) + " END"
_WHOLE = "CASE coalesce(city, 'Malang') " + " ".join(f"WHEN '{c}' THEN {_list(a)}" for c, a in CITIES.items()) + " END"
_INTENT = f"WITH q AS (SELECT DISTINCT query FROM social_bootstrap WHERE query IS NOT NULL), n AS (SELECT query, {S.normal('query')} AS n FROM q), c AS (SELECT query, n, coalesce({_CITY}, {_ACITY}) AS city, {_ACITY} AS acity, {_BIZ} AS biz FROM n) SELECT query, coalesce(city, 'Malang') AS intent_city, array_to_string(CASE WHEN len(coalesce({_SCOPE}, [])) > 0 THEN {_SCOPE} ELSE {_WHOLE} END, '|') AS scope, coalesce(biz, 'kuliner') AS intent_business, (city IS NULL OR biz IS NULL) AS fallback FROM c"


@query("intent_parse", _INTENT)
def intent_parse(s, d):
    q = table(s, d, "social_bootstrap").filter("query IS NOT NULL").select("query").distinct()
    return places.intent(q, "query").withColumn("scope", F.array_join("scope", "|"))


_Q = "butuh kedai kopi di Lowokwaru Malang"
_ALIAS = " + ".join(f"(CASE WHEN contains(b, '{a}') THEN 1 ELSE 0 END)" for a, c in ALIASES.items() if c == "kedai kopi")
_CANON = "coalesce(CASE lower(trim(business_hint)) " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items()) + " END, lower(trim(business_hint)))"
_REL = f"""WITH r AS (SELECT row_id, corpus_source, city, area_hint, business_hint, timestamp, {S.normal("text || ' ' || query || ' ' || business_hint")} AS b, {S.normal('text')} AS n FROM ({_CORPUS}) WHERE city = 'Malang'),
s AS (SELECT row_id, corpus_source, timestamp, 6 + CASE WHEN area_hint = 'Lowokwaru' THEN 4 ELSE 0 END + CASE WHEN {_CANON} = 'kedai kopi' THEN 5 ELSE 0 END + CASE WHEN regexp_matches(b, 'kedai|kopi') THEN 3 ELSE 0 END + least({_ALIAS}, 2)
+ {' + '.join(f"(CASE WHEN contains(n, '{w}') THEN 1 ELSE 0 END)" for w in _Q.lower().split() if len(w) > 3)} AS relevance FROM r)
SELECT row_id, corpus_source, relevance::BIGINT AS relevance FROM s ORDER BY relevance DESC, timestamp DESC, row_id LIMIT 180"""


@query("relevance_topk", _REL)
def relevance_topk(s, d):
    """The 180 most relevant rows for one question: a top-k report."""
    r = places.relevance(corpus(s, d), "Malang", ["Lowokwaru"], "kedai kopi", _Q)
    return r.orderBy(F.desc("relevance"), F.desc("timestamp"), "row_id").limit(180).select("row_id", "corpus_source", "relevance")


_PROX = "(?:" + "|".join(PROXIMITY) + ")"
_AREA_ROWS = ", ".join(f"({i}, '{c}', '{a}', '{a.lower()}')" for i, (c, a) in enumerate(AREAS))
_CITY_ROWS = ", ".join(f"('{c}', {x}, {y})" for c, (x, y) in CITY_POINTS.items())
_SHIFT = lambda k, i: f"(('0x' || substr(md5({k}), {i}, 4))::BIGINT / 65535.0 - 0.5) * 0.05"
# the steps of the resolution, from the rule; DuckDB has no gestalt ratio, so misspelled districts are not in it
_RES = rf"""
WITH areas AS (SELECT * FROM (VALUES {_AREA_ROWS}) AS v(ord, city, area, key)), towns AS (SELECT * FROM (VALUES {_CITY_ROWS}) AS v(city, lat, lng)),
poi AS (SELECT doc_id, d.city, trim(area_hint) AS area, {S.key('place_name')} AS key, lower(trim(source)) = 'gmaps_review' AS rev FROM documents d WHERE place_name IS NOT NULL),
pts AS (SELECT doc_id, p.city, area, key, coalesce(rev, FALSE) AS rev, lat + {_SHIFT('key', 1)} AS lat, lng + {_SHIFT('key', 5)} AS lng FROM poi p JOIN towns t ON trim(p.city) = t.city),
one AS (SELECT city, key, lat, lng, CASE WHEN rev THEN 'gmaps_place' ELSE 'overpass_poi' END AS src FROM pts WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY city, key ORDER BY rev DESC, CASE WHEN rev THEN -doc_id ELSE doc_id END) = 1),
uniq AS (SELECT key, min(lat) AS lat, min(lng) AS lng, min(src) AS src FROM one GROUP BY key HAVING count(*) = 1),
cc AS (SELECT city, avg(lat) AS lat, avg(lng) AS lng FROM pts GROUP BY city), ac AS (SELECT city, area, avg(lat) AS lat, avg(lng) AS lng FROM pts WHERE rev AND area IS NOT NULL GROUP BY 1, 2),
k AS (SELECT row_id, trim(coalesce(city, '')) AS city, trim(coalesce(area_hint, '')) AS area, {S.key('text')} AS key, list_transform(regexp_extract_all(lower(trim(coalesce(text, ''))), '{_PROX}\s+([a-z]+(?:\s+[a-z]+){{0,2}})', 1), lambda z: {S.key('z')}) AS near FROM weak_labeled),
n1 AS (SELECT row_id, a.city, a.area, 'text_proximity_pattern' AS src FROM k JOIN areas a ON list_contains(near, a.key) AND (k.city = '' OR a.city = k.city) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY list_position(near, a.key)) = 1),
n2 AS (SELECT row_id, a.city, a.area, 'text_area_match' AS src FROM k JOIN areas a ON contains(' ' || k.key || ' ', ' ' || a.key || ' ') AND (k.city = '' OR a.city = k.city) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY a.ord) = 1),
s AS (SELECT k.row_id, k.city, k.area, k.key, coalesce(n1.city, n2.city) AS ncity, coalesce(n1.area, n2.area) AS narea, coalesce(n1.src, n2.src) AS nsrc, one.lat AS plat, one.lng AS plng, one.src AS psrc, towns.city AS tcity, ka.city AS kcity, ka.area AS karea, uniq.lat AS ulat, uniq.lng AS ulng, uniq.src AS usrc
  FROM k LEFT JOIN n1 USING (row_id) LEFT JOIN n2 USING (row_id) LEFT JOIN one ON one.city = k.city AND one.key = k.key LEFT JOIN towns ON lower(towns.city) = k.key LEFT JOIN areas ka ON ka.key = k.key LEFT JOIN uniq ON uniq.key = k.key),
r AS (SELECT *, CASE WHEN key = '' THEN 'none' WHEN nsrc IS NOT NULL THEN 'named' WHEN plat IS NOT NULL THEN 'poi' WHEN tcity IS NOT NULL THEN 'town' WHEN karea IS NOT NULL THEN 'area' WHEN ulat IS NOT NULL THEN 'alone' ELSE 'hints' END AS step FROM s),
x AS (SELECT *, CASE step WHEN 'named' THEN ncity WHEN 'town' THEN tcity WHEN 'area' THEN kcity ELSE city END AS rcity, CASE step WHEN 'named' THEN narea WHEN 'town' THEN '' WHEN 'area' THEN karea ELSE area END AS rarea FROM r)
SELECT row_id, rcity AS resolved_city, rarea AS resolved_area,
round(CASE step WHEN 'none' THEN NULL WHEN 'poi' THEN plat WHEN 'alone' THEN ulat ELSE coalesce(CASE WHEN rarea <> '' THEN ac.lat END, cc.lat) END, 6) AS lat, round(CASE step WHEN 'none' THEN NULL WHEN 'poi' THEN plng WHEN 'alone' THEN ulng ELSE coalesce(CASE WHEN rarea <> '' THEN ac.lng END, cc.lng) END, 6) AS lng,
CASE step WHEN 'named' THEN nsrc WHEN 'poi' THEN psrc WHEN 'town' THEN 'city_catalog' WHEN 'area' THEN 'area_catalog' WHEN 'alone' THEN usrc WHEN 'hints' THEN (CASE WHEN rarea <> '' AND ac.lat IS NOT NULL THEN 'area_centroid' WHEN cc.lat IS NOT NULL THEN 'city_centroid' ELSE 'unresolved' END) ELSE 'unresolved' END AS source
FROM x LEFT JOIN ac ON ac.city = rcity AND ac.area = rarea LEFT JOIN cc ON cc.city = rcity
"""


def poi(s, d):
    """Places of the documents. The tables have no coordinates: a place lies by its city's point, shifted by its key's
    hash; reviews stand for the one kind of place record, all other documents for the other."""
    towns = s.createDataFrame([(c, x, y) for c, (x, y) in CITY_POINTS.items()], "town string, town_lat double, town_lng double")
    t = table(s, d, "documents").filter("place_name IS NOT NULL").select(F.col("doc_id").alias("ord"), "city", F.col("area_hint").alias("area"), F.col("place_name").alias("name"), T.dedupe_key(F.col("place_name")).alias("key"), F.coalesce(F.lower(F.trim("source")) == "gmaps_review", F.lit(False)).alias("rev"))
    t = t.join(F.broadcast(towns), F.trim("city") == F.col("town"))
    return t.select("ord", "city", "area", "name", (F.col("town_lat") + T.jitter(F.col("key"), 1)).alias("lat"), (F.col("town_lng") + T.jitter(F.col("key"), 5)).alias("lng"), F.when(F.col("rev"), "gmaps_place").otherwise("overpass_poi").alias("source"))


@query("resolve_chain", _RES)
def resolve_chain(s, d):
    out = places.resolve(table(s, d, "weak_labeled").select("row_id", "text", "city", "area_hint"), "text", "city", "area_hint", poi(s, d))
    return out.select("row_id", "resolved_city", "resolved_area", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "source")


@query("resolve_entities", _RES.replace("n1 AS (SELECT", "n1 AS (SELECT * FROM (SELECT", 1).replace("ORDER BY list_position(near, a.key)) = 1)", "ORDER BY list_position(near, a.key)) = 1) WHERE FALSE)", 1).replace("n2 AS (SELECT", "n2 AS (SELECT * FROM (SELECT", 1).replace("ORDER BY a.ord) = 1)", "ORDER BY a.ord) = 1) WHERE FALSE)", 1).replace("FROM weak_labeled)", "FROM (SELECT doc_id AS row_id, CASE WHEN doc_id % 2 = 0 THEN city ELSE NULL END AS city, area_hint, CASE WHEN doc_id % 5 = 1 THEN area_hint WHEN doc_id % 5 = 2 THEN city ELSE place_name END AS text FROM documents))", 1))
def resolve_entities(s, d):
    """Names of places, districts and cities as entities, every other one without its city: all steps of the chain."""
    i = F.col("doc_id")
    t = table(s, d, "documents").select(i.alias("row_id"), F.when(i % 2 == 0, F.col("city")).alias("city"), "area_hint", F.when(i % 5 == 1, F.col("area_hint")).when(i % 5 == 2, F.col("city")).otherwise(F.col("place_name")).alias("text"))
    out = places.resolve(t, "text", "city", "area_hint", poi(s, d), entity=True)
    return out.select("row_id", "resolved_city", "resolved_area", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "source")


_TERMS = [(a.lower(), "LOC") for _, a in AREAS] + [(b, "ORG") for b in BUSINESSES]
_GAZ = " UNION ALL ".join(rf"SELECT row_id, '{t}' AS term, '{lab}' AS label FROM t WHERE regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])')" for t, lab in _TERMS)


@query("gazetteer_match", f"WITH t AS (SELECT row_id, lower(coalesce(text, '')) AS x FROM weak_labeled) SELECT DISTINCT row_id, term, label FROM ({_GAZ})")
def gazetteer_match(s, d):
    return places.gazetteer(table(s, d, "weak_labeled"), "row_id", "text", _TERMS).select("row_id", "term", "label").distinct()


_TERM_ROWS = ", ".join(f"('{t}', '{lab}')" for t, lab in _TERMS)
_SPANS = rf"""WITH t AS (SELECT row_id, lower(text) AS x FROM weak_labeled WHERE text <> ''), g AS (SELECT * FROM (VALUES {_TERM_ROWS}) AS v(term, label)), p AS (SELECT row_id, x, unnest(generate_series(1, length(x))) AS i FROM t)
SELECT row_id, i::BIGINT - 1 AS start, i::BIGINT - 1 + length(term) AS stop, label, term FROM p JOIN g ON substr(x, i, length(term)) = term AND (i = 1 OR NOT regexp_matches(substr(x, i - 1, 1), '[\p{{L}}\p{{N}}_]')) AND NOT regexp_matches(substr(x, i + length(term), 1), '[\p{{L}}\p{{N}}_]')"""


@query("gazetteer_spans", _SPANS)
def gazetteer_spans(s, d):
    """Places of the terms."""
    return places.gazetteer(table(s, d, "weak_labeled"), "row_id", "text", _TERMS)


@query("fuzzy_area")
def fuzzy_area(s, d):
    """Misspelled districts in texts. No SQL twin: SQL has no gestalt ratio. Tested against the standard library's."""
    return places.fuzzy_area(table(s, d, "social_bootstrap").select("row_id", "text"), "row_id", "text")


@query("edit_area", f"WITH a AS (SELECT * FROM (VALUES {_AREA_ROWS}) AS v(ord, city, area, key)), h AS (SELECT DISTINCT lower(trim(area_hint)) AS hint FROM social_bootstrap WHERE trim(area_hint) <> '') SELECT hint, area, levenshtein(hint, key)::BIGINT AS distance FROM h CROSS JOIN a QUALIFY row_number() OVER (PARTITION BY hint ORDER BY levenshtein(hint, key), ord) = 1")
def edit_area(s, d):
    """The district with the fewest edits for every distinct hint. The districts are a fixed list in the expression."""
    h = table(s, d, "social_bootstrap").filter(F.trim("area_hint") != "").select(F.lower(F.trim("area_hint")).alias("hint")).distinct()
    best = F.array_min(F.array(*[F.struct(F.levenshtein("hint", F.lit(a.lower())).cast("long").alias("distance"), F.lit(i).alias("ord"), F.lit(a).alias("area")) for i, (_, a) in enumerate(AREAS)]))
    return h.select("hint", best.alias("b")).select("hint", "b.area", "b.distance")


_TPL = ", ".join(f"({i}, '{t}', '{n}', {p})" for i, (t, n, p) in enumerate(TEMPLATES))
_SEEDS = f"""WITH t AS (SELECT * FROM (VALUES {_TPL}) AS v(template_index, template, intent, priority)), b AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in BUSINESSES)}) AS v(business)), a AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{x}')" for c, x in AREAS)}) AS v(city, area_hint)),
f AS (SELECT template_index, template, intent, priority, coalesce(business, '') AS business_hint, city, area_hint FROM t LEFT JOIN b ON contains(template, '{{business}}') CROSS JOIN a),
q AS (SELECT *, trim(replace(replace(replace(template, '{{business}}', business_hint), '{{district}}', area_hint), '{{city}}', city)) AS query FROM f)
SELECT query, city, area_hint, business_hint, intent, priority, template_index, row_number() OVER (PARTITION BY template_index ORDER BY sha256(query)) AS turn FROM q"""


@query("query_seeds", _SEEDS)
def query_seeds(s, d):
    return places.seeds(s)


@query("seed_schedule", f"SELECT query, row_number() OVER (ORDER BY turn, priority DESC, template_index) AS place FROM ({_SEEDS}) QUALIFY row_number() OVER (ORDER BY turn, priority DESC, template_index) <= 500")
def seed_schedule(s, d):
    """The first 500 seeds, one of each template in turn: a crawl budget."""
    from pyspark.sql.window import Window

    q = places.seeds(s).orderBy("turn", F.desc("priority"), "template_index").limit(500)
    return q.select("query", F.row_number().over(Window.partitionBy().orderBy("turn", F.desc("priority"), "template_index")).alias("place"))  # 500 rows


_POINTS = _RES[: _RES.index("k AS (SELECT")].rstrip().rstrip(",")


@query("centroids", f"{_POINTS} SELECT city, NULL AS area, round(lat, 6) AS lat, round(lng, 6) AS lng FROM cc UNION ALL SELECT city, area, round(lat, 6), round(lng, 6) FROM ac")
def centroids(s, d):
    """Mean points of cities, and of districts by reviews."""
    _, cities, areas = places.points_of(poi(s, d))
    both = cities.withColumn("area", F.lit(None).cast("string")).unionByName(areas)
    return both.select("city", "area", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_POI = "SELECT doc_id, city, lower(trim(place_name)) AS key, CASE WHEN lower(trim(source)) = 'gmaps_review' THEN 0 ELSE 1 END AS prio FROM documents WHERE place_name IS NOT NULL AND city IS NOT NULL"


@query("poi_overlay", f"SELECT city, key, doc_id, prio FROM ({_POI}) QUALIFY row_number() OVER (PARTITION BY city, key ORDER BY prio, CASE WHEN prio = 0 THEN -doc_id ELSE doc_id END) = 1")
def poi_overlay(s, d):
    """One record a place and city: reviews before all else, the last review, otherwise the first record."""
    from sparkloka.operators.rows import keep_one

    t = table(s, d, "documents").filter("place_name IS NOT NULL AND city IS NOT NULL").select("doc_id", "city", F.lower(F.trim("place_name")).alias("key"), F.when(F.lower(F.trim("source")) == "gmaps_review", 0).otherwise(1).alias("prio"))
    return keep_one(t, ["city", "key"], [F.col("prio"), F.when(F.col("prio") == 0, -F.col("doc_id")).otherwise(F.col("doc_id"))])


@query("unique_poi", f"SELECT key, min(city) AS city FROM (SELECT DISTINCT city, key FROM ({_POI})) GROUP BY key HAVING count(*) = 1")
def unique_poi(s, d):
    """Places that only one city has."""
    return poi_overlay(s, d).groupBy("key").agg(F.min("city").alias("city"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("key", "city")


@query("poi_names", "SELECT city, name, k::BIGINT AS k FROM (SELECT city, name, row_number() OVER (PARTITION BY city ORDER BY length(name) DESC, name) AS k FROM (SELECT DISTINCT city, place_name AS name FROM documents WHERE city IS NOT NULL AND length(place_name) >= 4)) WHERE k <= 500")
def poi_names(s, d):
    """The 500 longest place names of each city: a gazetteer of fixed size."""
    from sparkloka.operators.rows import top_per

    n = table(s, d, "documents").filter("city IS NOT NULL AND length(place_name) >= 4").select("city", F.col("place_name").alias("name")).distinct()
    return top_per(n, "city", [F.desc(F.length("name")), F.col("name")], 500).select("city", "name", F.col("rank_in_group").cast("long").alias("k"))

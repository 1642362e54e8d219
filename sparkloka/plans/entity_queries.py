"""Entity tags: painted from gazetteer spans, decoded into spans, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloka.constants import BUSINESSES, CITIES
from sparkloka.functions import text as T
from sparkloka.operators import entities, evaluation, places
from sparkloka.operators.places import AREAS
from sparkloka.plans.registry import query
from sparkloka.runtime import table

# what spans are painted from; below it, a tagger over words of lower-cased text: one-word districts are LOC, capitalised words are PER
_SPAN_TERMS = [(c.lower(), "LOC") for c in CITIES] + [(a.lower(), "LOC") for _, a in AREAS] + [(b, "ORG") for b in BUSINESSES]
_AREA = sorted({a.lower() for _, a in AREAS if " " not in a})
_IN = "(" + ", ".join(f"'{a}'" for a in _AREA) + ")"
_TOK = r"SELECT row_id, u.i AS pos, u.w AS token FROM (SELECT row_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), lambda w, i: {'i': i, 'w': w})) AS u FROM signal_val)"
_TAGS = f"SELECT row_id, pos, token, CASE WHEN lower(token) IN {_IN} THEN 'LOC' WHEN regexp_matches(token, '^[A-Z][a-z]+$') AND pos > 1 THEN 'PER' ELSE 'O' END AS kind FROM ({_TOK})"
_BIO = f"SELECT row_id, pos, token, CASE WHEN kind = 'O' THEN 'O' WHEN kind = 'PER' AND lag(kind) OVER (PARTITION BY row_id ORDER BY pos) = 'PER' THEN 'I-PER' ELSE 'B-' || kind END AS tag FROM ({_TAGS})"


def tagged(s, d):
    """(row_id, tokens, tags): the tags of a row are made within its array, the one before by index."""
    t = table(s, d, "signal_val").select("row_id", T.tokens(F.col("text")).alias("tokens"))
    kind = F.transform("tokens", lambda w, i: F.when(F.lower(w).isin(_AREA), "LOC").when(w.rlike("^[A-Z][a-z]+$") & (i > 0), "PER").otherwise("O"))
    t = t.withColumn("kinds", kind)
    tags = F.transform("kinds", lambda k, i: F.when(k == "O", k).when((k == "PER") & (i > 0) & (F.try_element_at("kinds", F.greatest(i, F.lit(1))) == "PER"), "I-PER").otherwise(F.concat(F.lit("B-"), k)))
    return t.select("row_id", "tokens", tags.alias("tags"))


@query("bio_tag", f"SELECT row_id, pos::BIGINT AS pos, token, tag FROM ({_BIO}) WHERE tag <> 'O'")
def bio_tag(s, d):
    x = tagged(s, d).select("row_id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("i", "x"))
    return x.select("row_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("x.tokens").alias("token"), F.col("x.tags").alias("tag")).filter("tag <> 'O'")


@query("bio_decode", f"SELECT row_id, any_value(type) AS type, min(pos)::BIGINT - 1 AS start, max(pos)::BIGINT AS stop FROM (SELECT row_id, pos, substr(tag, 3) AS type, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS g FROM ({_BIO}) WHERE tag <> 'O') GROUP BY row_id, g")
def bio_decode(s, d):
    return tagged(s, d).select("row_id", F.explode(evaluation.spans(F.col("tags"))).alias("x")).select("row_id", "x.type", F.col("x.start").cast("long").alias("start"), F.col("x.stop").cast("long").alias("stop"))


@query("ner_f1", f"WITH a AS (SELECT row_id, any_value(type) AS type, min(pos) AS b, max(pos) AS e FROM (SELECT row_id, pos, substr(tag, 3) AS type, sum(CASE WHEN tag LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS g FROM ({_BIO}) WHERE tag <> 'O') GROUP BY row_id, g), h AS (SELECT * FROM a WHERE type = 'LOC' OR e - b = 0) SELECT type, sum(CASE WHEN h.b IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS tp, count(*) AS n_true, sum(CASE WHEN h.b IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_guess, round(2.0 * sum(CASE WHEN h.b IS NOT NULL THEN 1 ELSE 0 END) / (count(*) + sum(CASE WHEN h.b IS NOT NULL THEN 1 ELSE 0 END)), 6)::DOUBLE AS f1 FROM a LEFT JOIN h USING (row_id, type, b, e) GROUP BY type")
def ner_f1(s, d):
    """A second tagger that only knows one-word persons, against the first."""
    a = bio_decode(s, d).withColumnRenamed("row_id", "sent_id")
    return evaluation.span_scores(a, a.filter("type = 'LOC' OR stop - start = 1"))


@query("first_subtoken", r"SELECT row_id, u.i::BIGINT AS pos, u.p AS piece, u.p <> coalesce(lag(u.p) OVER (PARTITION BY row_id ORDER BY u.i), '') AS is_first FROM (SELECT row_id, unnest(list_transform(string_split(coalesce(text, ''), ' '), lambda w, i: {'i': i, 'p': lower(substr(w, 1, 1))})) AS u FROM signal_val)")
def first_subtoken(s, d):
    """Whether a piece differs from the one before it in its row: a lag within the array, without a window's shuffle."""
    pieces = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.lower(F.substring(w, 1, 1)))
    t = table(s, d, "signal_val").select("row_id", pieces.alias("p"))
    return t.select("row_id", F.posexplode("p").alias("i", "piece"), "p").select("row_id", (F.col("i") + 1).cast("long").alias("pos"), "piece", (F.col("piece") != F.when(F.col("i") > 0, F.col("p")[F.col("i") - 1]).otherwise("")).alias("is_first"))


@query("span_paint")
def span_paint(s, d):
    """Tags painted from the spans of all terms: cities, districts, businesses, the names of places in the row's city,
    its own district hint. No SQL twin; decoding the tags gives the spans back."""
    rows = table(s, d, "signal_val").filter("text IS NOT NULL").select("row_id", "text", "city", "area_hint")
    toks = rows.select("row_id", F.posexplode(T.offsets(F.lower("text"))).alias("pos", "t")).select("row_id", F.col("pos").cast("long").alias("pos"), "t.token", F.col("t.start").cast("long").alias("start"), F.col("t.stop").cast("long").alias("stop"))
    found = places.gazetteer(rows, "row_id", "text", _SPAN_TERMS).select("row_id", "start", "stop", "label")
    names = table(s, d, "documents").select("city", F.col("place_name").alias("name"))
    found = found.unionByName(places.own_terms(rows, "row_id", "text", "city", "area_hint", names)).distinct()
    return entities.paint(toks, found, "row_id")


_VEC = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_PROB = f"SELECT vec_id, list_transform(v, lambda x: exp(x) / list_sum(list_transform(v, lambda y: exp(y)))) AS p FROM ({_VEC})"


@query("top2_margin", f"SELECT vec_id, round(list_reverse_sort(p)[1], 6) AS confidence, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, list_position(p, list_reverse_sort(p)[1])::BIGINT AS guess FROM ({_PROB})")
def top2_margin(s, d):
    """Softmax of a vector's scores, the best and its lead."""
    v = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("e"))
    p = v.select("vec_id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p")).withColumn("q", F.sort_array("p", asc=False))
    return p.select("vec_id", F.round(F.col("q")[0], 6).alias("confidence"), F.round(F.col("q")[0] - F.col("q")[1], 6).alias("margin"), F.array_position("p", F.col("q")[0]).alias("guess"))

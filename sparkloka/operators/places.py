"""Query intent, retrieval relevance, place resolution and gazetteer matches against the catalogue.

The catalogue is a fixed, small dimension, so it is folded into expressions or broadcast. Defined results: null texts
and hints count as empty; what resolves to nothing says "unresolved"; a query without city or business gets the
defaults and is marked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloka.constants import ALIASES, BUSINESSES, CITIES, DEFAULT_BUSINESS, DEFAULT_CITY, PROXIMITY, TEMPLATES
from sparkloka.functions import text as T
from sparkloka.functions.text import dedupe_key, normalize_text, offsets, tokens
from sparkloka.runtime import bounded, stage

AREAS = [(city, area) for city, areas in CITIES.items() for area in areas]
ALIAS_ORDER = sorted(ALIASES.items(), key=lambda kv: len(kv[0]), reverse=True)
#: Counted places up to which they are broadcast.
PLACES = 200_000
BUSINESS_ORDER = sorted(BUSINESSES, key=len, reverse=True)


def catalogue(spark: SparkSession) -> DataFrame:
    """(ord, city, area, key) of the 25 districts."""
    return spark.createDataFrame([(i, c, a, a.lower()) for i, (c, a) in enumerate(AREAS)], "ord int, city string, area string, key string")


def _first(normal: Column, options: list[tuple[str, str]]) -> Column:
    """The value of the first option whose key is in the text."""
    out = F.lit(None).cast("string")
    for key, value in reversed(options):
        out = F.when(F.contains(normal, F.lit(key)), value).otherwise(out)
    return out


def intent(df: DataFrame, query: str) -> DataFrame:
    """Adds ``intent_city``, ``scope`` (array), ``intent_business`` and ``fallback``.

    The first city of the catalogue that the query holds; else the city of the first district; the districts named in
    that district's city, else all of the city; the longest business hint, else the longest alias."""
    n = normalize_text(F.col(query))
    df = df.withColumn("__n", n)
    n = F.col("__n")
    named_city = _first(n, [(c.lower(), c) for c in CITIES])
    area_city = _first(n, [(a.lower(), c) for c, a in AREAS])
    city = F.coalesce(named_city, area_city)
    biz = F.coalesce(_first(n, [(b, b) for b in BUSINESS_ORDER]), _first(n, ALIAS_ORDER))
    scope = F.array().cast("array<string>")
    whole = F.array().cast("array<string>")
    for c, areas in CITIES.items():
        scope = F.when(area_city == c, F.filter(F.array(*[F.lit(a) for a in areas]), lambda a: F.contains(n, F.lower(a)))).otherwise(scope)
        whole = F.when(F.coalesce(city, F.lit(DEFAULT_CITY)) == c, F.array(*[F.lit(a) for a in areas])).otherwise(whole)
    return df.withColumns({
        "intent_city": F.coalesce(city, F.lit(DEFAULT_CITY)), "scope": F.when(F.size(scope) > 0, scope).otherwise(whole),
        "intent_business": F.coalesce(biz, F.lit(DEFAULT_BUSINESS)), "fallback": city.isNull() | biz.isNull(),
    }).drop("__n")


def canonical_business(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.try_element_at(m, low), low)


def relevance(corpus: DataFrame, city: str, scope: list[str], business: str, query: str) -> DataFrame:
    """Rows of the intent's city with their relevance: city 6, district 4, business 5 and 3 and up to 2 aliases, 1 for
    each longer query word in the text. Other cities never qualify, so the city is a filter that reaches the scan."""
    rows = corpus.filter(F.col("city") == city)
    blob = normalize_text(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("query", F.lit("")), F.coalesce("business_hint", F.lit(""))))
    rows = rows.withColumn("__b", blob).withColumn("__n", normalize_text(F.col("text")))
    score = F.lit(6) + F.when(F.trim(F.coalesce("area_hint", F.lit(""))).isin(scope), 4).otherwise(0)
    score = score + F.when(canonical_business(F.col("business_hint")) == business, 5).otherwise(0)
    words = [w for w in business.split() if len(w) > 2]
    if words:
        score = score + F.when(F.col("__b").rlike("|".join(words)), 3).otherwise(0)
    alias = sum([F.when(F.contains(F.col("__b"), F.lit(a)), 1).otherwise(0) for a, c in ALIASES.items() if c == business], F.lit(0))
    score = score + F.least(alias, F.lit(2))
    for w in query.lower().split():
        if len(w) > 3:
            score = score + F.when(F.contains(F.col("__n"), F.lit(w)), 1).otherwise(0)
    return rows.withColumn("relevance", score.cast("long")).drop("__b", "__n")


_NEAR = re.compile(rf"(?:{'|'.join(PROXIMITY)})\s+([a-z]+(?:\s+[a-z]+){{0,2}})")
_KEYS = {T.keyed(T.normal(a)): (c, a) for c, a in AREAS}
_CITY_KEYS = {T.keyed(T.normal(c)): c for c in CITIES}


@lru_cache(200_000)
def _mask(word: str) -> int:
    """A bit for each character; some share one."""
    m = 0
    for c in word:
        m |= 1 << (ord(c) & 63)
    return m


@lru_cache(1_000)
def _near_length(n: int, cutoff: float) -> list[tuple[str, int, float]]:
    """(key, mask, room) of the districts that a name of n characters can be close to: a ratio r leaves at most
    (1 - r)(a + b) of all characters unmatched."""
    room = {k: (1 - cutoff) * (len(k) + n) + 1e-9 for k in _KEYS}
    return [(k, _mask(k), r) for k, r in room.items() if abs(len(k) - n) <= r]


def close_area(name: str, cutoff: float, mask: int | None = None) -> list[str]:
    """Keys of the districts whose gestalt ratio with a name is ``cutoff`` or more, the closest first."""
    some = _near_length(len(name), cutoff)
    if not some:
        return []
    m = _mask(name) if mask is None else mask
    out = [(r, k) for k, own, room in some if (own ^ m).bit_count() <= room and (r := SequenceMatcher(None, k, name).ratio()) >= cutoff]
    return [k for _, k in sorted(out, reverse=True)]


def windows(words: list[str]) -> Iterator[tuple[str, int]]:
    """Every run of one, two and three words with its mask."""
    masks, space = [_mask(w) for w in words], _mask(" ")
    for i, w in enumerate(words):
        yield w, masks[i]
    for n in (2, 3):
        for i in range(len(words) - n + 1):
            m = space
            for k in masks[i : i + n]:
                m |= k
            yield " ".join(words[i : i + n]), m


def find_area(text: str, city: str, allowed: frozenset[str] | None = None) -> tuple[str, str, str] | None:
    """(city, district, source) of the district that a text names: right after a proximity word, else anywhere as a
    whole, else misspelled (its first three words at 0.88 or any one to three words at 0.90)."""
    key = T.keyed(T.normal(text))
    fits = lambda k: k in _KEYS and (not city or _KEYS[k][0] == city) and (not allowed or _KEYS[k][1] in allowed)
    for m in _NEAR.finditer(text.strip().lower()):
        if fits(k := T.keyed(T.normal(m[1]))):
            return (*_KEYS[k], "text_proximity_pattern")
    padded = f" {key} "
    for k in _KEYS:
        if f" {k} " in padded and fits(k):
            return (*_KEYS[k], "text_area_match")
    words = key.split()
    first = " ".join(words[:3])
    for name, mask, cutoff in ((first, _mask(first), 0.88), *((w, m, 0.9) for w, m in windows(words))):
        if (close := close_area(name, cutoff, mask)) and (k := next(filter(fits, close), None)):
            return (*_KEYS[k], "text_fuzzy_match")
    return None


def points_of(poi: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From places (ord, city, area, name, lat, lng, source): one point for each (city, key), reviews (the last one)
    before all else (the first one); and the mean points of cities, and of districts by reviews. Both coordinates are
    averaged over what they have; a key of no letters names nothing."""
    p = poi.select("ord", F.trim("city").alias("city"), F.trim("area").alias("area"), dedupe_key(F.col("name")).alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col("source").alias("poi_source"), (F.col("source") == "gmaps_place").alias("__r"))
    one = p.filter("city IS NOT NULL AND key <> '' AND lat IS NOT NULL AND lng IS NOT NULL")
    one = one.groupBy("city", "key").agg(F.min_by(F.struct("lat", "lng", "poi_source"), F.struct(~F.col("__r"), F.when(F.col("__r"), -F.col("ord")).otherwise(F.col("ord")))).alias("x")).select("city", "key", "x.*")
    mean = lambda d, *by: d.groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).dropna(subset=[*by, "lat", "lng"])
    return one, mean(p, "city"), mean(p.filter("__r"), "city", "area")


def resolve(rows: DataFrame, text: str, city: str, area: str, poi: DataFrame | None = None, allowed: Sequence[str] | None = None, entity: bool = False) -> DataFrame:
    """Adds resolved_city, resolved_area, lat, lng, source to rows with a text, a city hint and an area hint.

    The district that the text names (not asked where the text is an ``entity``); else the text as a whole as a place of
    the city, a city, a district (of the city if it can be), or a place that only one city has; else the hints, by the
    mean point of their district or city. ``poi`` as in ``points_of``; ``allowed`` bounds the districts named in texts.
    Null hints count as empty; texts without letters or digits are "unresolved" and keep their hints."""
    only = frozenset(allowed) if allowed else None

    @F.pandas_udf("key string, named struct<city:string,area:string,source:string>, known struct<city:string,area:string,source:string>")
    def read(texts: pd.Series, cities: pd.Series) -> pd.DataFrame:
        out = []
        for t, c in zip(texts, cities):
            key = T.keyed(T.normal(t))
            named = find_area(t, c, only) if key and not entity else None
            known = (_CITY_KEYS[key], "", "city_catalog") if key in _CITY_KEYS else (*_KEYS[key], "area_catalog") if key in _KEYS else None
            out.append((key, *(dict(zip(("city", "area", "source"), x)) if x else None for x in (named, known))))
        return pd.DataFrame(out, columns=["key", "named", "known"])

    hint = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    made = rows.withColumn("__city", hint(city)).withColumn("__area", hint(area)).withColumn("__x", read.asNondeterministic()(F.coalesce(text, F.lit("")), "__city"))
    made = made.withColumn("__key", F.col("__x.key"))
    if poi is None:
        poi = rows.sparkSession.createDataFrame([], "ord long, city string, area string, name string, lat double, lng double, source string")
    one, cities, areas = points_of(poi)
    one = stage(one, "places")
    as_ = lambda d, **names: d.select(*[F.col(c).alias(n) for c, n in names.items()])
    alone = one.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("lat").alias("__ulat"), F.first("lng").alias("__ulng"), F.first("poi_source").alias("__usource")).filter("n = 1").drop("n").withColumnRenamed("key", "__key")
    made = made.join(bounded(as_(one, city="__city", key="__key", lat="__plat", lng="__plng", poi_source="__psource"), PLACES), ["__city", "__key"], "left").join(bounded(alone, PLACES), "__key", "left")
    hints = F.struct(F.col("__city").alias("city"), F.col("__area").alias("area"))
    where = lambda s: F.struct(F.col(f"__x.{s}.city").alias("city"), F.col(f"__x.{s}.area").alias("area"))
    step = F.when(F.col("__key") == "", "none").when(F.col("__x.named").isNotNull(), "named").when(F.col("__plat").isNotNull(), "poi").when(F.col("__x.known").isNotNull(), "known").when(F.col("__ulat").isNotNull(), "alone").otherwise("hints")
    made = made.withColumn("__step", step).withColumn("__at", F.when(F.col("__step") == "named", where("named")).when(F.col("__step") == "known", where("known")).otherwise(hints))
    made = made.withColumns({"resolved_city": F.col("__at.city"), "resolved_area": F.col("__at.area")})
    made = made.join(bounded(as_(areas, city="resolved_city", area="resolved_area", lat="__alat", lng="__alng"), PLACES), ["resolved_city", "resolved_area"], "left").join(bounded(as_(cities, city="resolved_city", lat="__clat", lng="__clng"), PLACES), "resolved_city", "left")

    def point(x: str) -> Column:
        mean = F.when((F.col("resolved_area") != "") & F.col(f"__a{x}").isNotNull(), F.col(f"__a{x}")).otherwise(F.col(f"__c{x}"))
        return F.when(F.col("__step") == "poi", F.col(f"__p{x}")).when(F.col("__step") == "alone", F.col(f"__u{x}")).when(F.col("__step") != "none", mean)

    by_hint = F.when((F.col("__area") != "") & F.col("__alat").isNotNull(), "area_centroid").when(F.col("__clat").isNotNull(), "city_centroid").otherwise("unresolved")
    source = F.when(F.col("__step") == "named", F.col("__x.named.source")).when(F.col("__step") == "poi", F.col("__psource")).when(F.col("__step") == "known", F.col("__x.known.source")).when(F.col("__step") == "alone", F.col("__usource")).when(F.col("__step") == "hints", by_hint).otherwise("unresolved")
    return made.select(*rows.columns, "resolved_city", "resolved_area", point("lat").alias("lat"), point("lng").alias("lng"), source.alias("source"))


def choose(rows: DataFrame, city: str, scope: Sequence[str], poi: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Rows (row_id, text, area_hint) placed in the asked districts, others left out; adds resolved_city, resolved_area,
    lat, lng, source.

    The first of ``entities`` (row_id, pos, entity) that lies in one of the districts; else the row's own hint; else what
    its text resolves to; else the only district asked for."""
    asked = rows.withColumn("__asked", F.lit(city))
    seeded = F.trim(F.coalesce("area_hint", F.lit(""))).isin(list(scope))
    own = resolve(asked.filter(seeded).withColumn("__own", F.trim("area_hint")), "__own", "__asked", "__own", poi, entity=True).drop("__own")
    own = own.withColumns({"resolved_city": F.lit(city), "resolved_area": F.trim("area_hint"), "source": F.lit("seed_area_hint")})
    text = resolve(asked.filter(~seeded), "text", "__asked", "area_hint", poi, scope)
    if len(scope) == 1:
        only = resolve(asked.filter(~seeded).select("row_id", "__asked").withColumn("__only", F.lit(scope[0])), "__only", "__asked", "__only", poi, entity=True).select("row_id", F.col("lat").alias("__lat"), F.col("lng").alias("__lng"))
        text = text.join(only.dropDuplicates(["row_id"]), "row_id", "left")
        empty = F.col("resolved_area") == ""
        text = text.withColumns({"source": F.when(empty, "query_scope_fallback").otherwise(F.col("source")), "lat": F.when(empty, F.col("__lat")).otherwise(F.col("lat")), "lng": F.when(empty, F.col("__lng")).otherwise(F.col("lng")), "resolved_city": F.when(empty, city).otherwise(F.col("resolved_city")), "resolved_area": F.when(empty, scope[0]).otherwise(F.col("resolved_area"))}).drop("__lat", "__lng")
    out = own.unionByName(text).drop("__asked").filter(F.col("resolved_area").isin(list(scope)) | F.lit(entities is not None))
    if entities is not None:
        e = resolve(entities.join(rows.select("row_id", "area_hint").dropDuplicates(["row_id"]), "row_id").withColumn("__asked", F.lit(city)), "entity", "__asked", "area_hint", poi, entity=True)
        best = e.filter(F.col("resolved_area").isin(list(scope))).groupBy("row_id").agg(F.min_by(F.struct("resolved_area", "lat", "lng", "source"), "pos").alias("__e"))
        out = out.join(best, "row_id", "left")
        out = out.withColumns({c: F.when(F.col("__e").isNotNull(), F.col(f"__e.{c}")).otherwise(F.col(c)) for c in ("resolved_area", "lat", "lng", "source")}).withColumn("resolved_city", F.lit(city)).drop("__e").filter(F.col("resolved_area").isin(list(scope)))
    return out


def gazetteer(rows: DataFrame, id_col: str, text: str, terms: list[tuple[str, str]]) -> DataFrame:
    """(id, start, stop, label, term): every whole-word occurrence of a term in the lower-cased text, overlapping ones
    too. One automaton of all terms reads each text once; no built-in expression gives places of overlapping terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for term, label in terms:
            auto.add_word(term, (term, label))
        auto.make_automaton()
        word = lambda c: c.isalnum() or c == "_"
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"]):
                for end, (term, label) in auto.iter(t):
                    start, stop = end + 1 - len(term), end + 1
                    if not (start and word(t[start - 1])) and not (stop < len(t) and word(t[stop])):
                        out.append((i, start, stop, label, term))
            yield pd.DataFrame(out, columns=["id", "start", "stop", "label", "term"])

    some = rows.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.col(text)).alias("text")).filter("text <> ''")
    return some.mapInPandas(run, "id bigint, start bigint, stop bigint, label string, term string").withColumnRenamed("id", id_col)


def own_terms(rows: DataFrame, id_col: str, text: str, city: str, area: str, names: DataFrame) -> DataFrame:
    """(id, start, stop, label): whole-word occurrences of terms that count for a row alone: the place names (city, name)
    of its city, of four characters or more, as ORG, and its own district hint as LOC.

    Names grow with the data, so runs of a text's tokens are joined with them; none is collected."""
    known = names.select(F.lower(F.trim("city")).alias("__city"), F.lower(F.trim("name")).alias("term")).filter(F.length("term") >= 4).distinct()
    sizes = known.agg(F.array_sort(F.collect_set(F.size(tokens(F.col("term")))))).first()[0]  # numbers of tokens, a few
    t = rows.select(F.col(id_col).cast("bigint").alias(id_col), F.lower(F.trim(city)).alias("__city"), F.lower(F.trim(F.coalesce(F.col(area), F.lit("")))).alias("__hint"), F.lower(text).alias("__x"))
    t = t.filter("__x <> ''").withColumn("__t", offsets(F.col("__x")))
    size = F.length("__hint")
    own = F.filter("__t", lambda w: (size > 0) & (F.substr("__x", w["start"] + 1, size) == F.col("__hint")) & F.array_contains(F.col("__t")["stop"], w["start"] + size))
    hinted = t.select(id_col, size.alias("__n"), F.explode(own["start"]).alias("start")).select(id_col, "start", (F.col("start") + F.col("__n")).alias("stop"), F.lit("LOC").alias("label"))
    # every run of as many tokens as some name has
    runs = t.select(id_col, "__city", "__x", "__t", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("__n"))
    runs = runs.filter(F.size("__t") >= F.col("__n")).select(id_col, "__city", "__x", F.explode(F.transform(F.slice("__t", F.lit(1), F.size("__t") - F.col("__n") + 1), lambda w, i: F.struct(w["start"].alias("start"), F.col("__t")[i + F.col("__n") - 1]["stop"].alias("stop")))).alias("w"))
    runs = runs.select(id_col, "__city", "w.start", "w.stop", F.substr("__x", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start")).alias("term")).filter(F.length("term") >= 4)
    met = runs.join(bounded(known, 200_000), ["__city", "term"]).select(id_col, "start", "stop", F.lit("ORG").alias("label"))
    return met.unionByName(hinted).select(id_col, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label")


def fuzzy_area(rows: DataFrame, id_col: str, text: str, cutoff: float = 0.9) -> DataFrame:
    """(id, window, area, ratio): every run of one to three words of a text with its closest district, by the gestalt
    ratio of the normalised names, from ``cutoff`` up. Each distinct run of a text is matched once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"]):
                words = T.keyed(T.normal(t)).split()
                for name, mask in dict(windows(words)).items():
                    for k in close_area(name, cutoff, mask)[:1]:
                        out.append((i, name, _KEYS[k][1], round(SequenceMatcher(None, k, name).ratio(), 6)))
            yield pd.DataFrame(out, columns=["id", "window", "area", "ratio"])

    some = rows.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return some.mapInPandas(run, "id bigint, window string, area string, ratio double").withColumnRenamed("id", id_col)


def seeds(spark: SparkSession) -> DataFrame:
    """All query seeds (query, city, area_hint, business_hint, intent, template_index, turn): templates x businesses x
    districts; ``turn`` is a seed's place within its template, by SHA-256."""
    from pyspark.sql.window import Window

    t = spark.createDataFrame([(i, x, y, p) for i, (x, y, p) in enumerate(TEMPLATES)], "template_index int, template string, intent string, priority int")
    b = spark.createDataFrame([(x,) for x in BUSINESSES], "business string")
    some = t.join(F.broadcast(b), F.contains("template", F.lit("{business}")), "left").withColumn("business", F.coalesce("business", F.lit("")))
    a = catalogue(spark).select("city", F.col("area").alias("area_hint")).withColumn("one", F.lit(1))
    full = some.withColumn("one", F.lit(1)).join(F.broadcast(a), "one").drop("one")  # fixed dimensions: some 11,000 rows
    q = F.trim(F.replace(F.replace(F.replace("template", F.lit("{business}"), "business"), F.lit("{district}"), "area_hint"), F.lit("{city}"), "city"))
    full = full.withColumn("query", q)
    return full.select("query", "city", "area_hint", F.col("business").alias("business_hint"), "intent", "priority", "template_index", F.row_number().over(Window.partitionBy("template_index").orderBy(F.sha2("query", 256))).alias("turn"))

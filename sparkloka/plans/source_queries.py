"""Sources and sinks: what is written and read again must be what was there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloka.plans.registry import query
from sparkloka.plans.text_queries import _URLS
from sparkloka.runtime import shared_dir, table
from sparkloka.sources import files, pages


def _at(s, name):
    return f"{shared_dir(s)}/sparkloka/{name}-{uuid.uuid4().hex}"


_CSV = ["row_id", "text", "city", "confidence"]


@query("csv_round_trip", "SELECT row_id, md5(coalesce(text, '')) AS digest, coalesce(city, '') AS city, confidence FROM weak_labeled")
def csv_round_trip(s, d):
    """Written as quoted CSV with line breaks and quotes, read as strings, typed again."""
    at = _at(s, "csv")
    files.write_csv(table(s, d, "weak_labeled"), at, _CSV)
    back = files.typed(files.read_csv(s, at, _CSV), row_id="bigint", confidence="double")
    return back.select("row_id", F.md5("text").alias("digest"), "city", "confidence")


@query("jsonl_round_trip", "SELECT row_id, text, confidence FROM weak_labeled WHERE text IS NOT NULL")
def jsonl_round_trip(s, d):
    at = _at(s, "jsonl")
    t = table(s, d, "weak_labeled").select("row_id", "text", "confidence")
    t.write.json(at)
    return files.read_jsonl(s, at, t.schema, F.col("text").isNotNull())


@query("tagged_sentences", r"SELECT row_id, u.i::BIGINT AS pos, u.t AS token FROM (SELECT row_id, unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w, i: {'i': i, 't': w})) AS u FROM signal_val WHERE text IS NOT NULL)")
def tagged_sentences(s, d):
    """Sentences written a token a line and read again."""
    at = _at(s, "tsv")
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    t = table(s, d, "signal_val").filter("text IS NOT NULL").select("row_id", words.alias("w")).filter(F.size("w") > 0)
    t.select(F.concat(F.array_join(F.transform("w", lambda x, i: F.concat_ws("\t", x, F.col("row_id").cast("string"), (i + 1).cast("string"))), "\n"), F.lit("\n")).alias("value")).write.text(at)
    back = files.read_tagged(s, at, least=3, tag_at=2).select(F.posexplode("tokens").alias("i", "token"), F.col("tags")[0].try_cast("bigint").alias("row_id"))
    return back.select("row_id", (F.col("i") + 1).cast("long").alias("pos"), "token")


@query("page_links", f"SELECT row_id, canonical AS target FROM ({_URLS}) WHERE regexp_matches(canonical, '^https?://[^/]+/.+')")
def page_links(s, d):
    """Anchors of small pages made from all posts' addresses, each named twice."""
    u = F.col("url")
    for x, y in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;")):
        u = F.replace(u, F.lit(x), F.lit(y))
    t = table(s, d, "social_bootstrap").filter("url IS NOT NULL").select("row_id", F.concat(F.lit('<html><a class="x" href="'), u, F.lit('">a</a><a href=\''), u, F.lit("'>b</a></html>")).alias("html"))
    return pages.links(t, "row_id", "html", "^https?://[^/]+/.+").select("row_id", "target")


@query("sorted_union", "SELECT DISTINCT n FROM (SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier)")
def sorted_union(s, d):
    return table(s, d, "customer").select(F.col("c_name").alias("n")).union(table(s, d, "supplier").select("s_name")).distinct()


@query("orphan_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)")
def orphan_keys(s, d):
    return files.orphans(table(s, d, "lineitem"), "l_partkey", table(s, d, "part").filter("p_size > 1"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("csv_glob", "SELECT row_id, final_signal, city FROM signal_val UNION ALL SELECT row_id, final_signal, city FROM signal_test")
def csv_glob(s, d):
    """Two tables written beside each other, default columns first, and read again by one glob."""
    at = _at(s, "glob")
    for name in ("signal_val", "signal_test"):
        files.write_extended(table(s, d, name).select("city", "final_signal", "row_id"), f"{at}/{name}", ["row_id"])
    back = files.typed(files.read_csv(s, f"{at}/*/*.csv", ["row_id", "city", "final_signal"]), row_id="bigint")
    return back.select("row_id", F.nullif("final_signal", F.lit("")).alias("final_signal"), F.nullif("city", F.lit("")).alias("city"))


@query("json_document", "SELECT city, tz_name FROM city_zones")
def json_document(s, d):
    """A small fixed table as one JSON document that holds an array, read again as rows."""
    at = f"{_at(s, 'document')}.json"
    zones = table(s, d, "city_zones").select("city", "tz_name")
    rows = zones.agg(F.to_json(F.collect_list(F.struct("city", "tz_name"))).alias("j")).first()["j"]  # one row a zone
    files.write_document(s, at, rows)
    return files.read_json_array(s, at, zones.schema)


@query("maps_search", "SELECT doc_id, 'https://www.google.com/maps/search/?api=1&query=' || replace(replace(replace(url_encode(place_name), '%20', '+'), '%2A', '*'), '~', '%7E') AS link FROM documents WHERE place_name IS NOT NULL")
def maps_search(s, d):
    from sparkloka.functions import text as T

    return table(s, d, "documents").filter("place_name IS NOT NULL").select("doc_id", T.maps_search_url(F.col("place_name")).alias("link"))

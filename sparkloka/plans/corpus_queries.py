"""Unions, dedupes, leaks, overrides and splits over the corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloka.functions import text as T
from sparkloka.operators import rows
from sparkloka.plans import sql_text as S
from sparkloka.plans.registry import query
from sparkloka.runtime import table

_COLS = ["text", "source", "platform", "url", "timestamp", "city", "area_hint", "business_hint", "query", "query_intent", "label_source", "existing_signal"]
_SIGNAL = {"weak_labeled": "signal", "signal_train": "final_signal", "signal_val": "final_signal", "signal_test": "final_signal", "airgap_corpus": "existing_signal"}
_HAS_LABEL_SOURCE = {"signal_train", "signal_val", "signal_test", "airgap_corpus"}


def corpus(s, d):
    """All labelled corpora as one, the label under one name, in order of precedence."""
    frames = {}
    for name, label in _SIGNAL.items():
        df = table(s, d, name).withColumn("existing_signal", F.col(label))
        frames[name] = df if name in _HAS_LABEL_SOURCE else df.drop("label_source")
    return rows.union_all(frames, _COLS, {"label_source": "weak"})


def _std(c: str, name: str) -> str:
    if c == "existing_signal":
        return f"trim(coalesce({_SIGNAL[name]}, '')) AS existing_signal"
    if c == "label_source" and name not in _HAS_LABEL_SOURCE:
        return "'weak' AS label_source"
    return f"trim(coalesce({c}, '{'weak' if c == 'label_source' else ''}')) AS {c}"


_CORPUS = " UNION ALL ".join(f"SELECT row_id, '{n}' AS corpus_source, {i} AS source_ord, {', '.join(_std(c, n) for c in _COLS)} FROM {n}" for i, n in enumerate(_SIGNAL))


@query("corpus_union", f"SELECT corpus_source, city, count(*) AS n, count(DISTINCT business_hint) AS n_businesses, sum(CASE WHEN existing_signal <> '' THEN 1 ELSE 0 END)::BIGINT AS n_labelled, sum(length(text))::BIGINT AS n_chars FROM ({_CORPUS}) GROUP BY 1, 2")
def corpus_union(s, d):
    return corpus(s, d).groupBy("corpus_source", "city").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("business_hint").alias("n_businesses"), F.count_if(F.col("existing_signal") != "").alias("n_labelled"), F.sum(F.length("text").cast("long")).alias("n_chars"))


_KEYED = f"SELECT row_id, corpus_source, source_ord, city, area_hint, {S.key('text')} AS key FROM ({_CORPUS}) WHERE length(text) > 8"


@query("dedupe_keep_first", f"SELECT row_id, corpus_source, city, area_hint, md5(key) AS key_digest FROM ({_KEYED}) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY city, area_hint, key ORDER BY source_ord, row_id) = 1")
def dedupe_keep_first(s, d):
    """The first row of each (city, area, key) in order of the sources."""
    k = corpus(s, d).filter(F.length("text") > 8).select("row_id", "corpus_source", "source_ord", "city", "area_hint", T.dedupe_key(F.col("text")).alias("key")).filter("key <> ''")
    return rows.keep_one(k.withColumn("key_digest", F.md5("key")).drop("key"), ["city", "area_hint", "key_digest"], [F.col("source_ord"), F.col("row_id")]).select("row_id", "corpus_source", "city", "area_hint", "key_digest")


@query("dedupe_keep_last", "SELECT text, row_id, timestamp FROM social_bootstrap WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id DESC) = 1")
def dedupe_keep_last(s, d):
    return rows.keep_one(table(s, d, "social_bootstrap").filter("text IS NOT NULL").select("text", "row_id", "timestamp"), ["text"], [-F.col("row_id")])


@query("dedupe_best", "SELECT text, row_id, signal, confidence FROM weak_labeled WHERE text IS NOT NULL AND length(text) > 10 QUALIFY row_number() OVER (PARTITION BY text ORDER BY confidence DESC NULLS LAST, row_id) = 1")
def dedupe_best(s, d):
    """The most confident row of each text."""
    w = table(s, d, "weak_labeled").filter("text IS NOT NULL AND length(text) > 10").select("text", "row_id", "signal", "confidence")
    return rows.keep_one(w, ["text"], [F.coalesce(-F.col("confidence"), F.lit(1e9)), F.col("row_id")])


@query("dup_clusters", f"SELECT md5(key) AS key_digest, count(*) AS n, min(row_id) AS first_row FROM (SELECT row_id, {S.key('text')} AS key FROM social_bootstrap) WHERE key <> '' GROUP BY key HAVING count(*) > 1")
def dup_clusters(s, d):
    k = table(s, d, "social_bootstrap").select("row_id", T.dedupe_key(F.col("text")).alias("key")).filter("key <> ''")
    return k.groupBy(F.md5("key").alias("key_digest")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")).filter("n > 1")


_FOLD = f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT row_id, hash(url) AS u, coalesce(url, '') = '' AS no_url, hash(key) AS t, row_number() OVER (ORDER BY row_id) AS i FROM (SELECT row_id, url, {S.key('text')} AS key FROM social_bootstrap) WHERE key <> ''),
f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS row_id, []::UBIGINT[] AS ts, []::UBIGINT[] AS us
  UNION ALL SELECT k.i, CASE WHEN keep THEN k.row_id END, CASE WHEN keep THEN list_append(ts, k.t) ELSE ts END, CASE WHEN keep AND NOT no_url THEN list_append(us, k.u) ELSE us END
  FROM (SELECT f.i AS at, ts, us, k.*, NOT (list_contains(ts, k.t) OR (NOT no_url AND list_contains(us, k.u))) AS keep FROM f JOIN k ON k.i = f.i + 1) k)
SELECT row_id FROM f WHERE row_id IS NOT NULL
"""


@query("two_key_dedupe", _FOLD)
def two_key_dedupe(s, d):
    """Rows in order, one dropped if a kept row before it has its text key or its address: the sequential rule."""
    k = table(s, d, "social_bootstrap").select("row_id", "url", T.dedupe_key(F.col("text")).alias("key")).filter("key <> ''").withColumn("key", F.md5("key"))
    return rows.fold_two_keys(k, "row_id", "key", "url").select("row_id")


@query("net_new", "SELECT row_id FROM signal_train t WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM weak_labeled w WHERE w.text = t.text)")
def net_new(s, d):
    return table(s, d, "signal_train").filter("text IS NOT NULL").select("row_id", "text").join(table(s, d, "weak_labeled").select("text").filter("text IS NOT NULL").distinct(), "text", "left_anti").select("row_id")


@query("existing_semi", f"SELECT row_id FROM (SELECT row_id, {S.key('text')} AS key FROM weak_labeled) WHERE key <> '' AND key IN (SELECT {S.key('text')} FROM airgap_corpus UNION ALL SELECT {S.key('text')} FROM signal_train)")
def existing_semi(s, d):
    key = lambda n: table(s, d, n).select("row_id", T.dedupe_key(F.col("text")).alias("key")).filter("key <> ''").select("row_id", F.md5("key").alias("key"))
    return key("weak_labeled").join(key("signal_train").select("key").unionByName(key("airgap_corpus").select("key")).distinct(), "key", "left_semi").select("row_id")


@query("leak_exact", "SELECT md5(text) AS digest FROM (SELECT text FROM signal_train WHERE text IS NOT NULL INTERSECT SELECT text FROM (SELECT text FROM signal_val UNION ALL SELECT text FROM signal_test))")
def leak_exact(s, d):
    held = table(s, d, "signal_val").select("text").unionByName(table(s, d, "signal_test").select("text"))
    return table(s, d, "signal_train").filter("text IS NOT NULL").select("text").intersect(held).select(F.md5("text").alias("digest"))


@query("label_override", "SELECT w.row_id, coalesce(t.final_signal, w.signal) AS signal, CASE WHEN t.final_signal IS NULL THEN 'weak' ELSE 'override' END AS label_source FROM weak_labeled w LEFT JOIN (SELECT text, final_signal FROM signal_train WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1) t ON w.text = t.text WHERE w.confidence >= 0.7 AND (w.signal <> 'NEUTRAL' OR w.confidence >= 0.85)")
def label_override(s, d):
    """Confident weak labels, replaced where the curated set has the same text."""
    over = rows.keep_one(table(s, d, "signal_train").filter("text IS NOT NULL").select("text", "row_id", "final_signal"), ["text"], [F.col("row_id")]).select("text", "final_signal")
    w = table(s, d, "weak_labeled").filter("confidence >= 0.7 AND (signal <> 'NEUTRAL' OR confidence >= 0.85)").select("row_id", "text", "signal")
    return w.join(over, "text", "left").select("row_id", F.coalesce("final_signal", "signal").alias("signal"), F.when(F.col("final_signal").isNull(), "weak").otherwise("override").alias("label_source"))


_STRAT = "SELECT row_id, final_signal, CASE WHEN total < 3 THEN 'train' WHEN r * 100 < 70 * total THEN 'train' WHEN r * 100 < 85 * total THEN 'validation' ELSE 'test' END AS split FROM (SELECT row_id, final_signal, row_number() OVER (PARTITION BY final_signal ORDER BY sha256(row_id::VARCHAR), row_id) - 1 AS r, count(*) OVER (PARTITION BY final_signal) AS total FROM signal_train WHERE final_signal IS NOT NULL)"


@query("stratified_split", _STRAT)
def stratified_split(s, d):
    return rows.hash_rank_split(table(s, d, "signal_train").filter("final_signal IS NOT NULL").select("row_id", "final_signal"), "final_signal", "row_id")


_CLAIM = "CASE lower(trim(coalesce(provenance_split, ''))) WHEN 'train' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'val' THEN 'validation' WHEN 'test' THEN 'test' ELSE '' END"


@query("split_label_matrix", "SELECT final_signal, " + ", ".join(f"sum(CASE WHEN claim = '{x}' THEN 1 ELSE 0 END)::BIGINT AS n_{x or 'none'}" for x in ("train", "validation", "test", "")) + f" FROM (SELECT final_signal, {_CLAIM} AS claim FROM signal_train WHERE final_signal IS NOT NULL) GROUP BY 1")
def split_label_matrix(s, d):
    p = F.lower(F.trim(F.coalesce("provenance_split", F.lit(""))))
    claim = F.when(p.isin("train", "test"), p).when(p.isin("validation", "val"), "validation").otherwise("none")
    out = table(s, d, "signal_train").filter("final_signal IS NOT NULL").select("final_signal", claim.alias("claim")).groupBy("final_signal").pivot("claim", ["train", "validation", "test", "none"])
    out = out.count().na.fill(0)
    return out.select("final_signal", *[F.col(x).alias(f"n_{x}") for x in ("train", "validation", "test", "none")])


@query("donor_move", "WITH a AS (SELECT row_id, city, CASE WHEN city = 'Jayapura' AND p = 'train' THEN 'validation' ELSE p END AS split FROM (SELECT row_id, city, CASE WHEN row_id % 10 < 8 THEN 'train' WHEN row_id % 10 < 9 THEN 'validation' ELSE 'test' END AS p FROM signal_train WHERE city IS NOT NULL)), l AS (SELECT city FROM a GROUP BY city HAVING sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) = 0), n AS (SELECT a.city, row_id FROM a JOIN l USING (city) QUALIFY row_number() OVER (PARTITION BY a.city ORDER BY CASE WHEN split = 'validation' THEN 0 ELSE 1 END, row_id) = 1) SELECT a.row_id, a.city, CASE WHEN n.row_id IS NOT NULL THEN 'train' ELSE split END AS split FROM a LEFT JOIN n ON a.row_id = n.row_id")
def donor_move(s, d):
    """A split in which one city has no training row gets one, from validation first."""
    r = F.col("row_id") % 10
    p = F.when(r < 8, "train").when(r < 9, "validation").otherwise("test")
    t = table(s, d, "signal_train").filter("city IS NOT NULL").select("row_id", "city", p.alias("split"))
    t = t.withColumn("split", F.when((F.col("city") == "Jayapura") & (F.col("split") == "train"), "validation").otherwise(F.col("split")))
    return rows.donate(t, "city", "row_id").select("row_id", "city", "split")


@query("gold_fill", "SELECT text, row_id, signal, coalesce(nullif(trim(original_label), ''), signal) AS gold_label FROM (SELECT * FROM weak_labeled WHERE text IS NOT NULL AND signal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY signal ORDER BY confidence DESC NULLS LAST, row_id) <= 40) QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1")
def gold_fill(s, d):
    """The review set: the most confident rows of each label, one a text, blanks filled with the suggestion."""
    w = table(s, d, "weak_labeled").filter("text IS NOT NULL AND signal IS NOT NULL").select("text", "row_id", "signal", "confidence", "original_label")
    top = rows.top_per(w, "signal", [F.desc_nulls_last("confidence"), F.col("row_id")], 40)
    one = rows.keep_one(top, ["text"], [F.col("row_id")])
    return one.select("text", "row_id", "signal", F.coalesce(F.nullif(F.trim("original_label"), F.lit("")), F.col("signal")).alias("gold_label"))


@query("seeded_sample", "SELECT row_id FROM social_bootstrap ORDER BY md5(row_id::VARCHAR || ':7'), row_id LIMIT 50")
def seeded_sample(s, d):
    """A sample of fixed size that is the same on every run: a sampling operator."""
    return table(s, d, "social_bootstrap").select("row_id").orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":7"))), "row_id").limit(50)


@query("eda_text", "SELECT coalesce(signal, '') AS signal, count(*) AS n, round(avg(length(text)), 4) AS mean_len, round(stddev_samp(length(text)), 4) AS std_len, round(avg(confidence), 6) AS mean_conf, round(stddev_samp(confidence), 6) AS std_conf, sum(CASE WHEN confidence >= 0.8 THEN 1 ELSE 0 END)::BIGINT AS n_high FROM weak_labeled GROUP BY 1")
def eda_text(s, d):
    return table(s, d, "weak_labeled").groupBy(F.coalesce("signal", F.lit("")).alias("signal")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_len"), F.round(F.stddev_samp(F.length("text")), 4).alias("std_len"), F.round(F.avg("confidence"), 6).alias("mean_conf"), F.round(F.stddev_samp("confidence"), 6).alias("std_conf"), F.count_if(F.col("confidence") >= 0.8).alias("n_high"))


@query("imbalance", "SELECT round(max(n) / min(n)::DOUBLE, 6) AS ratio, count(*) AS n_labels FROM (SELECT count(*) AS n FROM signal_train WHERE final_signal IS NOT NULL GROUP BY final_signal)")
def imbalance(s, d):
    g = table(s, d, "signal_train").filter("final_signal IS NOT NULL").groupBy("final_signal").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(F.max("n") / F.min("n"), 6).alias("ratio"), F.count(F.lit(1)).alias("n_labels"))


@query("platform_city", "SELECT platform, city, count(*) AS n, count(DISTINCT area_hint) AS n_areas FROM social_bootstrap WHERE platform IS NOT NULL AND city IS NOT NULL GROUP BY 1, 2")
def platform_city(s, d):
    return table(s, d, "social_bootstrap").filter("platform IS NOT NULL AND city IS NOT NULL").groupBy("platform", "city").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("area_hint").alias("n_areas"))


@query("admin_rollup", "SELECT r_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def admin_rollup(s, d):
    """Counts by the top of a four-level hierarchy. Lines are counted per order before anything is joined."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("o"), F.sum("n").alias("l"))
    geo = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = per.join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_customers"), F.sum("o").alias("n_orders"), F.sum("l").alias("n_lines"))


@query("json_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


_CHECKS = """
SELECT 'corpus_rows' AS name, (SELECT count(*) FROM weak_labeled) >= 150 AS passed
UNION ALL SELECT 'train_rows', (SELECT count(*) FROM signal_train) >= 300
UNION ALL SELECT 'labels_present', (SELECT count(DISTINCT final_signal) FROM signal_train) >= 7
UNION ALL SELECT 'least_per_label', (SELECT min(n) FROM (SELECT count(*) AS n FROM signal_train WHERE final_signal IS NOT NULL GROUP BY final_signal)) >= 8
UNION ALL SELECT 'no_exact_leak', (SELECT count(*) FROM (SELECT text FROM signal_train WHERE text IS NOT NULL INTERSECT SELECT text FROM signal_test)) = 0
UNION ALL SELECT 'groups', (SELECT count(*) FROM (SELECT 1 FROM signal_train WHERE city IS NOT NULL AND area_hint IS NOT NULL AND business_hint IS NOT NULL GROUP BY city, area_hint, business_hint HAVING count(*) >= 3)) >= 5
"""


@query("readiness", f"WITH c AS ({_CHECKS}) SELECT name, passed, bool_and(passed) OVER () AS ready FROM c")
def readiness(s, d):
    """The data gates: one aggregate each, and whether all passed."""
    from pyspark.sql.window import Window

    t = table(s, d, "signal_train")
    one = lambda name, df, cond: df.select(F.lit(name).alias("name"), cond.alias("passed"))
    per = t.filter("final_signal IS NOT NULL").groupBy("final_signal").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        one("corpus_rows", table(s, d, "weak_labeled").agg(F.count(F.lit(1)).alias("n")), F.col("n") >= 150),
        one("train_rows", t.agg(F.count(F.lit(1)).alias("n")), F.col("n") >= 300),
        one("labels_present", per.agg(F.count(F.lit(1)).alias("n")), F.col("n") >= 7),
        one("least_per_label", per.agg(F.min("n").alias("n")), F.col("n") >= 8),
        one("no_exact_leak", t.filter("text IS NOT NULL").select("text").intersect(table(s, d, "signal_test").select("text")).agg(F.count(F.lit(1)).alias("n")), F.col("n") == 0),
        one("groups", t.dropna(subset=["city", "area_hint", "business_hint"]).groupBy("city", "area_hint", "business_hint").agg(F.count(F.lit(1)).alias("m")).filter("m >= 3").agg(F.count(F.lit(1)).alias("n")), F.col("n") >= 5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ready", F.bool_and("passed").over(Window.partitionBy()))  # six rows

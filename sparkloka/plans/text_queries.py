"""Text functions over the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloka.functions import text as T
from sparkloka.operators.rows import keep_one
from sparkloka.plans import sql_text as S
from sparkloka.plans.registry import query
from sparkloka.runtime import table


@query("clean_text", f"SELECT row_id, md5(c) AS digest, length(c)::BIGINT AS n FROM (SELECT row_id, {S.clean('raw_text')} AS c FROM social_bootstrap)")
def clean_text(s, d):
    return table(s, d, "social_bootstrap").select("row_id", T.clean_text(F.col("raw_text")).alias("c")).select("row_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n"))


@query("normalize_text", f"SELECT row_id, {S.normal('text')} AS normal FROM weak_labeled")
def normalize_text(s, d):
    return table(s, d, "weak_labeled").select("row_id", T.normalize_text(F.col("text")).alias("normal"))


@query("dedupe_key", f"SELECT doc_id, md5({S.key('text')}) AS key_digest FROM documents")
def dedupe_key(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.dedupe_key(F.col("text"))).alias("key_digest"))


@query("hashtags", rf"SELECT row_id, u.p::BIGINT AS pos, u.t AS tag FROM (SELECT row_id, unnest(list_transform(t, lambda x, i: {{'p': i, 't': x}})) AS u FROM (SELECT row_id, list_filter(list_transform(a, lambda x, i: CASE WHEN list_position(a, x) = i THEN x END), lambda x: x IS NOT NULL) AS t FROM (SELECT row_id, regexp_extract_all(lower(coalesce(raw_text, '')), '#({S.W}+)', 1) AS a FROM social_bootstrap)))")
def hashtags(s, d):
    return table(s, d, "social_bootstrap").select("row_id", F.posexplode(T.hashtags(F.col("raw_text"))).alias("i", "tag")).select("row_id", (F.col("i") + 1).cast("long").alias("pos"), "tag")


@query("tokens_count", rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{S.W}+|[^\p{{L}}\p{{N}}_\s]'))::BIGINT AS n_tokens FROM documents")
def tokens_count(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


_CHARS = r"SELECT row_id, text, i, regexp_matches(substr(text, i, 1), '[\p{L}\p{N}_]') AS w, regexp_matches(substr(text, i, 1), '\s') AS b FROM (SELECT row_id, text, unnest(generate_series(1, length(text))) AS i FROM weak_labeled WHERE text IS NOT NULL)"
_RUNS = f"SELECT *, sum(CASE WHEN NOT b AND NOT (w AND coalesce(pw, FALSE)) THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS g FROM (SELECT *, lag(w) OVER (PARTITION BY row_id ORDER BY i) AS pw FROM ({_CHARS}))"


@query("token_offsets", f"SELECT row_id, substr(any_value(text), min(i), max(i) - min(i) + 1) AS token, min(i)::BIGINT - 1 AS start, max(i)::BIGINT AS stop FROM ({_RUNS}) WHERE NOT b GROUP BY row_id, g")
def token_offsets(s, d):
    """Tokens with their places, folded over the array."""
    rows = table(s, d, "weak_labeled").filter("text IS NOT NULL").select("row_id", F.explode(T.offsets(F.col("text"))).alias("t"))
    return rows.select("row_id", "t.token", F.col("t.start").cast("long").alias("start"), F.col("t.stop").cast("long").alias("stop"))


_SC = S.scores(S.normal("text"))
_CLASS = "CASE WHEN n_id + n_slang = 0 AND n_en = 0 THEN 'unclear' WHEN n_id + n_slang >= n_en THEN 'indonesian_dominant' ELSE 'english_dominant' END"
_IS = "n_tokens >= 3 AND ((n_id + n_slang >= 3 AND n_id + n_slang >= n_en) OR (n_id + n_slang >= 2 AND n_en <= n_id + n_slang + 1) OR (n_id + n_slang >= 1 AND n_slang >= 1 AND n_en <= 2))"
_IS_STRICT = "n_tokens >= 3 AND ((n_id + n_slang >= 3 AND n_id + n_slang >= n_en) OR (n_id + n_slang >= 2 AND n_id + n_slang > n_en))"
_SCORED = f"SELECT row_id, source, {_SC['id']} AS n_id, {_SC['en']} AS n_en, {_SC['slang']} AS n_slang, {_SC['tokens']} AS n_tokens FROM weak_labeled"


def _scored(s, d):
    df = table(s, d, "weak_labeled").select("row_id", "source", T.normalize_text(F.col("text")).alias("normal"))
    sc = T.language_scores(F.col("normal"))
    return df.select("row_id", "source", *[v.alias(f"n_{k}") for k, v in sc.items()])


def _cols():
    return {k: F.col(f"n_{k}") for k in ("id", "en", "slang", "tokens")}


@query("language_scores", f"SELECT row_id, n_id::BIGINT AS n_id, n_en::BIGINT AS n_en, n_slang::BIGINT AS n_slang, n_tokens::BIGINT AS n_tokens, {_CLASS} AS class, ({_IS}) AS loose, ({_IS_STRICT}) AS strict FROM ({_SCORED})")
def language_scores(s, d):
    return _scored(s, d).select("row_id", *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in ("id", "en", "slang", "tokens")], T.language_class(_cols()).alias("class"), T.is_indonesian(_cols()).alias("loose"), T.is_indonesian(_cols(), True).alias("strict"))


@query("language_mix", f"SELECT coalesce(source, '') AS source, count(*)::BIGINT AS n, sum(CASE WHEN class = 'indonesian_dominant' THEN 1 ELSE 0 END)::BIGINT AS n_id, sum(CASE WHEN class = 'english_dominant' THEN 1 ELSE 0 END)::BIGINT AS n_en, sum(CASE WHEN class = 'unclear' THEN 1 ELSE 0 END)::BIGINT AS n_unclear FROM (SELECT source, {_CLASS} AS class FROM ({_SCORED})) GROUP BY 1")
def language_mix(s, d):
    c = _scored(s, d).select(F.coalesce("source", F.lit("")).alias("source"), T.language_class(_cols()).alias("class"))
    n = lambda x: F.count_if(F.col("class") == x)
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"), n("indonesian_dominant").alias("n_id"), n("english_dominant").alias("n_en"), n("unclear").alias("n_unclear"))


def _pii_sql(t: str) -> str:
    for pattern, to in T.PII:
        t = S.rep(t, pattern, to.replace("$1", r"\1"))
    return t


@query("pii_redact", f"SELECT doc_id, md5(r) AS digest, (len(r) - len(replace(r, '_REDACTED]', '')))::BIGINT // 10 AS n_redacted FROM (SELECT doc_id, coalesce({_pii_sql('text')}, '') AS r FROM documents)")
def pii_redact(s, d):
    r = table(s, d, "documents").select("doc_id", F.coalesce(T.redact(F.col("text")), F.lit("")).alias("r"))
    return r.select("doc_id", F.md5("r").alias("digest"), F.expr("(length(r) - length(replace(r, '_REDACTED]', ''))) div 10").alias("n_redacted"))


_PARTS = f"list_filter(list_transform(string_split({S.rep('raw', r'([.!?])\s+', r'\1' + chr(10))}, chr(10)), lambda p: trim(p)), lambda p: p <> '')"
_CAND = f"""
WITH r AS (SELECT row_id, {S.strip_emoji('text')} AS raw FROM signal_train),
p AS (SELECT row_id, raw, {_PARTS} AS parts FROM r),
w AS (SELECT row_id, 0 AS i, 0 AS j, raw AS piece FROM p WHERE length({S.normal('raw')}) <= 220),
s AS (SELECT row_id, unnest(list_transform(parts, lambda x, i: {{'i': i, 'x': x}})) AS u FROM p),
c AS (SELECT row_id, u.i AS i, unnest(list_transform(string_split(regexp_replace(u.x, '\\s*[;,]\\s+', chr(10), 'g'), chr(10)), lambda x, j: {{'j': j, 'x': x}})) AS v FROM s WHERE length(u.x) > 160),
a AS (SELECT * FROM w UNION ALL SELECT row_id, u.i, 0, u.x FROM s UNION ALL SELECT row_id, i, v.j, v.x FROM c),
n AS (SELECT row_id, i, j, {S.normal('piece')} AS cand FROM a),
k AS (SELECT row_id, i, j, cand, {S.squeeze(S.rep('cand', r'[^a-z0-9_\s]', ' '))} AS key FROM n WHERE length(cand) BETWEEN 12 AND 240 AND len(string_split(cand, ' ')) BETWEEN 3 AND 48),
f AS (SELECT row_id, i, j, cand FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY row_id, key ORDER BY i, j) = 1),
g AS (SELECT row_id, cand, row_number() OVER (PARTITION BY row_id ORDER BY i, j) AS pos FROM f)
SELECT row_id, pos::BIGINT AS pos, cand FROM g WHERE pos <= 8
"""


@query("text_candidates", _CAND.replace("\\\\", "\\"))
def text_candidates(s, d):
    return table(s, d, "signal_train").select("row_id", F.posexplode(T.candidates(F.col("text"))).alias("i", "cand")).select("row_id", (F.col("i") + 1).cast("long").alias("pos"), "cand")


_STRICT = f"({_IS_STRICT})"
_RAW = "CASE WHEN coalesce(raw_text, '') <> '' THEN raw_text ELSE coalesce(text, '') END"
_LIVE_CAND = _CAND.replace(f"SELECT row_id, {S.strip_emoji('text')} AS raw FROM signal_train", f"SELECT row_id, {S.strip_emoji(_RAW)} AS raw FROM social_bootstrap").replace("\\\\", "\\")
_CHUNKS = rf"string_split(regexp_replace(regexp_replace({_RAW}, '[\n\r]+|,\s+', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_LIVE = f"""
WITH cand AS ({_LIVE_CAND}),
chunk AS (SELECT row_id, unnest(list_transform({_CHUNKS}, lambda x, i: {{'i': i, 'x': x}})) AS u FROM social_bootstrap),
more AS (SELECT row_id, 100 + u.i AS i, {S.normal('u.x')} AS cand FROM chunk),
made AS (SELECT row_id, pos AS i, cand FROM cand UNION ALL SELECT row_id, i, cand FROM more WHERE length(cand) BETWEEN 8 AND 180),
every AS (SELECT * FROM made UNION ALL SELECT row_id, 0, {S.normal('text')} FROM social_bootstrap WHERE row_id NOT IN (SELECT row_id FROM made)),
placed AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS k, cand AS normal FROM every WHERE cand <> ''),
scored AS (SELECT row_id, k, normal, {', '.join(f'{v} AS n_{n}' for n, v in S.scores('normal').items())} FROM placed),
first AS (SELECT row_id, k, normal FROM scored WHERE {_STRICT} QUALIFY row_number() OVER (PARTITION BY {S.squeeze(S.rep('normal', r'[^a-z0-9_\s]', ' '))} ORDER BY row_id, k) = 1)
SELECT row_id, k::BIGINT AS candidate_index, normal AS text, CASE WHEN trim(coalesce(content_id, '')) <> '' THEN trim(content_id) || ':' || k ELSE k::VARCHAR END AS content_id, city FROM first JOIN social_bootstrap USING (row_id)
"""


@query("live_expand", _LIVE)
def live_expand(s, d):
    """Posts as rows of their candidates in strictly Indonesian words, each with an id of its own; the first of each
    dedupe key in order of the rows. Keys are compared by digest and only winners carry their fields on."""
    t = table(s, d, "social_bootstrap").select("row_id", "content_id", "city", T.live_candidates(F.col("raw_text"), F.col("text")).alias("c"))
    t = t.select("row_id", "content_id", "city", F.posexplode("c").alias("i", "normal"))
    own = T.language_scores(F.col("normal"))
    t = t.withColumns({f"n_{k}": v for k, v in own.items()}).filter(T.is_indonesian(_cols(), True))
    t = t.select("row_id", F.col("i").cast("long").alias("candidate_index"), F.col("normal").alias("text"), "content_id", "city", F.md5(T.key_of_normal(F.col("normal"))).alias("key"))
    one = keep_one(t, ["key"], [F.col("row_id"), F.col("candidate_index")])
    cid = F.trim(F.coalesce("content_id", F.lit("")))
    return one.select("row_id", "candidate_index", "text", F.when(cid != "", F.concat_ws(":", cid, "candidate_index")).otherwise(F.col("candidate_index").cast("string")).alias("content_id"), "city")


_SPLIT = "CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 100 < 90 THEN 'validation' ELSE 'test' END"


@query("stable_split", f"SELECT row_id, {_SPLIT} AS split FROM social_bootstrap WHERE text IS NOT NULL")
def stable_split(s, d):
    return table(s, d, "social_bootstrap").filter("text IS NOT NULL").select("row_id", T.stable_split(F.col("text")).alias("split"))


_URL0 = "trim(coalesce(url, ''))"
_URL1 = f"CASE WHEN {_URL0} = '' THEN '' WHEN starts_with({_URL0}, '//') THEN 'https:' || {_URL0} WHEN NOT regexp_matches({_URL0}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'https://' || {_URL0} ELSE {_URL0} END"
_URLSQL = "lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1)), '^(m|mobile)\\.', '') || regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1), '/+$', '')"
_URLS = f"SELECT row_id, CASE WHEN u = '' THEN '' ELSE {_URLSQL} END AS canonical FROM (SELECT row_id, regexp_replace({_URL1}, '[?#].*$', '') AS u FROM social_bootstrap)"


@query("url_canonical", _URLS)
def url_canonical(s, d):
    return table(s, d, "social_bootstrap").select("row_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("url_dedupe", f"SELECT canonical, min(row_id) AS first_row, count(*)::BIGINT AS n FROM ({_URLS}) WHERE canonical <> '' GROUP BY 1 HAVING count(*) > 1")
def url_dedupe(s, d):
    return url_canonical(s, d).filter("canonical <> ''").groupBy("canonical").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("unix_to_iso", r"SELECT row_id, CASE WHEN timestamp IS NULL OR timestamp = '' THEN '' WHEN NOT regexp_matches(timestamp, '^\d+$') THEN timestamp WHEN try_cast(timestamp AS BIGINT) IS NULL OR try_cast(timestamp AS BIGINT) <= 0 OR try_cast(timestamp AS BIGINT) > 253402300799 THEN '' ELSE strftime(make_timestamp(try_cast(timestamp AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM social_bootstrap")
def unix_to_iso(s, d):
    return table(s, d, "social_bootstrap").select("row_id", T.unix_to_iso(F.col("timestamp")).alias("iso"))


@query("url_captures", r"SELECT row_id, regexp_extract(lower(coalesce(url, '')), '/@([^/?#]+)', 1) AS author_in_url, regexp_extract(coalesce(url, ''), '/(?:video|status)/(\d+)', 1) AS item_id, regexp_extract(coalesce(url, ''), '/p/([A-Za-z0-9_-]+)', 1) AS post_code FROM social_bootstrap")
def url_captures(s, d):
    u = F.coalesce("url", F.lit(""))
    return table(s, d, "social_bootstrap").select("row_id", F.regexp_extract(F.lower(u), "/@([^/?#]+)", 1).alias("author_in_url"), F.regexp_extract(u, r"/(?:video|status)/(\d+)", 1).alias("item_id"), F.regexp_extract(u, "/p/([A-Za-z0-9_-]+)", 1).alias("post_code"))


@query("counters", "SELECT row_id, try_cast(trim(likes) AS DOUBLE) AS likes, try_cast(trim(comments) AS DOUBLE) AS comments, try_cast(trim(views) AS DOUBLE) AS views FROM social_bootstrap WHERE regexp_matches(trim(coalesce(likes, '')), '^[0-9]+$')")
def counters(s, d):
    """Numeric strings coerced, other values null; rows whose likes are a plain number."""
    n = lambda c: F.trim(c).try_cast("double").alias(c)
    return table(s, d, "social_bootstrap").filter(F.trim("likes").rlike("^[0-9]+$")).select("row_id", n("likes"), n("comments"), n("views"))

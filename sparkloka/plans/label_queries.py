"""Weak labels, self-training quotas, complaint gate, evaluation of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloka.constants import COMPLAINT_PATTERNS, COMPLAINT_TOPICS, COMPLAINTS, LABELS, OTHER_TOPICS, POOL_PRIORITY, PRAISE, PRIORITY, RELEVANT_WORDS, RULES, SELF_TRAINING
from sparkloka.functions import text as T
from sparkloka.operators import evaluation, pool, rules
from sparkloka.operators.rows import top_per
from sparkloka.plans import sql_text as S
from sparkloka.plans.registry import query
from sparkloka.runtime import table


def _rule_sql(source: str) -> str:
    t, c = "lower(coalesce(text, ''))", "lower(coalesce(query, ''))"
    parts = []
    for name, rule in RULES.items():
        words = rule["keywords"].split("|")
        hits = [f"CASE WHEN {S.contains_word('t', w)} THEN '{w}'" + (f" WHEN {S.contains_word('c', w)} THEN 'query:{w}'" if rule["context"] else "") + " END" for w in words]
        if name == "COMPLAINT":
            hits += [f"CASE WHEN regexp_matches(t, '{p}') THEN 'regex:{p}' END" for p, _ in COMPLAINT_PATTERNS]
        veto = " OR ".join(S.contains_word("t", v) for v in rule["vetoes"].split("|") if v) or "FALSE"
        parts.append(f"SELECT row_id, '{name}' AS label, {PRIORITY[name]} AS p, CASE WHEN {veto} THEN [] ELSE list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) END AS h FROM b")
    worth = "CASE WHEN starts_with(x, 'query:') THEN 0.75::DOUBLE " + " ".join(f"WHEN x = 'regex:{p}' THEN {w}::DOUBLE" for p, w in COMPLAINT_PATTERNS) + " ELSE 1 END"
    kind = "CASE WHEN starts_with(x, 'query:') THEN 1 WHEN starts_with(x, 'regex:') THEN 2 ELSE 0 END"
    return f"""WITH b AS (SELECT row_id, {t} AS t, {c} AS c FROM {source}), a AS ({' UNION ALL '.join(parts)}),
s AS (SELECT row_id, label, p, h, coalesce(list_sum(list_transform(h, lambda x: {worth})), 0) AS s FROM a),
m AS (SELECT row_id, label, s, list_concat(list_filter(h, lambda x: {kind} = 0), list_concat(list_filter(h, lambda x: {kind} = 1), list_filter(h, lambda x: {kind} = 2))) AS h FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC, p DESC) = 1)
SELECT row_id, CASE WHEN s > 0 THEN label ELSE 'NEUTRAL' END AS label, CASE WHEN s >= 2.5 THEN 1.0::DOUBLE WHEN s >= 1.5 THEN 0.8::DOUBLE WHEN s > 0 THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS confidence, s::DOUBLE AS score, array_to_string(h, '|') AS matched FROM m"""


_WEAK = _rule_sql("weak_labeled")


def labelled(s, d, *more, name="weak_labeled"):
    return rules.label(table(s, d, name).select("row_id", "text", "query", *more), "text", "query")


@query("weak_label", _WEAK)
def weak_label(s, d):
    return labelled(s, d).select("row_id", "label", "confidence", "score", F.array_join("matched", "|").alias("matched"))


@query("rule_distribution", f"SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct, round(avg(CASE WHEN confidence >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS high_rate FROM ({_WEAK}) GROUP BY 1")
def rule_distribution(s, d):
    from pyspark.sql.window import Window

    g = weak_label(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("confidence") >= 0.8).cast("double")), 6).alias("high_rate"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))  # one row a label


_QUOTA = "CASE label " + " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in SELF_TRAINING.items()) + " ELSE 0 END"


@query("max_keep", f"SELECT row_id, label, rank_in_group::BIGINT AS rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, score DESC, row_id) AS rank_in_group FROM ({_WEAK}) WHERE label <> 'NEUTRAL') WHERE rank_in_group <= {_QUOTA}")
def max_keep(s, d):
    """The best rows of each rule label up to its limit: the cap alone, over plain rule labels. No model is asked; ``pseudolabel`` is the self-training step."""
    most = F.create_map(*[F.lit(x) for k, v in SELF_TRAINING.items() for x in (k, v[3])])
    top = top_per(weak_label(s, d).filter("label <> 'NEUTRAL'"), "label", [F.desc("confidence"), F.desc("score"), F.col("row_id")], max(v[3] for v in SELF_TRAINING.values()))
    return top.filter(F.col("rank_in_group") <= most[F.col("label")]).select("row_id", "label", F.col("rank_in_group").cast("long").alias("rank_in_group"))


@query("pseudolabel")
def pseudolabel(s, d):
    """The self-training step on weak_labeled: candidates by hint label, scored by the classifier, kept where both agree
    and confidence and margin reach the limits, then capped. No SQL twin: the classifier is trained."""
    from sparkloka.operators import learning

    known = table(s, d, "signal_train").select("text").unionByName(table(s, d, "signal_val").select("text")).unionByName(table(s, d, "signal_test").select("text"))
    return learning.pseudolabels(table(s, d, "signal_train"), table(s, d, "weak_labeled"), known)


_N = S.normal("text")
_CSQL = " + ".join([f"(CASE WHEN contains(n, '{w}') THEN 2 ELSE 0 END)" for w in COMPLAINTS] + [f"(CASE WHEN contains(n, '{w}') THEN -1 ELSE 0 END)" for w in PRAISE] + [f"(CASE WHEN {x} <> '' AND contains(n, {x}) THEN 1 ELSE 0 END)" for x in ("b", "c", "a")])
_HAS = " OR ".join(f"contains(n, '{w}')" for w in COMPLAINTS)


@query("complaint_gate", f"SELECT row_id, CASE WHEN n = '' THEN 0 ELSE {_CSQL} END::BIGINT AS score, (coalesce(lower(trim(query_intent)), '') <> 'complaint' OR (({_HAS}) AND CASE WHEN n = '' THEN 0 ELSE {_CSQL} END >= 2)) AS relevant FROM (SELECT row_id, query_intent, {_N} AS n, {S.normal('business_hint')} AS b, {S.normal('city')} AS c, {S.normal('area_hint')} AS a FROM social_bootstrap)")
def complaint_gate(s, d):
    t = table(s, d, "social_bootstrap").select("row_id", "query_intent", *[T.normalize_text(F.col(c)).alias(n) for c, n in (("text", "n"), ("business_hint", "b"), ("city", "c"), ("area_hint", "a"))])
    t = t.withColumn("score", rules.complaint_score(F.col("n"), F.col("b"), F.col("c"), F.col("a")).cast("long"))
    return t.select("row_id", "score", ((F.coalesce(F.lower(F.trim("query_intent")), F.lit("")) != "complaint") | (rules.has_complaint(F.col("n")) & (F.col("score") >= 2))).alias("relevant"))


_PAIRS = f"SELECT w.signal AS truth, l.label AS guess FROM weak_labeled w JOIN ({_WEAK}) l USING (row_id) WHERE w.signal IS NOT NULL"
_LAB = ", ".join(f"('{x}')" for x in LABELS)
_REPORT = f"""
WITH p AS ({_PAIRS}), l AS (SELECT * FROM (VALUES {_LAB}) AS v(label)),
c AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label AND guess = label) AS tp, (SELECT count(*) FROM p WHERE truth <> label AND guess = label) AS fp, (SELECT count(*) FROM p WHERE truth = label AND guess <> label) AS fn FROM l),
r AS (SELECT label, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS prec, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS recall FROM c)
SELECT label, support, round(prec, 6) AS prec, round(recall, 6) AS recall, round(CASE WHEN prec + recall = 0 THEN 0 ELSE 2 * prec * recall / (prec + recall) END, 6)::DOUBLE AS f1 FROM r
"""


def pairs(s, d):
    """The label that arrived with a record and the rule book's, read in one pass."""
    return labelled(s, d, "signal").filter("signal IS NOT NULL").select(F.col("signal").alias("truth"), F.col("label").alias("guess"))


@query("class_report", _REPORT)
def class_report(s, d):
    return evaluation.class_report(pairs(s, d), LABELS)


@query("report_summary", f"WITH r AS ({_REPORT}) SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(recall * support) / sum(support), 6) AS accuracy FROM r")
def report_summary(s, d):
    r = class_report(s, d)
    return r.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"), F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 6).alias("accuracy"))


@query("confusion", f"WITH p AS ({_PAIRS}) SELECT truth, " + ", ".join(f"sum(CASE WHEN guess = '{x}' THEN 1 ELSE 0 END)::BIGINT AS \"{x}\"" for x in LABELS) + " FROM p GROUP BY 1")
def confusion(s, d):
    return evaluation.confusion(pairs(s, d), LABELS)


@query("class_weights", "SELECT final_signal, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM signal_train WHERE final_signal IS NOT NULL GROUP BY 1")
def class_weights(s, d):
    return evaluation.class_weights(table(s, d, "signal_train"), "final_signal")


_REL = " + ".join(f"(CASE WHEN contains(n, '{w}') THEN {k} ELSE 0 END)" for words, k in ((pool.MARKET, 2), (pool.PLACES, 1), (RELEVANT_WORDS, 1)) for w in words)
_PRIO = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in POOL_PRIORITY.items()) + " ELSE 0 END"
_POOL = f"""
WITH k AS (SELECT row_id, coalesce(source, '') AS source, {S.normal('text')} AS n FROM weak_labeled WHERE coalesce(confidence, 0) < 0.95 OR coalesce(signal, '') IN ('NEUTRAL', 'COMPLAINT', 'COMPETITION_HIGH')),
c AS (SELECT *, {S.squeeze(S.rep('n', r'[^a-z0-9_\s]', ' '))} AS key FROM k),
o AS (SELECT row_id, source, n, ({_REL})::BIGINT AS relevance FROM c WHERE key <> '' AND key NOT IN (SELECT {S.key('text')} FROM signal_train) QUALIFY row_number() OVER (PARTITION BY key ORDER BY row_id) = 1)
SELECT row_id, source, relevance, CASE WHEN length(n) <= 420 THEN n WHEN contains(substr(n, 1, 420), ' ') THEN trim(regexp_replace(substr(n, 1, 420), ' [^ ]*$', '')) ELSE substr(n, 1, 420) END AS prompt FROM o ORDER BY {_PRIO} DESC, relevance DESC, sha256(n), row_id LIMIT 800
"""


@query("pool_mining", _POOL)
def pool_mining(s, d):
    """The 800 texts that a labelling model would be asked first, of those not in the curated set: a budget."""
    w = table(s, d, "weak_labeled").select("row_id", "text", "source", "confidence", F.col("signal").alias("label"))
    return pool.candidates(w, "augment", 800, table(s, d, "signal_train").select("text"))


@query("pool_modes", "SELECT mode, count(*) AS n FROM (SELECT unnest(['refine', 'label_all', CASE WHEN coalesce(confidence, 0) < 0.8 OR signal = 'NEUTRAL' THEN 'low_confidence' END, CASE WHEN coalesce(confidence, 0) < 0.95 OR signal IN ('NEUTRAL', 'COMPLAINT', 'COMPETITION_HIGH') THEN 'augment' END]) AS mode FROM weak_labeled) WHERE mode IS NOT NULL GROUP BY 1")
def pool_modes(s, d):
    """How many rows each mode of selection looks at."""
    modes = [F.when(pool.selected(m, F.col("confidence"), F.col("signal")), m) for m in ("refine", "label_all", "low_confidence", "augment")]
    return table(s, d, "weak_labeled").select(F.explode(F.array_compact(F.array(*modes))).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


_LANG = S.scores("n")
_LOOSE = "n_tokens >= 3 AND ((n_id + n_slang >= 3 AND n_id + n_slang >= n_en) OR (n_id + n_slang >= 2 AND n_en <= n_id + n_slang + 1) OR (n_id + n_slang >= 1 AND n_slang >= 1 AND n_en <= 2))"


@query("negative_corpus", f"SELECT row_id, n AS text FROM (SELECT row_id, n, {', '.join(f'{v} AS n_{k}' for k, v in _LANG.items())} FROM (SELECT row_id, {S.normal('text')} AS n FROM weak_labeled WHERE signal = 'COMPLAINT' AND length(trim(text)) > 15)) WHERE {_LOOSE} AND NOT regexp_matches(n, '{'|'.join(OTHER_TOPICS)}') AND regexp_matches(n, '{'|'.join(COMPLAINT_TOPICS)}')")
def negative_corpus(s, d):
    """Negative texts that speak of food and service."""
    return pool.complaints(table(s, d, "weak_labeled"), "signal", ["complaint"])


@query("hint_quota")
def hint_quota(s, d):
    """Candidates for self-training by hint label, the best of each up to its quota. No SQL twin: tested by hand-made
    candidates."""
    from sparkloka.operators import learning

    known = table(s, d, "signal_train").select("text").unionByName(table(s, d, "signal_val").select("text")).unionByName(table(s, d, "signal_test").select("text"))
    return learning.hinted(table(s, d, "weak_labeled"), known).select("row_id", F.col("pos").cast("long").alias("pos"), "text", "hint", "score")


@query("lr_classifier")
def lr_classifier(s, d):
    """Predictions of a logistic regression on hashed words for signal_test: no SQL twin, held-out accuracy is tested."""
    from sparkloka.operators import learning

    return learning.predict(learning.fit(table(s, d, "signal_train")), table(s, d, "signal_test"))


@query("lime_top3")
def lime_top3(s, d):
    """The three words of each signal_test record that move the classifier's probability of its predicted label most:
    no SQL twin; the masked texts' probabilities are tested against the classifier."""
    from sparkloka.operators import learning

    return learning.explain(table(s, d, "signal_test"), learning.fit(table(s, d, "signal_train")))

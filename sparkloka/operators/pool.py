"""Texts chosen for labelling: by mode, relevance and source, cut to what a prompt holds; complaints of other corpora.

Defined results: null texts count as empty and are left out; null confidence counts as 0; repeated texts (by dedupe key)
count once, the first in order; ties come by the text's hash and the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloka.constants import BUSINESSES, CITIES, COMPLAINT_TOPICS, MARKET_HINTS, OTHER_TOPICS, POOL_PRIORITY, PROMPT_CHARS, RELEVANT_WORDS
from sparkloka.functions import text as T
from sparkloka.operators.rows import keep_one

MARKET = list(dict.fromkeys([*BUSINESSES, *MARKET_HINTS]))
PLACES = list(dict.fromkeys([c.lower() for c in CITIES] + [a.lower() for areas in CITIES.values() for a in areas]))


def relevance(normal: Column) -> Column:
    """2 for each market hint, 1 for each place, 1 for each of ten words that a normalised text holds."""
    score = F.lit(0)
    for words, weight in ((MARKET, 2), (PLACES, 1), (RELEVANT_WORDS, 1)):
        for w in words:
            score = score + F.when(F.contains(normal, F.lit(w)), weight).otherwise(0)
    return score


def selected(mode: str, confidence: Column, label: Column) -> Column:
    """Whether a weakly labelled row is looked at again: ``refine`` and ``label_all`` take all, ``low_confidence`` what is
    unsure or neutral, ``augment`` what is not very sure or of a label that is often wrong."""
    c, s = F.coalesce(confidence, F.lit(0.0)), F.coalesce(label, F.lit(""))
    rules = {"refine": F.lit(True), "label_all": F.lit(True), "low_confidence": (c < 0.8) | (s == "NEUTRAL"), "augment": (c < 0.95) | s.isin("NEUTRAL", "COMPLAINT", "COMPETITION_HIGH")}
    return rules[mode]


def prompt(text: Column, most: int = PROMPT_CHARS) -> Column:
    """A text as a prompt holds it: at most so many characters, cut at a word's end."""
    t = F.trim(text)
    cut = F.substring(t, 1, most)
    return F.when(F.length(t) <= most, t).otherwise(F.trim(F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)))


def candidates(rows: DataFrame, mode: str, most: int, known: DataFrame | None = None) -> DataFrame:
    """(row_id, source, relevance, prompt) of the ``most`` texts first in line: a budget of questions.

    rows: row_id, text, source, confidence, label. Texts whose key is among ``known`` (text) are left out."""
    n = rows.filter(selected(mode, F.col("confidence"), F.col("label"))).select("row_id", F.coalesce("source", F.lit("")).alias("source"), T.normalize_text(F.col("text")).alias("normal")).filter("normal <> ''")
    keyed = n.select("*", T.key_of_normal(F.col("normal")).alias("key")).filter("key <> ''").withColumn("key", F.md5("key"))
    one = keep_one(keyed, ["key"], [F.col("row_id")])
    if known is not None:
        one = one.join(known.select(T.dedupe_key(F.col("text")).alias("key")).filter("key <> ''").select(F.md5("key").alias("key")).distinct(), "key", "left_anti")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in POOL_PRIORITY.items() for x in kv]), F.col("source")), F.lit(0))
    scored = one.withColumn("relevance", relevance(F.col("normal")).cast("long"))
    return scored.orderBy(rank.desc(), F.desc("relevance"), F.sha2("normal", 256), "row_id").limit(most).select("row_id", "source", "relevance", prompt(F.col("normal")).alias("prompt"))


def complaints(rows: DataFrame, label: str, negative: Sequence[str]) -> DataFrame:
    """(row_id, text): normalised texts of negative labels, longer than 15 characters, probably Indonesian, about food and
    service and nothing else."""
    n = rows.filter(F.lower(F.trim(F.col(label))).isin(list(negative)) & (F.length(F.trim("text")) > 15)).select("row_id", T.normalize_text(F.col("text")).alias("text"))
    holds = lambda words: F.col("text").rlike("|".join(words))
    return n.filter(T.is_indonesian(T.language_scores(F.col("text"))) & ~holds(OTHER_TOPICS) & holds(COMPLAINT_TOPICS))

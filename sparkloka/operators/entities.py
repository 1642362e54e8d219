"""BIO tags and entity spans over token arrays: folds over one row's array, so nothing is shuffled.

Defined results: null tags count as O; a tag array shorter or longer than its tokens makes the row invalid; an I- tag
without an open span of its type opens nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloka.constants import DROPPED_TYPES, ENTITY_TYPES


def normalize_tag(tag: Column) -> Column:
    """B-/I- with the type it counts as; O for empty, unknown and dropped types."""
    t = F.upper(F.trim(F.coalesce(tag, F.lit("O"))))
    kind = F.regexp_replace(t, "^[BI]-", "")
    types = F.create_map(*[F.lit(x) for kv in ENTITY_TYPES.items() for x in kv])
    named = F.try_element_at(types, kind)
    return F.when(kind.isin(DROPPED_TYPES) | named.isNull(), "O").otherwise(F.concat(F.when(t.startswith("I-"), "I-").otherwise("B-"), named))


def paint(tokens: DataFrame, spans: DataFrame, sent: str) -> DataFrame:
    """(sent, pos, token, tag) from tokens (sent, pos, token, start, stop) and spans (sent, start, stop, label): a later
    span paints over an earlier one; the first token a span covers gets B-."""
    grouped = spans.groupBy(sent).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label"))).alias("spans"))
    t = tokens.join(grouped, sent, "left")
    over = F.filter(F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint,label:string>>")), lambda x: (F.col("start") >= x["start"]) & (F.col("stop") <= x["stop"]))
    last = F.try_element_at(over, F.lit(-1))
    tag = F.when(F.size(over) == 0, "O").otherwise(F.concat(F.when(last["start"] == F.col("start"), "B-").otherwise("I-"), last["label"]))
    return t.select(sent, "pos", "token", tag.alias("tag"))


def valid(tokens: Column, tags: Column) -> Column:
    """As many tags as tokens, and at least one entity."""
    return (F.size(tokens) == F.size(tags)) & F.exists(tags, lambda t: t != "O")

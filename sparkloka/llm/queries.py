"""The queries of this subpackage, over whole tables with production parameters. p3's groups have an SQL twin; the others
are tested against brute force, exact round trips and hand-made cases in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloka.llm import languages, lookalikes, mixing, overlap, sentences, splits, tokens
from sparkloka.runtime import table


def _p1(fn):
    return lambda s, d: fn(table(s, d, "weak_labeled").select("row_id", "text"), table(s, d, "language_tags"), table(s, d, "documents"))


def _p2(fn):
    return lambda s, d: fn(table(s, d, "signal_train"), table(s, d, "signal_val"), table(s, d, "signal_test"))


def _posts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "social_bootstrap").select("row_id", "text", "raw_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _p1(languages.found),
        "p1_labels": _p1(languages.labelled),
        "p2_found": _p2(overlap.found),
        "p2_report": _p2(overlap.report),
        "p2_classes": _p2(overlap.classes),
        "p3_found": lambda s, d: splits.found(splits.all_records(s, d)),
        "p3_splits": lambda s, d: splits.assign(splits.groups(splits.all_records(s, d))),
        "p5_found": lambda s, d: lookalikes.found(_posts(s, d), ["text", "raw_text"]),
        "p5_canonical": lambda s, d: lookalikes.canonical(_posts(s, d), ["text", "raw_text"]),
        "p6_ids": lambda s, d: tokens.encode(table(s, d, "documents"), ["doc_id"]),
        "p7_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
        "p7_report": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
        "p8_found": lambda s, d: sentences.sentences(table(s, d, "documents")),
    }


_SIDE = r"regexp_replace(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '[?#].*$', ''), '^(https?:)?(//)?((www|m)\.)*', '', 'i')"
_TABLES = " UNION ALL ".join(f"SELECT row_id, platform, {'author' if t in ('social_bootstrap',) else 'NULL AS author'}, url FROM {t}" for t in splits.TABLES)
_HOST = "CASE {h} " + " ".join(f"WHEN '{h}' THEN '{p}'" for h, p in splits.HOSTS.items()) + " ELSE lower(trim(platform)) END"
_NOBODY = ", ".join(f"'{x}'" for x in splits.NOBODY)
#: Groups as the closure of 'names what another names', over the smallest record of each account and page.
_GROUPS = f"""
WITH RECURSIVE b AS (SELECT row_id, platform, regexp_replace({_SIDE.format(c="coalesce(author, '')")}, '/+$', '') AS a, regexp_replace({_SIDE.format(c="coalesce(url, '')")}, '/+$', '') AS u FROM ({_TABLES})),
c AS (SELECT *, lower(split_part(u, '/', 1)) AS host, CASE WHEN contains(u, '/') AND contains(split_part(u, '/', 1), '.') THEN substr(u, length(split_part(u, '/', 1)) + 1) ELSE '' END AS path, lower(ltrim(regexp_replace(a, '^.*/', ''), '@')) AS who, CASE WHEN contains(a, '/') AND contains(split_part(a, '/', 1), '.') THEN lower(split_part(a, '/', 1)) END AS ahost FROM b),
e AS (SELECT *, {_HOST.format(h="host")} AS site, coalesce({_HOST.format(h="ahost")}, '') AS asite FROM c),
n AS (
  SELECT row_id, 'a|' || asite || '|' || who AS key FROM e WHERE who NOT IN ({_NOBODY}) AND lower(a) NOT IN ({_NOBODY})
  UNION SELECT row_id, 'a|' || site || '|' || lower(ltrim(split_part(path, '/', 2), '@')) FROM e WHERE path <> '' AND site IN ('tiktok', 'x') AND lower(ltrim(split_part(path, '/', 2), '@')) NOT IN ({_NOBODY}, 'p', 'place', 'i', 'search', 'hashtag')
  UNION SELECT row_id, 'p|' || host || '|' || CASE WHEN site IN ('tiktok', 'x') THEN lower(path) ELSE path END FROM e WHERE path <> '' AND NOT (coalesce(site IN ('tiktok', 'x'), FALSE) AND regexp_matches(path, '^/[^/]+$'))),
m AS MATERIALIZED (SELECT DISTINCT row_id, min(row_id) OVER (PARTITION BY key) AS rep FROM n),
g AS MATERIALIZED (SELECT row_id AS x, rep AS y FROM m WHERE row_id <> rep UNION SELECT rep, row_id FROM m WHERE row_id <> rep),
r(x, y) AS (SELECT x, x FROM g UNION SELECT r.x, g.y FROM r JOIN g ON r.y = g.x)
SELECT x AS row_id, min(y) AS group_id FROM r GROUP BY x
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _GROUPS}

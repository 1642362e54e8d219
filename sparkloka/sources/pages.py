"""Records from fetched pages: meta tags, embedded JSON, links. Pages come as a table (url, html); fetching is not done here.

Defined results: a page without text or with a challenge instead of content gives no record and says why in
``blocked``; broken JSON counts as none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloka.functions.text import canonical_url

# What a page shows instead of its content.
BLOCKED = ["captcha", "verify to continue", "log in to continue", "access denied", "rate limit"]


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<meta[^>]+(?:property|name)=[\"']{name}[\"'][^>]+content=[\"'](.*?)[\"']", 1)


def unescape(c: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def links(df: DataFrame, url: str, html: str, accept: str) -> DataFrame:
    """(url, target, pos) of the anchors whose canonical address fits ``accept``, each once, in page order."""
    hrefs = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1)), lambda h: canonical_url(unescape(h))), lambda h: h.rlike(accept)))
    return df.select(url, F.posexplode(hrefs).alias("pos", "target"))


def records(df: DataFrame) -> DataFrame:
    """(url, text, author, item_id, title, blocked) of pages (url, html)."""
    text = unescape(F.coalesce(F.nullif(meta(F.col("html"), "og:description"), F.lit("")), meta(F.col("html"), "description")))
    low = F.lower("html")
    blocked = F.when(low.rlike("|".join(BLOCKED)), "challenge").when(F.trim(text) == "", "no_text")
    return df.select("url", F.when(blocked.isNull(), text).alias("text"), F.regexp_extract("url", "/@?([^/?#]+)/(?:video|status)/", 1).alias("author"), F.regexp_extract("url", r"/(?:video|status|p)/([A-Za-z0-9_-]+)", 1).alias("item_id"), unescape(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), blocked.alias("blocked"))


def longest_description(df: DataFrame, least: int = 8) -> DataFrame:
    """(url, desc): of all objects nested in a page's JSON script the longest ``desc``. Depth is unbounded, so Python walks it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            out = []
            for u, raw in zip(pdf["url"], pdf["script"]):
                try:
                    todo = [json.loads(raw)]
                except (TypeError, ValueError):
                    continue
                best = ""
                while todo:
                    x = todo.pop()
                    if isinstance(x, dict):
                        d = x.get("desc")
                        if isinstance(d, str) and len(d) >= least and (len(d), d) > (len(best), best):
                            best = d
                        todo += x.values()
                    elif isinstance(x, list):
                        todo += x
                if best:
                    out.append((u, best))
            yield pd.DataFrame(out, columns=["url", "desc"])

    script = F.regexp_extract("html", r"(?is)<script[^>]*type=[\"']application/json[\"'][^>]*>(.*?)</script>", 1)
    return df.select("url", script.alias("script")).filter("script <> ''").mapInPandas(run, "url string, desc string")


def reply_label(raw: Column, labels: list[str]) -> Column:
    """struct<label, confidence> of a model's reply: JSON, fenced JSON, JSON within words, else the label by pattern."""
    schema = "struct<label:string,confidence:double>"
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    strict = F.from_json(inner, schema)
    single = F.from_json(F.replace(inner, F.lit("'"), F.lit('"')), schema)
    word = F.regexp_extract(F.upper(raw), rf"\b({'|'.join(labels)})\b", 1)
    number = F.coalesce(F.regexp_extract(raw, r"(?i)confidence\D{0,5}([01](?:\.\d+)?)", 1).try_cast("double"), F.lit(0.5))
    made = F.coalesce(F.when(strict["label"].isNotNull(), strict), F.when(single["label"].isNotNull(), single), F.when(word != "", F.struct(word.alias("label"), number.alias("confidence"))))
    return F.when(F.upper(made["label"]).isin(labels), F.struct(F.upper(made["label"]).alias("label"), F.coalesce(made["confidence"], F.lit(0.5)).alias("confidence")))

"""Text functions, Column to Column. Null texts count as empty.

What is one pattern or a few is a built-in expression. The normaliser, its dedupe key and the pieces of a post are chains
of a dozen steps with a look-up for each word; as expressions they are interpreted for each row and step, so they run in
Arrow batches of compiled patterns instead (some twenty times less time). They count as nondeterministic to the planner,
only so that a filter on their result is not pushed below and makes them twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkloka.constants import EMOJI, HINTS_EN, HINTS_ID, HINTS_SLANG, SLANG

EMOJI_CLASS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in EMOJI)
W = r"[\p{L}\p{N}_]"


# What is taken out of a text, in this order.
CLEAN = [(r"http\S+|www\.\S+", " "), ("<[^>\n]*>", " "), (f"@{W}+", " "), (f"#({W}+)", " $1 "), (r"[^a-z0-9\s.,!?/\-]", " ")]


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once a row, also where it is used within a lambda."""
    return F.transform(F.array(value), use)[0]


def strip_emoji(c: Column) -> Column:
    return _squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{EMOJI_CLASS}]+", " "))


def clean_text(c: Column) -> Column:
    """Lower case, without emoji, links, tags and mentions; hashtags as words; letters a-z, digits and .,!?/- only."""
    c = F.lower(strip_emoji(c))
    for pattern, to in CLEAN:
        c = F.regexp_replace(c, pattern, to)
    return _squeeze(c)


_EMOJI = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in EMOJI) + "]+")
_BLANK = regex.compile(r"[ \t\n\x0b\f\r]+")
_CLEAN = [(regex.compile(p.replace(r"\S", r"[^ \t\n\x0b\f\r]").replace(r"\s", r" \t\n\x0b\f\r")), to.replace("$", "\\")) for p, to in CLEAN]
_UNKEYED = regex.compile(r"[^a-z0-9_ ]")
_STOPS = regex.compile(r"([.!?])[ \t\n\x0b\f\r]+")
_CLAUSE = regex.compile(r"[ \t\n\x0b\f\r]*[;,][ \t\n\x0b\f\r]+")
_CHUNK = regex.compile(r"[\n\r]+|(?<=[.!?])[ \t\n\x0b\f\r]+|,[ \t\n\x0b\f\r]+")


def plain(text: str) -> str:
    """A text without emoji and runs of white space."""
    return _BLANK.sub(" ", _EMOJI.sub(" ", text)).strip(" ")


def normal(text: str | None) -> str:
    """Cleaned, and its words by the slang map; one closing mark is set aside; what becomes empty is dropped."""
    t = plain(text or "").lower()
    for pattern, to in _CLEAN:
        t = pattern.sub(to, t)
    out = []
    for w in t.split():
        bare = w[:-1] if w[-1] in ".,!?" else w
        if word := SLANG.get(bare, bare):
            out.append(word + w[len(bare) :])
    return " ".join(out)


def keyed(normalized: str) -> str:
    return " ".join(_UNKEYED.sub(" ", normalized).split())


def pieces(text: str | None) -> list[str]:
    """Normalised candidates of a post: the whole if short, its sentences, and clauses of long sentences; 12 to 240
    characters, 3 to 48 words, the first of each dedupe key, at most eight."""
    raw = plain(text or "").replace("\u200b", " ").strip(" ")
    whole = normal(raw)
    made = [whole] if len(whole) <= 220 else []
    for part in _STOPS.sub(r"\1\n", raw).split("\n"):
        if part := part.strip(" "):
            made.append(normal(part))
            if len(part) > 160:
                made += [normal(x) for x in _CLAUSE.split(part)]
    kept: dict[str, str] = {}
    for m in made:
        if 12 <= len(m) <= 240 and 3 <= m.count(" ") + 1 <= 48 and (k := keyed(m)):
            kept.setdefault(k, m)
    return list(kept.values())[:8]


def expansions(raw: str | None, text: str | None) -> list[str]:
    """Candidates of a live post: its pieces, then its lines, sentences and clauses of 8 to 180 characters as they
    follow one another; its normalised text where there are none."""
    raw = raw or text or ""
    made = pieces(raw) + [m for x in _CHUNK.split(raw) if 8 <= len(m := normal(x)) <= 180]
    return made or [m for m in [normal(text)] if m]


@F.pandas_udf(StringType())
def _normal(batch: pd.Series) -> pd.Series:
    return batch.map(normal)


@F.pandas_udf(StringType())
def _key(batch: pd.Series) -> pd.Series:
    return batch.map(lambda t: keyed(normal(t)))


@F.pandas_udf(ArrayType(StringType()))
def _pieces(batch: pd.Series) -> pd.Series:
    return batch.map(pieces)


@F.pandas_udf(ArrayType(StringType()))
def _expansions(raw: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([expansions(r, t) for r, t in zip(raw, text)], dtype=object)


_normal, _key, _pieces, _expansions = (f.asNondeterministic() for f in (_normal, _key, _pieces, _expansions))


def normalize_text(c: Column) -> Column:
    return _normal(c)


def dedupe_key(c: Column) -> Column:
    return _key(c)


def key_of_normal(c: Column) -> Column:
    """The dedupe key of a normalised text."""
    return _squeeze(F.regexp_replace(c, r"[^a-z0-9_\s]", " "))


def candidates(c: Column) -> Column:
    """``pieces`` of a column."""
    return _pieces(c)


def live_candidates(raw: Column, text: Column) -> Column:
    """``expansions`` of two columns."""
    return _expansions(raw, text)


def hashtags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"#({W}+)"), F.lit(1)))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"{W}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))


def offsets(c: Column) -> Column:
    """array<struct<token, start, stop>>: each token is looked for behind the one before it."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<token:string,start:int,stop:int>>").alias("done"))

    def step(acc: Column, t: Column) -> Column:
        pos = F.call_function("locate", t, c, acc["at"])
        return F.struct((pos + F.length(t)).alias("at"), F.concat(acc["done"], F.array(F.struct(t.alias("token"), (pos - 1).alias("start"), (pos - 1 + F.length(t)).alias("stop")))).alias("done"))

    return F.aggregate(tokens(c), start, step, lambda acc: acc["done"])


def language_scores(normal: Column) -> dict[str, Column]:
    """Distinct hits of the hint words of id, en and slang, and the number of tokens, of a normalised text."""
    words = F.regexp_extract_all(normal, F.lit("[a-z]+"), F.lit(0))
    hits = lambda hints: F.size(F.array_intersect(words, F.array(*[F.lit(h) for h in hints])))
    return {"id": hits(HINTS_ID), "en": hits(HINTS_EN), "slang": hits(HINTS_SLANG), "tokens": F.size(words)}


def is_indonesian(s: dict[str, Column], strict: bool = False) -> Column:
    own = s["id"] + s["slang"]
    loose = F.lit(False) if strict else ((own >= 2) & (s["en"] <= own + 1)) | ((own >= 1) & (s["slang"] >= 1) & (s["en"] <= 2))
    tight = (own >= 2) & (own > s["en"]) if strict else F.lit(False)
    return (s["tokens"] >= 3) & (((own >= 3) & (own >= s["en"])) | tight | loose)


def language_class(s: dict[str, Column]) -> Column:
    own = s["id"] + s["slang"]
    return F.when((own == 0) & (s["en"] == 0), "unclear").when(own >= s["en"], "indonesian_dominant").otherwise("english_dominant")


def stable_split(c: Column) -> Column:
    """80/10/10 by the first eight hex digits of the SHA-256."""
    v = F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(v < 80, "train").when(v < 90, "validation").otherwise("test")


# Patterns of personal data in the order they are replaced.
PII = [
    (r"\b\d{16}\b", "[NIK_REDACTED]"),
    (r"(\+62|08)\d{8,12}", "[PHONE_REDACTED]"),
    (r"[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z0-9_]+", "[EMAIL_REDACTED]"),
    (r"(?i)(rek|rekening|bca|mandiri|bni|bri)\s*\d{10,16}\b", "$1 [BANK_REDACTED]"),
]


def redact(c: Column) -> Column:
    for pattern, to in PII:
        c = F.regexp_replace(c, pattern, to)
    return c


def canonical_url(c: Column) -> Column:
    """https scheme if none, host in small letters without m./mobile., no query, fragment or closing slash."""
    u = F.trim(F.coalesce(c, F.lit("")))
    u = F.when(u == "", u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(~u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(F.lit("https://"), u)).otherwise(u)
    u = F.regexp_replace(u, r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)), r"^(m|mobile)\.", "")
    scheme, path = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1), "/+$", "")
    return F.when(u == "", u).otherwise(F.concat(scheme, F.lit("://"), host, path))


def maps_search_url(c: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.url_encode(c))


def unix_to_iso(c: Column) -> Column:
    """ISO form of Unix seconds; other strings unchanged; empty for null, empty and values up to 0."""
    n = c.try_cast("long")
    return F.when(c.isNull() | (c == ""), "").when(~c.rlike(r"^\d+$"), c).when((n <= 0) | n.isNull() | (n > 253402300799), "").otherwise(F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def jitter(key: Column, skip: int = 1) -> Column:
    """A small shift in degrees from four hex digits of the MD5."""
    return (F.conv(F.substring(F.md5(key), skip, 4), 16, 10).cast("double") / 65535 - 0.5) * 0.05

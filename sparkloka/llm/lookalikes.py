"""One form for text that looks the same: a trie of the corpus's tokens is walked by a weighted edit automaton to which
look-alikes and ignorables cost nothing.

Only values with a character that some other spelling could stand for need work (``suspect``). Their tokens are walked
over tries of the vocabulary as it is spelled: an arc is a character, and it costs 0 if it shows what the token shows at
that place, also if it shows nothing, or two letters as one; it costs 1 otherwise. All spellings reached at cost 0 look
the same; the clean one among them is canonical, else (unmatched tokens) the spelling that the table of forms and
look-alikes gives. Values without suspect characters are canonical. The vocabulary is divided by how tokens begin and how
long they look, so that a token's trie holds all that could look like it and much that doesn't.

Defined results: null and empty values have no canonical form and match nothing; repeated rows are all reported; line
breaks and ordinary spaces are kept; letter case and missing accents matter; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkloka.runtime import bounded, stage

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "ё": "ë", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "ï", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "Ё": "Ë", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ї": "Ï", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Օ": "O", "Ս": "U", "ɑ": "a", "ɡ": "g", "ı": "i",
}
# Ranges of characters that show nothing.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
#: Kinds of compatibility forms that read as the plain characters. Thai and Lao AM keep their one usual form.
FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
KEEP = {0xE33, 0xEB3}
_EMOJI = r"\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}\x{FE0F}\x{20E3}#*0-9"
#: Counted rows up to which the names of parts are broadcast: beginnings and lengths, not tokens.
SMALL = 200_000
#: Characters at a token's beginning that, with its length, name the part of the vocabulary it lies in.
BEGINNING = 3
#: Code points between two characters of the suspect class that are taken along.
GAP = 40
#: Tokens of the vocabulary per trie.
SHARD = 20_000


@lru_cache(1)
def _tables() -> tuple[dict[int, str], dict[int, str], str]:
    """Compatibility forms, look-alikes, and the class of characters that make a value suspect, all from Unicode data."""
    forms: dict[int, str] = {}
    odd: set[int] = set(map(ord, LOOKALIKES))
    for cp in range(0x80, sys.maxunicode + 1):
        kind = unicodedata.decomposition(ch := chr(cp))
        if not kind:
            continue
        if kind.startswith(FORMS) and cp not in KEEP:
            forms[cp] = unicodedata.normalize("NFKC", ch)
        elif not kind.startswith("<"):
            if unicodedata.normalize("NFC", ch) != ch:
                odd.add(cp)
            elif len(parts := kind.split()) == 2:
                odd.add(int(parts[1], 16))
    for space in "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\xa0":
        forms[ord(space)] = " "
    odd |= forms.keys()
    odd -= {ord(c) for c in " \n\t"}
    runs: list[list[int]] = []
    for cp in sorted(odd):
        # a few harmless characters more keep the class short, for it is tried on every character beyond ASCII
        if runs and cp - runs[-1][1] <= (GAP if cp > 0x20FF and not 0x3000 <= cp <= 0x30FF else 1):
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    quiet = [(a, b) for a, b in IGNORABLE]
    cls = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)
    # a joiner or an emoji variation mark inside an emoji is part of it
    plain = "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for a, b in quiet for x, y in ([(0x200B, 0x200C), (0x200E, 0x200F)] if a == 0x200B else [(0xFE00, 0xFE0E)] if a == 0xFE00 else [(a, b)]))
    pattern = rf"(?=[^\x00-\x7F])(?:[{cls}{plain}]|(?<![{_EMOJI}])[\x{{200D}}\x{{FE0F}}]|\x{{200D}}(?![{_EMOJI}]))"
    return forms, {ord(a): b for a, b in LOOKALIKES.items()}, pattern


def suspect(c: Column) -> Column:
    """Whether a value holds a character that another spelling could stand for."""
    return c.rlike(r"[^\x00-\x7F]") & c.rlike(_tables()[2])


@lru_cache(1)
def _fold_parts():
    import regex

    forms, alike, _ = _tables()
    emoji = _EMOJI.replace(r"\x{FE0F}", "").replace(r"\x{20E3}", "").replace("#*0-9", "")
    emoji = regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), emoji)
    quiet = "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE)
    skin = "\U0001f3fb-\U0001f3ff"
    drop = regex.compile(rf"((?<=[{emoji}{skin}\ufe0f])\u200d(?=[{emoji}])|(?<=[{emoji}#*0-9])\ufe0f)|[{quiet}]")
    return forms, alike, drop


def fold(text: str) -> str:
    """The table form: nothing invisible, plain forms, composed accents, Latin letters for their look-alikes."""
    if text.isascii():
        return text
    forms, alike, drop = _fold_parts()
    t = drop.sub(lambda m: m[1] or "", text).translate(forms)
    t = unicodedata.normalize("NFC", t).translate(alike)
    return unicodedata.normalize("NFC", t)


@F.pandas_udf(StringType())
def fold_udf(batch: pd.Series) -> pd.Series:
    return batch.map(fold, na_action="ignore")


def folded(c: Column) -> Column:
    """``fold`` of a column; only suspect values go to Python."""
    return F.coalesce(fold_udf(F.when(suspect(c), c)), c)


@lru_cache(100_000)
def _shows(ch: str) -> tuple[str, ...]:
    """What an eye sees of one character: base letters and marks one by one, the Latin letter of a look-alike."""
    return tuple(unicodedata.normalize("NFD", fold(ch)))


def arcs(token: str) -> list[tuple[str, tuple[str, ...]]]:
    """(character, what it shows) of a token as it is spelled; a joiner or mark within an emoji shows itself, all other
    ignorables show nothing."""
    spelled = unicodedata.normalize("NFD", token)
    if spelled.isascii():
        return [(c, (c,)) for c in spelled]
    kept = {m.start(1) + i for m in _fold_parts()[2].finditer(spelled) if m[1] for i in range(len(m[1]))}
    return [(c, (c,) if i in kept else _shows(c)) for i, c in enumerate(spelled)]


def symbols(token: str) -> list[str]:
    """What an eye sees of a token."""
    return [s for _, shown in arcs(token) for s in shown]


class Trie:
    """A vocabulary by the characters of its spellings, walked by a weighted edit automaton: look-alikes and ignorables
    cost 0, other insertions, deletions and replacements 1."""

    def __init__(self) -> None:
        self.root: list = [{}, {}, []]  # arcs by the first thing shown, arcs that show nothing, entries

    def add(self, spelling: str, weight: int) -> None:
        node = self.root
        for ch, shown in arcs(spelling):
            below = node[0].setdefault(shown[0], {}) if shown else node[1]
            step = below.get(ch)
            if step is None:
                step = below[ch] = (shown, [{}, {}, []])
            node = step[1]
        node[2].append((spelling, weight))

    def search(self, token: str, most: int = 0) -> list[tuple[int, str, int]]:
        """(cost, spelling, weight) of all entries within ``most``, each at its least cost."""
        want = symbols(token)
        todo: list[tuple[int, int, list]] = [(0, 0, self.root)]  # cost, symbols read, node
        least: dict[tuple[int, int], int] = {}
        found: dict[str, tuple[int, str, int]] = {}
        while todo:
            cost, at, node = todo.pop()
            if most:
                if least.get((id(node), at), most + 1) <= cost:
                    continue
                least[id(node), at] = cost
            if at == len(want):
                for spelling, weight in node[2]:
                    if spelling not in found or found[spelling][0] > cost:
                        found[spelling] = (cost, spelling, weight)
            elif cost < most:
                todo.append((cost + 1, at + 1, node))  # a symbol more than the spelling has
            for _, below in node[1].values():
                todo.append((cost, at, below))
            if at < len(want):
                for shown, below in node[0].get(want[at], {}).values():
                    if tuple(want[at : at + len(shown)]) == shown:
                        todo.append((cost, at + len(shown), below))
            if cost < most:
                for by in node[0].values():
                    for shown, below in by.values():
                        if cost + len(shown) <= most:
                            todo.append((cost + len(shown), at, below))
                        if at < len(want):
                            todo.append((cost + len(shown), at + 1, below)) if cost + len(shown) <= most else None
        return list(found.values())


def _scripts(token: str) -> int:
    return len({unicodedata.name(c, "?").split(" ")[0] for c in token if c.isalpha()})


def _walk(shard: pd.DataFrame) -> pd.DataFrame:
    """The canonical spelling of every suspect token of a part of the vocabulary."""
    trie = Trie()
    for spelling, n in zip(shard["token"], shard["n"]):
        trie.add(spelling, int(n))
    out = []
    for token in shard.loc[shard["odd"], "token"]:
        hits = trie.search(token)
        # first the table's own spelling, then one that the table leaves alone but for its alphabet, then the commonest
        best = min(hits, key=lambda h: (fold(h[1]) != h[1], unicodedata.normalize("NFKC", h[1]) != h[1] or _scripts(h[1]) > 1, -h[2], h[1]), default=None)
        clean = best is not None and (fold(best[1]) == best[1] or (unicodedata.normalize("NFKC", best[1]) == best[1] and _scripts(best[1]) == 1 and not _fold_parts()[2].search(best[1])))
        out.append((token, best[1] if clean else fold(token)))
    return pd.DataFrame(out, columns=["token", "canon"])


def _tokens(c: str | Column) -> Column:
    """The runs of other characters than white space; matched by a compiled pattern, which splitting would not keep."""
    return F.regexp_extract_all(c, F.lit(r"[^\s\p{Z}]+"), F.lit(0))


def _part(looks: Column) -> Column:
    """The part of the vocabulary that a token of this folded form lies in: its beginning and its length."""
    return F.concat(F.substring(looks, 1, BEGINNING), F.length(looks).cast("string"))


def spellings(odd_values: DataFrame, clean_values: DataFrame) -> DataFrame:
    """(token, canon) of every suspect token of the distinct ``odd_values`` (value), by the vocabulary of both."""
    pieces = odd_values.select(F.explode(_tokens("value")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("odd", suspect(F.col("token")))
    pieces = stage(pieces, "look-tokens")
    odd = stage(pieces.filter("odd").withColumn("part", _part(fold_udf("token"))), "look-odd")
    parts = bounded(odd.select("part").distinct(), SMALL)
    # what is not suspect looks as it is spelled
    clean = clean_values.select(F.explode(_tokens("value")).alias("token")).withColumn("part", _part(F.col("token"))).join(parts, "part", "left_semi").groupBy("token", "part").agg(F.count(F.lit(1)).alias("n"))
    near = pieces.filter("NOT odd").withColumn("part", _part(F.col("token"))).join(parts, "part", "left_semi").select("token", "part", "n")
    both = odd.select("token", "part", "n", "odd").unionByName(clean.unionByName(near).select("token", "part", "n", F.lit(False).alias("odd")))
    both = stage(both, "look-vocabulary")
    shards = max(1, both.count() // SHARD)
    return stage(both.groupBy(F.pmod(F.xxhash64("part"), F.lit(shards)).alias("shard")).applyInPandas(_walk, "token string, canon string"), "look-spellings")


def _marked(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(row_id, field, vh, odd): every value by its md5, and the value itself where it is suspect. The one reading of the
    rows that asks for suspects."""
    long = long_values(rows, fields).withColumn("is_odd", suspect(F.col("value")))
    return stage(long.select("row_id", "field", F.unhex(F.md5("value")).alias("vh"), F.when(F.col("is_odd"), F.col("value")).alias("odd")), "look-marked")


def canonical_values(marked: DataFrame, long: DataFrame) -> DataFrame:
    """(vh, canon) of every distinct suspect value of ``marked``; ``long`` are the values that it was made from."""
    odd = stage(marked.filter("odd IS NOT NULL").groupBy("vh").agg(F.first("odd").alias("value")), "look-values")
    words = odd.select("vh", F.explode(F.array_distinct(_tokens("value"))).alias("token")).filter(suspect(F.col("token")))
    known = words.join(spellings(odd, long.filter(~suspect(F.col("value")))), "token").groupBy("vh").agg(F.map_from_entries(F.collect_list(F.struct("token", "canon"))).alias("known"))
    spaced = F.regexp_replace(F.regexp_replace("value", r"[\p{Zs}]", " "), r"(?<=\s)|(?=\s)", "\u0000")
    pieces = F.transform(F.split(spaced, "\u0000"), lambda w: F.coalesce(F.try_element_at("known", w), w))
    return odd.join(known, "vh", "left").select("vh", F.when(F.col("known").isNull(), F.regexp_replace("value", r"[\p{Zs}]", " ")).otherwise(F.array_join(pieces, "")).alias("canon"))


def long_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select("row_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v")).select("row_id", "v.*").filter("value IS NOT NULL AND value <> ''")


def canonical(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(row_id, field, canon) of every value: the class of what looks the same, by its one spelling."""
    long = long_values(rows, fields)
    marked = _marked(rows, fields)
    odd = marked.filter("odd IS NOT NULL").join(canonical_values(marked, long), "vh").select("row_id", "field", "canon")
    return long.filter(~suspect(F.col("value"))).select("row_id", "field", F.col("value").alias("canon")).unionByName(odd)


def found(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs of records whose values look the same and are not the same string.

    Only classes with two or more spellings are joined, spelling against spelling, so equal copies never meet."""
    marked = _marked(rows, fields)
    done = stage(canonical_values(marked, long_values(rows, fields)).select("vh", F.unhex(F.md5("canon")).alias("ch")), "look-done")
    odd = stage(marked.filter("odd IS NOT NULL").select("row_id", "field", "vh").join(done, "vh"), "look-rows")
    plain = marked.filter("odd IS NULL").select("row_id", "field", "vh").withColumn("ch", F.col("vh")).join(odd.select("field", "ch").distinct(), ["field", "ch"], "left_semi").select("row_id", "field", "vh", "ch")
    met = stage(odd.select("row_id", "field", "vh", "ch").unionByName(plain), "look-met")
    forms = met.select("field", "ch", "vh").distinct()
    pairs = forms.withColumnRenamed("vh", "va").join(forms.withColumnRenamed("vh", "vb"), ["field", "ch"]).filter("va < vb").select("field", "va", "vb")
    a = met.select(F.col("row_id").alias("ra"), "field", F.col("vh").alias("va"))
    b = met.select(F.col("row_id").alias("rb"), "field", F.col("vh").alias("vb"))
    both = pairs.join(a, ["field", "va"]).join(b, ["field", "vb"]).filter("ra <> rb")
    return both.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"), "field")

"""The rule book: keywords, vetoes and patterns turned into one score a label.

A keyword matches where its words stand one after another with only white space between and no word character next to
it. One automaton of all keywords reads each text once, in Arrow batches; as expressions the book is a few hundred tests
a row. Defined results: null texts and contexts count as empty; no hit is NEUTRAL with confidence 0 and no match.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Mapping
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloka.constants import COMPLAINT_PATTERNS, COMPLAINTS, PRAISE, PRIORITY, RULES

_CUT = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]")
_BOOK = "label string, confidence double, score double, matched array<string>"


def _cut(text: str) -> str:
    """The words and other characters of a text, parted and enclosed by single spaces."""
    return f" {' '.join(_CUT.findall(text))} "


class Book:
    """The rule book as one automaton."""

    def __init__(self, priority: Mapping[str, int] = PRIORITY) -> None:
        import ahocorasick

        self.priority = priority
        self.keys: dict[str, list[tuple[str, int]]] = {}  # keyword as cut: (label, times listed)
        self.vetoes: dict[str, list[str]] = defaultdict(list)
        self.listed = {name: [w for w in rule["keywords"].split("|") if w] for name, rule in RULES.items()}
        for name, rule in RULES.items():
            for k, n in Counter(map(_cut, self.listed[name])).items():
                self.keys.setdefault(k, []).append((name, n))
            for v in filter(None, rule["vetoes"].split("|")):
                self.vetoes[_cut(v)].append(name)
        self.auto = ahocorasick.Automaton()
        for k in {*self.keys, *self.vetoes}:
            self.auto.add_word(k, k)
        self.auto.make_automaton()
        self.patterns = [(re.compile(p, re.ASCII), w) for p, w in COMPLAINT_PATTERNS]

    def hits(self, text: str) -> set[str]:
        return {k for _, k in self.auto.iter(_cut(text))}

    def scores(self, text: str, context: str = "") -> dict[str, float]:
        """The score of every label that has one."""
        own = self.hits(text)
        out: dict[str, float] = defaultdict(float)
        for k in own:
            for name, n in self.keys.get(k, ()):
                out[name] += n
        if context:
            for k in self.hits(context) - own:
                for name, n in self.keys.get(k, ()):
                    if RULES[name]["context"]:
                        out[name] += 0.75 * n
        for pattern, weight in self.patterns:
            if pattern.search(text):
                out["COMPLAINT"] += weight
        for v in own & self.vetoes.keys():
            for name in self.vetoes[v]:
                out.pop(name, None)
        return out

    def label(self, text: str, context: str = "") -> tuple[str, float, float, list[str]]:
        text, context = text.lower(), context.lower()
        scores = self.scores(text, context)
        if not scores:
            return "NEUTRAL", 0.0, 0.0, []
        best = max(scores, key=lambda name: (scores[name], self.priority[name]))
        score = float(scores[best])
        own, other = self.hits(text), self.hits(context) if RULES[best]["context"] else set()
        matched = [w for w in self.listed[best] if _cut(w) in own]
        matched += [f"query:{w}" for w in self.listed[best] if _cut(w) in other - own]
        matched += [f"regex:{p.pattern}" for p, _ in self.patterns if best == "COMPLAINT" and p.search(text)]
        return best, 1.0 if score >= 2.5 else 0.8 if score >= 1.5 else 0.6, score, matched


@lru_cache(4)
def _book(priority: tuple[tuple[str, int], ...]) -> Book:
    return Book(dict(priority))


def label(df: DataFrame, text: str, context: str | None = None, priority: Mapping[str, int] = PRIORITY) -> DataFrame:
    """Adds ``label``, ``confidence``, ``score`` and ``matched``; of equal scores the label of higher priority wins.

    ``matched`` has the label's keywords in the book's order: those of the text, then ``query:`` and those of the context
    alone, then ``regex:`` and patterns."""
    order = tuple(priority.items())

    @F.pandas_udf(_BOOK)
    def read(texts: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        book = _book(order)
        return pd.DataFrame([book.label(t or "", c or "") for t, c in zip(texts, contexts)], columns=["label", "confidence", "score", "matched"])

    made = df.withColumn("__book", read.asNondeterministic()(F.col(text), F.col(context) if context else F.lit("")))
    return made.withColumns({c: F.col(f"__book.{c}") for c in ("label", "confidence", "score", "matched")}).drop("__book")


def score_words(words: list[str], name: str) -> float:
    """The score of ``label`` for one label and a normalised text given by its words, without context."""
    return float(_book(tuple(PRIORITY.items())).scores(" ".join(words)).get(name, 0.0))


def complaint_score(normal: Column, business: Column, city: Column, area: Column) -> Column:
    """Markers count 2, praise -1, and a named business, city and district 1 each (substrings of the normalised text)."""
    score = F.lit(0)
    for words, weight in ((COMPLAINTS, 2), (PRAISE, -1)):
        for w in words:
            score = score + F.when(F.contains(normal, F.lit(w)), weight).otherwise(0)
    for hint in (business, city, area):
        score = score + F.when((hint != "") & F.contains(normal, hint), 1).otherwise(0)
    return F.when(normal == "", 0).otherwise(score)


def has_complaint(normal: Column) -> Column:
    return normal.rlike("|".join(COMPLAINTS))

"""The text functions once more, as SQL for the comparison."""

from __future__ import annotations

from sparkloka.constants import HINTS_EN, HINTS_ID, HINTS_SLANG, SLANG
from sparkloka.functions.text import EMOJI_CLASS

W = r"[\p{L}\p{N}_]"


def rep(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, '{pattern}', '{to}', 'g')"


def squeeze(t: str) -> str:
    return f"trim({rep(t, r'\s+', ' ')})"


def strip_emoji(t: str) -> str:
    return squeeze(rep(f"coalesce({t}, '')", f"[{EMOJI_CLASS}]+", " "))


def clean(t: str) -> str:
    c = f"lower({strip_emoji(t)})"
    for pattern, to in ((r"http\S+|www\.\S+", " "), (r"<[^>\n]*>", " "), (f"@{W}+", " "), (f"#({W}+)", r" \1 "), (r"[^a-z0-9\s.,!?/\-]", " ")):
        c = rep(c, pattern, to)
    return squeeze(c)


def slang(c: str) -> str:
    bare = "regexp_replace(w, '[.,!?]$', '')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SLANG.items())
    return f"array_to_string(list_filter(list_transform(string_split({c}, ' '), lambda w: CASE WHEN {bare} = '' THEN '' ELSE (CASE {bare} {cases} ELSE {bare} END) || substr(w, length({bare}) + 1) END), lambda x: x <> ''), ' ')"


def normal(t: str) -> str:
    return squeeze(slang(clean(t)))


def key(t: str) -> str:
    return squeeze(rep(normal(t), r"[^a-z0-9_\s]", " "))


def hits(words: str, hints: list[str]) -> str:
    return f"len(list_intersect(list_distinct({words}), [{', '.join(repr(h) for h in dict.fromkeys(hints))}]))"


def scores(n: str) -> dict[str, str]:
    words = f"regexp_extract_all({n}, '[a-z]+')"
    return {"id": hits(words, HINTS_ID), "en": hits(words, HINTS_EN), "slang": hits(words, HINTS_SLANG), "tokens": f"len({words})"}


def contains_word(t: str, word: str) -> str:
    body = word.replace(" ", r"\s+").replace("-", r"\-")
    return rf"regexp_matches({t}, '(^|[^\p{{L}}\p{{N}}_]){body}($|[^\p{{L}}\p{{N}}_])')"

"""Sentence boundaries by cascading tables of break and no-break rules.

A rule is a pair of expressions for what stands before and after a position; at each position after a final mark the
first rule that fits decides. Tables cascade: forms of all scripts, then the language's own, then the default. Quoted
speech, brackets and addresses are found first; inside them nothing is a position.

Languages other than the document's own are recognised by script; the tables of Latin-letter languages are tried one
after another, the document's language first, so that passages in another language keep their abbreviations.

Defined results: null, empty and blank texts have no sentences; a text without marks is one sentence a paragraph; very
long texts are segmented whole, paragraph by paragraph; repeated documents are segmented each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EMOJI = r"(?:[\p{Extended_Pictographic}\U0001F1E6-\U0001F1FF\U0001F3FB-\U0001F3FF\u200D\uFE0F\u20E3--[\u00A9\u00AE\u2122]])"
_CLOSE = r"[\"'”’»)\]）」』】]"
_TAIL = rf"(?:{_CLOSE}*(?:\s*{_EMOJI}+)*)"
_OPEN = r"[\"'“„«‘(\[「『¿¡—–-]"
_WORD_START = r"(?<![\p{L}\p{M}\p{N}])(?<!(?<![\p{L}\p{M}])\p{L}\.)"

# Abbreviations that are followed by what they introduce, and so never end a sentence.
INNER = {
    "id": "dr drg drs ir prof hj kh bpk sdr sdri yth jl jln jend no nmr hlm hal a.n s.d d.a u.p pkl tgl kec kel kab prov gg vs rp ver telp",
    "en": "mr mrs ms dr prof st rev capt sgt no nos vs e.g i.e approx ca et\\ al vol pp cf",
    "jv": "dr drs ir prof kh bpk jl no kca vs rp tgl kec kel",
    "su": "dr drs ir prof kh bpk jl no kc vs rp tgl kec kel",
    "nl": "dr prof dhr mevr mw hr ir ing drs mr ds ca o.a d.w.z m.a.w bijv i.p.v t.o.v nr blz vs resp incl excl",
    "de": "dr prof fr hr hrn frl ca z.b d.h u.a bzw nr str ggf evtl vgl inkl exkl mio mrd",
    "ru": "т.к т.е т.н ул д г гг пр просп пер пл им см стр табл тыс млн млрд проф акад напр",
    "hi": "डॉ श्री श्रीमती प्रो पं सं नं रु",
    "ar": "د أ م ص ت ه",
}
# Abbreviations that may be the last word, with the words that carry the sentence on where letter case can't tell.
CLOSING = {
    "id": ("dll dsb dst dkk", "yang yg dan atau dengan dgn di ke untuk buat"),
    "en": ("etc a.m p.m inc ltd jr sr st ave blvd", "and but or to on in for with from until before after because opens closes is was"),
    "jv": ("lsp", "sing lan utawa"),
    "su": ("jsb jst", "anu jeung atawa nu"),
    "nl": ("enz e.d etc", "voor en of met in"),
    "de": ("usw etc u.ä o.ä", "für und oder mit in"),
    "ru": ("т.д т.п др руб коп", "по и или с в\\ месяц"),
    "hi": ("आदि", ""),
}
LATIN = ["id", "en", "jv", "su", "nl", "de"]
_MONTHS = "januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jan|feb|mär|apr|jun|jul|aug|sep|sept|okt|nov|dez"

_BREAK = r"(?>\r\n|[\n\r\u2028\x0b\x0c\x85])"
_BLANK_LINE = regex.compile(rf"{_BREAK}[^\S\r\n]*{_BREAK}\s*|\u2029\s*")
_MARKS = regex.compile(r"[.!?…。！？।॥؟‽]+|[฀-๿][^\S฀-๿]*\s")
_ADDRESS = regex.compile(r"(?:https?://|www\.)[^\s]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|net|org|id|co|io)(?:/[^\s,;!]*[^\s,;!.?])?(?![\w])", regex.I)
_QUOTES = regex.compile(r"“[^”“„]*”|„[^“”„]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|(?<![\w\d])\"(?=\S)[^\"]*\"")
_BRACKETS = regex.compile(r"\([^()]*(?:\([^()]*\)[^()]*)*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】")


def _rule(breaks: bool, before: str, after: str, flags: int = 0) -> tuple[bool, regex.Pattern]:
    return breaks, regex.compile(rf"(?<={before})(?={after})", regex.V1 | flags)


def _abbreviations(words: str) -> str:
    # a dot inside an abbreviation may be followed by a space
    return "|".join(sorted((w.replace("\\ ", r"\s+").replace(".", r"\.\s?") if "." in w or "\\ " in w else regex.escape(w) for w in regex.split(r"(?<!\\) ", words)), key=len, reverse=True))


@lru_cache(1)
def _tables() -> tuple[list, dict[str, list], list]:
    upper = rf"\s*{_OPEN}*\s*[\p{{Lu}}\p{{Lt}}]"
    first = [
        # dots inside numbers, times, addresses and abbreviations
        _rule(False, r"\.", r"[\p{Ll}\p{N}]"),
        _rule(False, r"[.!?…]", r"[,;:]|\s*[—–-]\s+\p{Ll}"),
        # omission dots: only before a new sentence
        _rule(True, rf"(?:\.\.|…){_TAIL}", upper),
        _rule(False, rf"(?:\.\.|…){_TAIL}", ""),
    ]
    own: dict[str, list] = {}
    for lang in [*LATIN, "ru", "hi", "ar"]:
        rules = []
        if lang in CLOSING:
            ends, on = CLOSING[lang]
            before = rf"{_WORD_START}(?i:{_abbreviations(ends)})\."
            rules.append(_rule(True, before + _TAIL, rf"{upper}|\s*[\"“„«]"))
            rules.append(_rule(True, rf"{before}(?:\s*{_EMOJI}+)+", ""))
            if on:
                rules.append(_rule(False, before, rf"\s*(?i:{_abbreviations(on)})(?![\p{{L}}\p{{M}}])"))
        rules.append(_rule(False, rf"{_WORD_START}(?i:{_abbreviations(INNER[lang])})\.", ""))
        if lang == "de":
            rules.append(_rule(False, r"(?<!\p{N})\p{N}{1,2}\.", rf"\s+(?i:{_MONTHS})\b"))
        own[lang] = rules
    # a single letter is an initial
    last = [_rule(False, rf"{_WORD_START}(?!\p{{Han}})\p{{L}}\.", r"\s*\S"), _rule(True, "", "")]
    return first, own, last


@lru_cache(64)
def _closing_lower(lang: str):
    """Closing abbreviations before a small letter: on with the sentence, unless the text has no capitals at all."""
    ends = "|".join(_abbreviations(CLOSING[x][0]) for x in ([lang] if lang in CLOSING and lang not in LATIN else LATIN))
    return regex.compile(rf"(?<={_WORD_START}(?i:{ends})\.)(?=\s*[\p{{Ll}}\p{{N}}])", regex.V1)


@lru_cache(1)
def _short() -> list:
    """The cascade where no abbreviation, number or initial stands before the mark."""
    first, _, last = _tables()
    return [*first, last[-1]]


@lru_cache(64)
def _cascade(lang: str) -> list:
    first, own, last = _tables()
    if lang in ("ru", "hi", "ar"):
        order = [lang]
    else:
        order = [lang, *[x for x in LATIN if x != lang]] if lang in LATIN else LATIN
    return [*first, *[r for x in order for r in own[x]], *last]


@lru_cache(1)
def _last_parts() -> frozenset[str]:
    """What may stand right before an abbreviation's dot: no table's rule can fit behind any other longer word."""
    words = [w for t in [*INNER.values(), *(x[0] for x in CLOSING.values())] for w in regex.split(r"(?<!\\) ", t)]
    return frozenset(regex.split(r"[.\s\\]+", w)[-1].lower() for w in words)


_RUN = regex.compile(r"[\p{L}\p{M}\p{N}]{1,16}$")

_SCRIPTS = [("ru", regex.compile(r"\p{Cyrillic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("ar", regex.compile(r"\p{Arabic}"))]
_LATIN = regex.compile(r"\p{Latin}")
_TAIL_RE = regex.compile(_TAIL, regex.V1)
_EMOJI_RE = regex.compile(rf"(?:\s*{_EMOJI}+)+", regex.V1)
_INNER_END = regex.compile(r"[.!?…。！？।؟][\"”“»」』]$")
_JOINED = regex.compile(r"[\p{Latin}\p{N}]")
_CAPITAL = regex.compile(r"\p{Lu}")


_ADDRESS_HINT = regex.compile(r"@|://|[wW]{3}\.|\.(?i:example|com|net|org|id|co|io)(?!\w)")


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Addresses and links, looked for only in runs without white space that hold a sign of one."""
    out, done = [], 0
    for hint in _ADDRESS_HINT.finditer(text):
        a, b = hint.start(), hint.end()
        if a < done:
            continue
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        out += [(a + m.start(), a + m.end(), "a") for m in _ADDRESS.finditer(text[a:b])]
        done = b
    return out


def _paragraph(text: str, lang: str | None) -> list[int]:
    """Ends of sentences within one paragraph, without its own end."""
    near = {}
    for m in _BRACKETS.finditer(text):
        near[m.start()] = m.end()
    spans: list[tuple[int, int, str]] = [(a, b, "b") for a, b in near.items()]
    spans += [(m.start(), m.end(), "q") for m in _QUOTES.finditer(text)]
    spans += _addresses(text)
    spans.sort(key=lambda s: (s[0], -s[1]))
    outer: list[tuple[int, int, str]] = []
    for s in spans:
        if not outer or s[0] >= outer[-1][1]:
            outer.append(s)
    own = lang if lang in LATIN else "id"
    events = [(m.start(), m.end(), "m") for m in _MARKS.finditer(text)]
    events += [s for s in outer if s[2] == "q"]
    events.sort()
    opens = [s[0] for s in outer if s[2] != "a"]
    last, short = _last_parts(), _short()

    def tail_end(b: int) -> int:
        """Behind the quotes and emoji that follow a mark; a quote that opens speech isn't one of them."""
        end = _TAIL_RE.match(text, b).end()
        i = bisect_left(opens, b)
        if i < len(opens) and opens[i] < end:
            return b + len(text[b : opens[i]].rstrip())
        return end

    ends: list[int] = []
    begin, k = 0, 0
    while begin < len(text) and text[begin].isspace():
        begin += 1
    capitals = _CAPITAL.search(text) is not None
    for a, b, kind in events:
        if a < begin:
            continue
        while k < len(outer) and outer[k][1] <= a:
            k += 1
        if kind == "m":
            if k < len(outer) and outer[k][0] <= a < outer[k][1]:
                continue
            mark = text[a]
            if "฀" <= mark <= "๿":  # Thai: white space parts sentences
                left, at = a, a + 1
                while at < len(text) and text[at].isspace():
                    at += 1
                tail = _EMOJI_RE.match(text, left + 1)
                if tail:
                    at = tail.end()
                    if at >= len(text):
                        continue
                    pos, nxt = at, regex.search(r"\S", text[at : at + 40])
                    after = nxt[0] if nxt else ""
                else:
                    pos, after = left + 1, text[at] if at < len(text) else ""
                if not after or _JOINED.match(after) or (tail is None and not text[left + 1].isspace()):
                    continue
            else:
                pos = tail_end(b)
                script = next((x for x, p in _SCRIPTS if p.search(text, max(begin, a - 24), a)), own)
                if mark not in ".!?…" and mark not in "؟":
                    pass  # full-width and other final marks always end, outside quotes and brackets
                else:
                    decided = None
                    run = _RUN.search(text, max(begin, a - 16), a) if mark == "." and b == a + 1 else None
                    plain = run is not None and len(run[0]) > 1 and not run[0].isdigit() and run[0].lower() not in last
                    low = _closing_lower(script).match(text, pos) if mark == "." and not plain else None
                    for breaks, pattern in (short if plain or mark in "!?؟" else _cascade(script)):
                        if low is not None and breaks and pattern.pattern == "(?<=)(?=)":
                            decided = not capitals or not _CAPITAL.search(text, begin, pos)
                            break
                        if pattern.match(text, pos):
                            decided = breaks
                            break
                    if not decided:
                        continue
        else:  # speech: what opens a sentence goes on with its attribution; introduced speech may end one
            if a <= begin or not _INNER_END.search(text, a, b):
                continue
            pos = tail_end(b)
            rest = regex.compile(r"\s*(\S)").match(text, pos)
            if not rest:
                continue
            if regex.match(r"[\p{Ll},;:、，—–と-]", rest[1]) or rest[1] in ".!?。":
                continue
            lead = text[begin:a].rstrip()
            if not lead or lead[-1] not in ":：,，":
                continue
        if pos >= len(text):
            break
        ends.append(pos)
        begin = pos
        while begin < len(text) and text[begin].isspace():
            begin += 1
    return ends


def segment(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    at = 0
    cuts = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for stop, following in cuts:
        block = text[at:stop]
        last = 0
        for end in [*_paragraph(block, lang), len(block)]:
            piece = block[last:end]
            lead = len(piece) - len(piece.lstrip())
            piece = piece.strip()
            if piece:
                out.append((at + last + lead, at + last + lead + len(piece)))
            last = end
        at = following
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for i, t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for a, b in segment(t, lang):
                ids.append(i)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "sent_start", "sent_end"])


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence."""
    lang = F.lower(F.substring("lang", 1, 2)) if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(_run, "doc_id bigint, sent_start bigint, sent_end bigint")

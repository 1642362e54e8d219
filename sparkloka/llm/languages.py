"""Languages of records and of their passages, by bit-sliced Bloom filters of n-grams.

One Bloom filter for each language, stored slice by slice: a slot holds one bit a language, so a lookup is one AND over
the slots of an n-gram and returns every language that has it. The languages' popcounts over a passage, weighted by how
few languages share the n-gram and less the false positives that the filters' fill predicts, decide.

The filters are fitted on at most FIT_ROWS labelled documents of each language (smallest hash of the id), from n-grams
that a share of a language's documents has; labels may be wrong now and then, for an n-gram must be about as common in
one language as in the language where it is commonest.

Defined results: null texts are no cases; texts without words (letters outside links, tags and addresses) have no
passages; a text of words that no filter tells apart is one passage in its script's likeliest language (LANGUAGES' first
for Latin and scripts of no filter) with confidence 0; a passage is one or more whole
sentences; repeated rows are one record, as are texts under one id (the text of smallest hash); a tag that names no language counts as missing; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloka.llm.sentences import segment

LANGUAGES = ["id", "en", "jv", "su", "nl", "de", "zh", "ja", "ar", "th", "ru"]
#: Labelled documents of each language that the filters are fitted on at most, and characters of each of these. Only the
#: fit is bounded: every record is looked at whole.
FIT_ROWS, FIT_CHARS = 400, 20_000
#: Slots of the filters and hashes of an n-gram.
SLOTS, HASHES = 1 << 19, 3
_SLOT = SLOTS - 1
#: Share of a language's fitted documents that must have an n-gram, and least ratio to the language that has it most.
LEAST_SHARE, LEAST_RATIO = 0.01, 0.2
#: Evidence that a change of language within a text must bring.
CHANGE = 4.0
# Ways of writing the languages' codes and names.
CODES = {
    "id": "id in ind indonesian indonesia bahasa", "en": "en eng english", "jv": "jv jw jav javanese jawa", "su": "su sun sundanese sunda",
    "nl": "nl nld dut dutch", "de": "de deu ger german", "zh": "zh zho chi cmn chinese mandarin", "ja": "ja jpn jp japanese",
    "ar": "ar ara arabic", "th": "th tha thai", "ru": "ru rus russian", "ms": "ms msa may malay", "hi": "hi hin hindi", "fr": "fr fra fre french",
    "": "und unknown mis mul zxx none null n/a na - ?",
}
# Function words that stand for a language before anything is fitted.
SEEDS = {
    "id": "yang dan di ke dari tidak untuk dengan ini itu sudah masih karena juga bisa ada jadi sama kalau buat",
    "en": "the and of to is was for with that this it are you they there before what from not have",
    "jv": "sing lan ing iki kuwi ora wis saka karo nanging saiki dadi neng luwih padha ana",
    "su": "nu sareng di ti teu tos mah keur anu ka téh ayeuna aya pisan kana naha",
    "nl": "de het een en van er is niet maar voor dat wij bij je zijn nog heel wat",
    "de": "der die das und ist nicht ein eine für mit uns bei man von wir zu sehr aber",
    "ru": "и в на не что у там это но очень для до как",
    "ar": "في من إلى هذا على لا و جدًا قال",
    "zh": "的 了 是 我们 这 不 在 有 都",
    "ja": "の は が です ます した い に を で",
    "th": "ที่ และ ไม่ มาก ร้าน ค่ะ ครับ",
}

_SKIP = regex.compile(r"https?://\S+|www\.\S+|\S+\.example\S*|[@#][\w.]+|\S+@\S+")
_WORD = regex.compile(r"[\p{Han}々]+|[\p{Hiragana}\p{Katakana}ー]+|\p{Thai}+|[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_FOREIGN = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}\p{Arabic}\p{Cyrillic}]")
# Scripts whose letters name a language where no n-gram does.
_SCRIPTS = {"zh": regex.compile(r"\p{Han}"), "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "th": regex.compile(r"\p{Thai}"), "ar": regex.compile(r"\p{Arabic}"), "ru": regex.compile(r"\p{Cyrillic}")}
#: A run of Latin words long enough to be a sentence beside another script.
_LATIN_RUN = regex.compile(r"(?:[\"“(]?\b\p{Latin}[\p{Latin}\p{M}'’.-]*[\s,;:.!?\"”)\p{N}/]*){4,}")


def words_of(text: str) -> list[str]:
    if "@" in text or "#" in text or "www." in text or "://" in text or ".example" in text:
        text = _SKIP.sub(" ", text)
    return _WORD.findall(text.lower())


def by_script(text: str) -> int:
    """The likeliest language of the script that most letters of a text's words have: the first for Latin and others."""
    letters = "".join(words_of(text))
    n = {lang: len(script.findall(letters)) for lang, script in _SCRIPTS.items()}
    if n["ja"]:
        n["ja"], n["zh"] = n["ja"] + n["zh"], 0
    most = max(n, key=n.__getitem__)
    return LANGUAGES.index(most) if n[most] > len(letters) - sum(n.values()) else 0


def grams(word: str) -> list[str]:
    """A word's n-grams: itself and pieces of three and four letters, or of one and two where nothing parts words."""
    if _UNSPACED.match(word):
        return [*word, *(word[i : i + 2] for i in range(len(word) - 1)), *(word[i : i + 4] for i in range(len(word) - 3))]
    padded = f"_{word}_"
    return [f"={word}", *(padded[i : i + n] for n in (3, 4) for i in range(len(padded) - n + 1))]


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self) -> None:
        self.slots = np.zeros(SLOTS, np.uint16)
        self.size = [0] * len(LANGUAGES)

    @staticmethod
    def places(gram: str) -> list[int]:
        h = xxhash.xxh3_64_intdigest(gram)  # three slots of 19 bits each
        return [h & _SLOT, h >> 19 & _SLOT, h >> 38 & _SLOT]

    def add(self, gram: str, lang: int) -> None:
        for p in self.places(gram):
            self.slots[p] |= 1 << lang

    def languages(self, gram: str) -> int:
        mask = (1 << len(LANGUAGES)) - 1
        for p in self.places(gram):
            mask &= int(self.slots[p])
        return mask

    def false_rates(self) -> list[float]:
        """Chance, for each language, that an n-gram that was never added is found."""
        return [float(np.count_nonzero(self.slots >> i & 1) / SLOTS) ** HASHES for i in range(len(LANGUAGES))]


def fit(rows: list[tuple[str, str]]) -> Filters:
    """Filters from (lang, text) of labelled documents."""
    have: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
    docs: Counter = Counter()
    for lang, text in rows:
        if lang in have:
            docs[lang] += 1
            have[lang].update({g for w in set(words_of(text)) for g in grams(w)})
    share: dict[str, dict[int, float]] = defaultdict(dict)
    for i, lang in enumerate(LANGUAGES):
        least = max(2 if docs[lang] >= 20 else 1, LEAST_SHARE * docs[lang])
        for g, n in have[lang].items():
            if n >= least:
                share[g][i] = n / docs[lang]
    out = Filters()
    for g, by in share.items():
        most = max(by.values())
        for i, s in by.items():
            if s >= LEAST_RATIO * most:
                out.add(g, i)
    for i, lang in enumerate(LANGUAGES):
        for w in SEEDS[lang].split():
            # a seed word counts for its language whatever was fitted
            for g in grams(w)[:1] if not _UNSPACED.match(w) else [w]:
                out.add(g, i)
    return out


class Detector:
    def __init__(self, filters: Filters) -> None:
        self.slots = array("H", filters.slots.tobytes())
        self.rates = np.array(filters.false_rates())
        self.seen: dict[str, np.ndarray] = {}
        self.by_mask: dict[int, np.ndarray] = {0: np.zeros(len(LANGUAGES))}

    def share(self, mask: int) -> np.ndarray:
        """What an n-gram found in these languages counts for each: rarer sharing more, less the false positives."""
        hit = self.by_mask.get(mask)
        if hit is None:
            bits = np.array([mask >> i & 1 for i in range(len(LANGUAGES))], float)
            hit = self.by_mask[mask] = math.log2(len(LANGUAGES) / mask.bit_count()) * np.maximum(bits - self.rates, 0)
        return hit

    def evidence(self, word: str) -> np.ndarray:
        """Corrected, weighted popcount of a word's n-grams for each language."""
        hit = self.seen.get(word)
        if hit is None:
            gs, slots, masks, digest = grams(word), self.slots, [], xxhash.xxh3_64_intdigest
            for g in gs:
                h = digest(g)
                mask = slots[h & _SLOT]
                if mask:  # the other slots matter only then
                    mask &= slots[h >> 19 & _SLOT]
                    if mask:
                        mask &= slots[h >> 38 & _SLOT]
                masks.append(mask)
            part = 0.5 / math.sqrt(len(gs))
            total = np.zeros(len(LANGUAGES))
            for mask, n in Counter(masks).items():
                if mask:
                    total += n * part * self.share(mask)
            if gs[0][0] == "=" and masks[0]:
                total += (2.0 - part) * self.share(masks[0])
            if len(self.seen) > 300_000:
                self.seen.clear()
            hit = self.seen[word] = total
        return hit

    def pieces(self, text: str) -> list[str]:
        """Sentences, cut once more where a run of Latin words stands beside another script."""
        out = []
        for a, b in segment(text):
            s = text[a:b]
            if _FOREIGN.search(s):
                at = 0
                for m in _LATIN_RUN.finditer(s):
                    if m.start() > at and _FOREIGN.search(s, at, m.start()):
                        out.append(s[at : m.start()])
                        at = m.start()
                    if _FOREIGN.search(s, m.end()):
                        out.append(s[at : m.end()])
                        at = m.end()
                s = s[at:]
            if s:
                out.append(s)
        return out

    def passages(self, text: str) -> list[tuple[int, float, int]]:
        """(language, confidence, sentences) of the passages of a text; without any evidence one by its letters alone."""
        scores = []
        for piece in self.pieces(text):
            ws = words_of(piece)
            if ws:
                scores.append(np.sum([self.evidence(w) for w in ws], axis=0))
        if not scores:
            return []
        best, back = scores[0].copy(), []
        for s in scores[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - CHANGE
            back.append([i if stay[i] else top for i in range(len(LANGUAGES))])
            best = np.where(stay, best, best[top] - CHANGE) + s
        path = [int(best.argmax())]
        if best[path[0]] <= 0:
            return [(by_script(text), 0.0, len(scores))]
        for b in reversed(back):
            path.append(b[path[-1]])
        path.reverse()
        out: list[list] = []
        for lang, s in zip(path, scores):
            if out and out[-1][0] == lang:
                out[-1][1] += s
                out[-1][2] += 1
            else:
                out.append([lang, s.copy(), 1])
        done = []
        for lang, s, n in out:
            rest = np.delete(s, lang).max()
            done.append((lang, float(s[lang] / (s[lang] + max(rest, 0.0))) if s[lang] > 0 else 0.0, n))
        return done


def code(c: Column) -> Column:
    """The language that a tag names, null for none."""
    known = F.create_map(*[F.lit(x) for lang, names in CODES.items() for n in names.split() for x in (n, lang)])
    raw = F.regexp_replace(F.lower(F.trim(c)), r"[-_].*$", "")
    whole = F.lower(F.trim(c))
    named = F.coalesce(F.try_element_at(known, whole), F.try_element_at(known, raw), raw)
    return F.when(named != "", named)


def fit_rows(documents: DataFrame, most: int = FIT_ROWS) -> list[tuple[str, str]]:
    """FIT_CHARS characters of at most ``most`` labelled documents of each of LANGUAGES, by smallest hash of the id; a
    fixed number in all."""
    from pyspark.sql.window import Window

    d = documents.select("doc_id", code(F.col("lang")).alias("lang"), "text").filter(F.col("lang").isin(LANGUAGES) & (F.length(F.trim("text")) > 0))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("fit")), 1)  # 63 bits
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the hash keeps about four times as many as needed before anything is ranked
    keep = F.lit(False)
    for lang, n in sorted(sizes.items()):
        keep = keep | ((F.col("lang") == lang) & (h <= share_of_hash(most, n)))
    ranked = d.filter(keep).select("lang", F.substring("text", 1, FIT_CHARS).alias("text"), F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", "text")).alias("k"))
    return [(r["lang"], r["text"]) for r in ranked.filter(F.col("k") <= most).select("lang", "text").collect()]


def share_of_hash(most: int, n: int) -> int:
    """The 63-bit hash up to which about four times ``most`` of ``n`` rows lie."""
    return (1 << 63) - 1 if 4 * most >= n else 4 * most * ((1 << 63) - 1) // n


def passages(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(row_id, seen, langs, confidences): the languages of a record's passages in text order, and its text's hash."""
    filters = rows.sparkSession.sparkContext.broadcast(fit(fit_rows(documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(filters.value)
        for batch in batches:
            found = [detector.passages(t) for t in batch.column(1).to_pylist()]
            seen = pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in batch.column(1).to_pylist()], pa.int64())
            langs = pa.array([[LANGUAGES[x[0]] for x in f] for f in found], pa.list_(pa.string()))
            sure = pa.array([[x[1] for x in f] for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), seen, langs, sure], ["row_id", "seen", "langs", "confidences"])

    return rows.filter("text IS NOT NULL").select(F.col("row_id").cast("bigint").alias("row_id"), "text").mapInArrow(run, "row_id bigint, seen bigint, langs array<string>, confidences array<double>")


def latest_tags(tags: DataFrame) -> DataFrame:
    """(row_id, tag): the language that the latest tag of a record names."""
    last = tags.groupBy("row_id").agg(F.max(F.struct("tagged_at", "lang")).alias("t"))
    return last.select("row_id", code(F.col("t.lang")).alias("tag"))


def labelled(rows: DataFrame, tags: DataFrame, documents: DataFrame) -> DataFrame:
    """(row_id, seg_no, lang, confidence, n_segments, tag): every passage of every record."""
    # of several texts under one id the one of smallest hash is the record
    seen = passages(rows, documents).groupBy("row_id").agg(F.min(F.struct("seen", "langs", "confidences")).alias("x")).select("row_id", "x.langs", "x.confidences").join(latest_tags(tags), "row_id", "left")
    return seen.select("row_id", "tag", F.size("langs").cast("bigint").alias("n_segments"), F.posexplode(F.arrays_zip("langs", "confidences")).alias("i", "s")).select("row_id", (F.col("i") + 1).cast("bigint").alias("seg_no"), F.col("s.langs").alias("lang"), F.col("s.confidences").alias("confidence"), "n_segments", "tag")


def found(rows: DataFrame, tags: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages of records whose tag is missing or wrong, or whose text changes its language."""
    out = labelled(rows, tags, documents)
    return out.filter((F.col("n_segments") > 1) | F.col("tag").isNull() | (F.col("tag") != F.col("lang"))).select("row_id", "seg_no", "lang")

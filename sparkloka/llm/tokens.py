"""Token ids of a whole corpus by a public byte-level BPE vocabulary, with forced-boundary splitting.

A merge can only join bytes that stand next to each other inside some vocabulary token. So where two neighbouring
bytes stand next to each other in no token, no merge ever crosses, and a text may be cut there. Cuts are taken only where
they can't change the pre-split either (between characters of one kind, or before a single space). The fragments repeat,
so each distinct one is encoded once a worker, and a text's ids are its fragments' ids one after another.

Defined results: null and empty texts have no ids; strings that look like special tokens are ordinary text; blank texts
are encoded as they are; repeated documents are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-split of this family of vocabularies.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k"
#: Distinct fragments a worker keeps.
CACHE = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file of a public tokenizer: in $PUBLIC_TOKENIZERS, else in the installed package of that name."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, f"{name}.tiktoken")
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}


def inner_pairs(ranks: dict[bytes, int]) -> frozenset[tuple[int, int]]:
    """All pairs of bytes that stand next to each other inside some token."""
    return frozenset(p for token in ranks for p in zip(token, token[1:]))


class Encoder:
    """Encodes texts by fragments between forced boundaries."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = load_ranks(vocabulary)
        self.pairs = inner_pairs(ranks)
        self.bpe = tiktoken.Encoding("own", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, list[int]] = {}
        # a space after a visible character ends a piece for certain, if one visible character follows it
        spaced = all((a, 0x20) not in self.pairs for a in range(256) if a not in (0x20, 0x09, 0x0A, 0x0D))
        self.cut = regex.compile(r"(?<=[^\s]) (?=[^\s])") if spaced else None
        self.dense = regex.compile(r"[^\x00-\x7F]{8,}")
        self.kind = regex.compile(r"(\p{L})|(\p{N})|(\s)|(')")

    def forced(self, a: str, b: str) -> bool:
        """Whether a text may be cut between these two neighbouring characters."""
        ka, kb = self.kind.match(a), self.kind.match(b)
        ka, kb = (ka.lastindex if ka else 0), (kb.lastindex if kb else 0)
        return ka == kb and ka not in (3, 4) and (a.encode("utf-8", "replace")[-1], b.encode("utf-8", "replace")[0]) not in self.pairs

    def fragments(self, text: str) -> list[str]:
        if self.cut is None:
            parts = [text]
        else:
            parts, at = [], 0
            for m in self.cut.finditer(text):
                parts.append(text[at : m.start()])
                at = m.start()
            parts.append(text[at:])
        out: list[str] = []
        for part in parts:
            if len(part) < 8 or part.isascii() or not self.dense.search(part):
                out.append(part)
                continue
            at = 0
            for i in range(1, len(part)):
                if i - at >= 4 and self.forced(part[i - 1], part[i]):
                    out.append(part[at:i])
                    at = i
            out.append(part[at:])
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        seen = self.seen
        for f in self.fragments(text):
            hit = seen.get(f)
            if hit is None:
                hit = self.bpe.encode_ordinary(f)
                if len(f) <= 64:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[f] = hit
            ids += hit
        return ids


_encoders: dict[str, Encoder] = {}


def _encoder(digest: str, vocabulary: Broadcast) -> Encoder:
    """The encoder of a vocabulary, made once a worker."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(vocabulary.value)
    return _encoders[digest]


def _mapper(vocabulary: Broadcast, digest: str, keep: int, count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(digest, vocabulary)
        for batch in batches:
            texts = batch.column(keep).to_pylist()
            kept = [batch.column(i) for i in range(keep)]
            names = batch.schema.names[:keep]
            if count_only:
                made = pa.array([len(enc.encode(t)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, made], [*names, "n_tokens"])
            else:
                made = pa.array([enc.encode(t) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept, made], [*names, "ids"])

    return run


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, count_only: bool = False) -> DataFrame:
    """``keep`` columns with ``ids`` (array of int), or with ``n_tokens`` (bigint).

    The vocabulary's file (about a megabyte) is read where this is called and sent to the workers."""
    lines = Path(path or vocabulary_path()).read_bytes()
    sent = docs.sparkSession.sparkContext.broadcast(lines)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    made = "n_tokens bigint" if count_only else "ids array<int>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_mapper(sent, hashlib.md5(lines).hexdigest(), len(keep), count_only), f"{schema}, {made}")

"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text's symbols are its characters. An agenda holds the adjacent pairs whose
concatenation is a piece, ordered by score and then by place; the best pair is
merged, its new neighbours enter the agenda, until none is left. Symbols that
are no piece become their UTF-8 bytes.

Merges never reach across a place that no piece contains, so texts are encoded
part by part: cut before a run of word marks, and around characters that occur
in no piece of several characters. The parts seen so far are kept in a bounded
cache. Every part is checked against the sentencepiece library once, when it is
first encoded, all new parts of an Arrow batch in one call.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.schemas import extended

#: The word mark that stands for a space.
MARK = "▁"
#: Parts in the cache of a worker, at most; some 300 bytes each.
CACHE_PARTS = 200_000
#: Share of them, in percent, that stays when the cache is full: those seen first, which are mostly the frequent ones.
KEPT_SHARE = 60
#: Parts that stay when a task ends.
KEPT_PARTS = 30_000
#: Texts encoded at a time, so that what a batch adds to the cache is bounded.
BLOCK_CHARS = 2_000_000
#: Longest part kept in the cache.
CACHE_CHARS = 40
#: Characters of a part whose agenda is a plain list; longer ones take a heap.
SHORT = 32
NONE = float("inf")


class Codec:
    """Encoder and decoder of one vocabulary file; ``check`` compares with the library."""

    def __init__(self, model: str, check: bool = True):
        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.cost = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.hidden = {i for i in range(n) if lib.is_control(i)}
        self.odd = self.hidden | set(self.of_byte)
        several = [p for p in self.ids if len(p) > 1]
        if len(self.byte) != 256 or any(MARK in p.lstrip(MARK) for p in several) or lib.encode("a")[0] != lib.encode(" a")[1]:
            raise ValueError(f"{model}: only merge vocabularies with byte fallback, word marks in front and a dummy prefix are read")
        self.split = _splitter(several)
        self.lib = lib if check else None
        self.seen: dict[str, str] = {}
        self.changed: dict[str, str] = {}  # decoded parts that differ from what was encoded

    def merge(self, part: str) -> list[int]:
        """The ids of one part, by the agenda of its adjacent pairs."""
        symbols = self.short_agenda(list(part)) if len(part) <= SHORT else self.long_agenda(list(part))
        ids = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                ids.append(i)
            else:
                ids.extend([self.byte[b] for b in s.encode()])
        return ids

    def short_agenda(self, symbols: list[str]) -> list[str]:
        """A list with the cost of every pair in place; the least, and of equals the first, is merged."""
        get = self.cost.get
        agenda = [get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while agenda and (best := min(agenda)) is not NONE:
            i = agenda.index(best)
            merged = symbols[i] + symbols.pop(i + 1)
            symbols[i] = merged
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(merged + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + merged, NONE)
        return symbols

    def long_agenda(self, symbols: list[str]) -> list[str]:
        """The same with a heap, for parts of any length."""
        get, n = self.cost.get, len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or right[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of them has changed since
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (c := get(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(agenda, (c, i, k, len(symbols[i]) + len(symbols[k])))
            k = left[i]
            if k >= 0 and (c := get(symbols[k] + symbols[i])) is not None:
                heapq.heappush(agenda, (c, k, i, len(symbols[k]) + len(symbols[i])))
        return [s for s in symbols if s]

    def parts(self, text: str) -> list[str]:
        """The parts of a normalised text: a word mark in front, and one for each space."""
        return self.split.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, parts: set[str]) -> dict[str, str]:
        """The ids of each part, joined by commas, from the cache or new in it."""
        if len(self.seen) + len(parts) > CACHE_PARTS:
            self.trim(CACHE_PARTS * KEPT_SHARE // 100)
        new = [p for p in parts if p not in self.seen]
        ids = [self.merge(p) for p in new]
        if self.lib is not None:
            self.compare(new, ids)
        for p, x in zip(new, ids, strict=True):
            self.seen[p] = ",".join(map(str, x))
            if (back := self.decode_part(x)) != p:
                self.changed[p] = back
        return self.seen

    def decoded(self, parts: list[str]) -> str:
        """The text that the ids of learnt parts decode to."""
        return _plain("".join([self.changed.get(p, p) for p in parts] if self.changed else parts))

    def forget(self, parts: list[str]) -> None:
        """Keep long parts out of the cache."""
        for p in parts:
            if len(p) > CACHE_CHARS:
                self.seen.pop(p, None)
                self.changed.pop(p, None)

    def trim(self, keep: int | None = None) -> None:
        """Keep the parts seen first, by default few; a worker that has no more texts to encode is used by other stages."""
        self.seen = dict(islice(self.seen.items(), KEPT_PARTS if keep is None else keep))
        self.changed = {p: back for p, back in self.changed.items() if p in self.seen}

    def compare(self, parts: list[str], ids: list[list[int]]) -> None:
        """Raise unless the library gives the same ids; it adds a word mark, which parts without one go without."""
        dummy = self.ids[MARK]
        marked = [p[1:] if p[0] == MARK else "\n" + p for p in parts]
        head = [dummy, self.byte[10]]
        for p, mine, theirs in zip(parts, ids, self.lib.encode(marked, num_threads=1), strict=True):
            if (mine if p[0] == MARK else head + mine) != (theirs if len(p) > 1 or p[0] != MARK else [dummy]):
                raise ValueError(f"{p!r}: {mine}, but the library gives {theirs}")

    def decode_part(self, ids: list[int]) -> str:
        """Ids to text, word marks left as they are."""
        if not any(map(self.odd.__contains__, ids)):
            return "".join(map(self.pieces.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i not in self.hidden:
                out.append(self.pieces[i])
        out.append(_utf8(run))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.merge(p)]

    def decode(self, ids: list[int]) -> str:
        return _plain(self.decode_part(ids))


def _plain(text: str) -> str:
    """Marks to spaces; the one that the encoder put in front goes."""
    return text.replace(MARK, " ").removeprefix(" ")


def _utf8(run: bytearray) -> str:
    """Bytes to text; every byte that belongs to no character becomes U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + size]).decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


def _splitter(several: list[str]) -> re.Pattern:
    """A pattern that cuts a text into parts between which no piece reaches.

    Letters, and all that follows them in a piece, are one class; a part ends
    after a run of that class, before a run of marks, and around characters
    that are in no piece of several characters.
    """
    after: dict[str, set[str]] = {}
    for p in several:
        for a, b in zip(p, p[1:]):  # noqa: B905
            after.setdefault(a, set()).add(b)
    used = set("".join(several)) - {MARK}
    word = {c for c in used if c.isalpha()}
    while more := {b for a in word for b in after.get(a, ())} - word:
        word |= more
    word, other = (re.escape("".join(sorted(x))) for x in (word, used - word))
    return re.compile(f"{MARK}*[{other}]*[{word}]+|{MARK}*[{other}]+|{MARK}+|." if other else f"{MARK}*[{word}]+|{MARK}+|.", re.DOTALL)


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(model: str, check: bool = True) -> Codec:
    """One codec a worker for each vocabulary file."""
    if (model, check) not in _codecs:
        _codecs[model, check] = Codec(model, check)
    return _codecs[model, check]


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _encoded(texts: list[str | None], c: Codec) -> Iterator[tuple[int, str, str]]:
    """(number of ids, ids joined by commas, decoded text) of each text."""
    for block in _blocks(texts):
        cut = [c.parts(t) for t in block]
        got = c.learn(set(chain.from_iterable(cut)))
        for parts in cut:
            ids = ",".join(map(got.__getitem__, parts))
            yield ids.count(",") + bool(ids), ids, c.decoded(parts)
        for parts in cut:
            c.forget(parts)


def sentencepiece_encode(docs: DataFrame, model: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with the columns ``ids`` (array<int>) and ``decoded`` (string).

    ``model`` names a vocabulary file that every executor can open. No begin or
    end ids. Null and empty texts have no ids and decode to "". Columns of these
    two names are replaced, all others stay; rows are neither lost nor merged.
    With ``check`` a difference to the library fails the job.
    """
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, check)
        for batch in batches:
            for at in range(0, max(len(batch), 1), 500):
                part = batch.slice(at, 500)
                rows = list(_encoded(part.column(part.schema.get_field_index("__text")).to_pylist(), c))
                ids = pa.array([[int(i) for i in r[1].split(",")] if r[1] else [] for r in rows], pa.list_(pa.int32()))
                columns = [part.column(part.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.array([r[2] for r in rows], pa.string())], [*keep, "ids", "decoded"])
        c.trim()

    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = extended(docs.select(*keep), "ids array<int>, decoded string")
    return source.mapInArrow(run, schema)


def sentencepiece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of what ``sentencepiece_encode`` gives.

    The same encoder, without sending the ids back to Spark. Null and empty
    texts have no tokens and the digests of the empty string.
    """

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, check)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [(n, digest(ids), digest(text)) for n, ids, text in _encoded(part.column(1).to_pylist(), c)]
                n, ids, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.trim()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = extended(source.select("doc_id"), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return source.mapInArrow(run, schema)

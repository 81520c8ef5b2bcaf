"""Byte-level BPE encoding through the ``tokenizers`` library, with reuse.

A byte-level BPE never merges across pre-tokens, and a space that follows a
non-space character always starts a pre-token. So a text is cut at those
spaces, the ids of each chunk are looked up, and only pre-tokens not seen
before by this worker reach the library's model. The ids are those
of encoding the whole text at once. A text with one of the tokenizer's own
added strings goes to the library whole, as does every text of a tokenizer of
another kind.

Texts of a batch are encoded together: their chunks are split and numbered by
Arrow, each distinct chunk is looked up once, and the ids are gathered by place.
Batches are cut by bytes, so memory is bounded by the longest text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pre-token pattern of this family of byte-level vocabularies.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its words beyond so many; a tight one keeps those of its last two turns, of so many each.
MAX_WORDS, TIGHT_WORDS = 1_000_000, 300_000
#: White space besides the space and the line feed.
_ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r"(?<=\S) ")
#: Spaces that start no pre-token, or lie at an end: texts with them are encoded one by one.
_UNEVEN = "  |^ | $|[\n" + "".join(f"\\x{{{ord(c):x}}}" for c in _ODD_SPACES) + "] "
#: Texts are encoded together up to so many bytes.
SLICE, TIGHT_SLICE = 8 << 20, 2 << 20
#: Marks that often follow a word; each is a pre-token where nothing else follows it.
_MARKS = frozenset(".,;:!?")
#: The commonest chunks besides these and plain words: a word and marks, perhaps with the first word of the next line.
_WORD_MARKS = re.compile(r"([^\W\d_]+)([^\w\s]+)(?:\n([^\W\d_]+)([^\w\s]*))?\Z")


class _Pieces(dict):
    """Pre-token -> its ids. ``old`` has those of the turn before."""

    def __init__(self, tokenizer, old: dict[str, bytes]):
        self.tokenizer, self.table, self.old = tokenizer, _byte_alphabet(), old
        self.space = chr(self.table[0x20])

    def encode(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]).tobytes()

    def encode_word(self, word: str) -> bytes:
        """Ids of a space and a word of letters."""
        if word.isascii():
            return array("I", [t.id for t in self.tokenizer.model.tokenize(self.space + word)]).tobytes()
        return self.encode(" " + word)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        ids = self[piece] = self.encode(piece) if ids is None else ids
        return ids


class _Words(dict):
    """Chunk without its leading space -> ids of the chunk with it. Only words of letters are kept; ``old`` has those of the turn before."""

    def __init__(self, pieces: _Pieces, pattern, old: dict[str, bytes]):
        self.pieces, self.pattern, self.old = pieces, pattern, old

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.old.get(chunk)) is not None:
            self[chunk] = ids
            return ids
        if chunk[-1:] in _MARKS and (word := chunk[:-1]).isalpha():
            return self[word] + self.pieces[chunk[-1]]
        if chunk.isalpha():
            ids = self[chunk] = self.pieces.encode_word(chunk)
            return ids
        if (m := _WORD_MARKS.match(chunk)) and m[1].isalpha() and (not m[3] or m[3].isalpha()):
            ids = self[m[1]] + self.pieces[m[2]]
            return ids + self.pieces["\n"] + self.pieces[m[3]] + (self.pieces[m[4]] if m[4] else b"") if m[3] else ids
        cut = self.pattern.findall(" " + chunk)
        return b"".join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.pieces[p] for p in cut])


def _strings(chunks: pa.Array) -> list[str]:
    """``chunks``, none of which holds a space, as Python's strings: joined and split, not one by one."""
    if not len(chunks):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(chunks)], pa.int64()), chunks)
    return pc.binary_join(whole, pa.scalar(" ", chunks.type))[0].as_py().split(" ")


def _odd_space(text: str) -> bool:
    return any(c in text and c + " " in text for c in _ODD_SPACES)


def _byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, tight: bool = False):
        self.tight, self.slice = tight, TIGHT_SLICE if tight else SLICE
        self.most = TIGHT_WORDS if tight else MAX_WORDS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.chunked = (
            spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        self.pieces, self.words = {}, {}
        self._turn()

    def _turn(self) -> None:
        """A new turn: words and pre-tokens of this one stay, those of the one before go."""
        for kept in (self.pieces, self.words):
            if isinstance(kept, (_Pieces, _Words)):
                kept.old = {}
        if not self.tight:
            self.pieces, self.words = {}, {}
        self.pieces = _Pieces(self.tokenizer, self.pieces)
        self.words = _Words(self.pieces, regex.compile(PRE_TOKEN), self.words)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.chunked or any(a in text for a in self.added):
            return self.whole(text)
        chunks = text.split(" ")
        if "" in chunks or "\n " in text or _odd_space(text):
            chunks = _CUT.split(text)
        head = chunks.pop(0)
        first = b"".join([self.pieces[p] for p in self.words.pattern.findall(head)])
        ids = b"".join([first, *map(self.words.__getitem__, chunks)])
        if len(self.words) + len(self.pieces) > self.most:
            self._turn()
        return ids


    def _together(self, texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """For texts of even spaces: the ids of their distinct chunks, how many each has, each chunk's number by place, and where texts end."""
        split = pc.split_pattern(texts, " ")
        values, ends = split.values, split.offsets.to_numpy()
        coded = values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        ends = ends - ends[0]
        place = coded.indices.to_numpy().copy()
        parts = list(map(self.words.__getitem__, _strings(coded.dictionary)))
        # The first chunk of a text has no space before it.
        place[ends[:-1]] = np.arange(len(parts), len(parts) + len(texts))
        pieces, find = self.pieces, self.words.pattern.findall
        parts += [b"".join([pieces[p] for p in find(head)]) for head in values.take(pa.array(split.offsets.to_numpy()[:-1])).to_pylist()]
        if len(self.words) + len(self.pieces) > self.most:
            self._turn()
        sizes = np.fromiter(map(len, parts), "i8", len(parts)) // 4
        return b"".join(parts), sizes, place, ends

    def _slices(self, texts: pa.Array):
        """``rows, even`` by turns: stretches of texts, and which of them are encoded together."""
        texts = pc.fill_null(texts, "")
        even = pc.invert(pc.match_substring_regex(texts, _UNEVEN)) if self.chunked else pa.array(np.zeros(len(texts), bool))
        for a in self.added:
            even = pc.and_(even, pc.invert(pc.match_substring(texts, a)))
        even, bytes_ = even.to_numpy(zero_copy_only=False), pc.binary_length(texts).to_numpy()
        cut = np.flatnonzero(np.diff(np.cumsum(bytes_) // self.slice)) + 1
        for a, b in zip([0, *cut], [*cut, len(texts)], strict=True):
            if a < b:
                yield texts.slice(int(a), int(b - a)), even[a:b]

    def encode_batch(self, texts: pa.Array):
        """``sizes, ids`` of stretches of ``texts`` in order: ids a text, and all of them as unsigned 32-bit integers."""
        for part, even in self._slices(texts):
            sizes, runs = np.zeros(len(part), "i8"), []
            if even.any():
                table, long, place, ends = self._together(part.filter(pa.array(even)))
                table, n = np.frombuffer(table, "<u4"), long[place]
                upto = np.concatenate([[0], np.cumsum(n)])
                kind = "i4" if upto[-1] < 1 << 31 else "i8"
                shift = (np.concatenate([[0], np.cumsum(long)])[place] - upto[:-1]).astype(kind)
                at = np.repeat(shift, n)
                at += np.arange(upto[-1], dtype=kind)
                ids = table[at]
                sizes[even] = np.diff(upto[ends])
            else:
                ids = np.zeros(0, "<u4")
            if even.all():
                yield sizes, ids
                continue
            odd = [np.frombuffer(self.encode(t), "<u4") for t in part.filter(pa.array(~even)).to_pylist()]
            sizes[~even] = [len(o) for o in odd]
            at, place = 0, iter(odd)
            edges = np.flatnonzero(np.diff(even.astype("i1"))) + 1
            for a, b in zip([0, *edges], [*edges, len(part)], strict=True):
                if even[a]:
                    n = int(sizes[a:b].sum())
                    runs.append(ids[at : at + n])
                    at += n
                else:
                    runs += [next(place) for _ in range(b - a)]
            yield sizes, np.concatenate(runs)

    def count_batch(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for part, even in self._slices(texts):
            sizes = np.zeros(len(part), "i8")
            if even.any():
                _, long, place, ends = self._together(part.filter(pa.array(even)))
                sizes[even] = np.diff(np.concatenate([[0], np.cumsum(long[place])])[ends])
            if not even.all():
                sizes[~even] = [len(self.encode(t)) // 4 for t in part.filter(pa.array(~even)).to_pylist()]
            out.append(sizes)
        return np.concatenate(out) if out else np.zeros(0, "i8")


@lru_cache(maxsize=4)
def encoder(path: str, tight: bool = False) -> TextEncoder:
    """One encoder per worker process, file and version."""
    return TextEncoder(path, tight)

"""Byte-level and word-end BPE through the ``tokenizers`` library, cached per worker.

Both encoders rest on one fact: at many places of a text these vocabularies' pre-tokenizers
are bound to cut, whatever stands around. Pieces between such places encode independently,
so a piece met before costs one lookup. Texts that hold special strings or white space beyond
ASCII are one piece each; ids and counts always equal the library's on the whole text.
"""

from __future__ import annotations

import os
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxmill.llm._common import worker_cache


class Limits(NamedTuple):
    """Of the pieces that a worker remembers: how many, and how long in bytes."""

    pieces: int = 150_000
    longest: int = 64


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: pa.Array, most: int = 2_000_000):
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


#: Classes of bytes. ``_OTHER`` may be a letter, a digit or a mark (control characters, most of what is not ASCII).
_LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _SPACE, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x27], _CLASS[0x20], _CLASS[0x09:0x0E] = _QUOTE, _BLANK, _SPACE
#: Whether a pre-token ends between two classes, as 8 * first + second; 2: of two white space characters, if no third follows.
_CUTS = np.zeros(64, np.uint8)
for _a in (_LETTER, _DIGIT, _MARK, _QUOTE, _OTHER):
    _CUTS[[8 * _a + _BLANK, 8 * _a + _SPACE]] = 1
    _CUTS[8 * _SPACE + _a] = 1  # a blank goes with what follows it
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _MARK), (_DIGIT, _QUOTE), (_MARK, _LETTER), (_MARK, _DIGIT), (_QUOTE, _DIGIT)):
    _CUTS[8 * _a + _b] = 1  # not between a quote and a letter, which may be a contraction
for _a in (_BLANK, _SPACE):
    _CUTS[[8 * _a + _BLANK, 8 * _a + _SPACE]] = 2
#: Bytes with which characters beyond ASCII that are white space begin.
_LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII (and of some marks without width)."""
    at = np.flatnonzero(_LEADS[data])
    first, second, third = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(3))
    code = (first << 16) | (second << 8) | np.where(first == 0xC2, 0, third)
    space = np.isin(code, (0xC28500, 0xC2A000, 0xE19A80, 0xE1A08E, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
    return at[space | ((code >= 0xE28080) & (code <= 0xE2808F))]


def cut(texts: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts, one text after the other, and the first piece of each text (and the end).

    A text with a special string or with white space beyond ASCII is one piece. A null is empty.
    """
    texts = pc.fill_null(texts, "")
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - low
    if not n:
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(held, np.uint8)[low : low + n]
    kind = _CLASS[data]
    # Latin letters with accents and Cyrillic ones, two bytes each; not the signs of times and division
    lead = np.flatnonzero((data == 0xC3) | (data == 0xD0) | (data == 0xD1))
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = _LETTER
    step = np.zeros(n, np.uint8)
    step[1:] = _CUTS[(kind[:-1] << np.uint8(3)) | kind[1:]]
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(offsets, _wide_space(data), "right") - 1] = True
    for s in special:
        odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False).astype(bool)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    # of a run of white space the last character stands apart, unless it ends the text
    pairs = np.flatnonzero(step == 2)
    after = np.append(kind, _SPACE)[pairs + 1]
    step[pairs[(after == _BLANK) | (after == _SPACE) | begins[pairs + 1]]] = 0
    for i in np.flatnonzero(odd):
        step[offsets[i] : offsets[i + 1]] = 0
    places = np.flatnonzero((step > 0) | begins[:n])
    ends = np.append(places, n).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(data))
    return pieces, np.searchsorted(places, offsets)


class Pieces:
    """What a worker knows of pieces: how many tokens, and which. Bounded; the first ``fixed`` ones stay for good.

    ``learn`` takes strings (Arrow) and returns their sizes and ids (or None). When the table is
    full the half that was used least goes.
    """

    def __init__(self, learn, limits: Limits, words: list[str] | None = None, sizes=None):
        self.learn, self.limits, self.fixed = learn, limits, len(words or [])
        self.words, self.size = pa.array(words or [], pa.string()), np.array(sizes if words else [], np.int64)
        self.begin, self.uses = np.zeros(self.fixed, np.int64), np.zeros(self.fixed, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def find(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each piece a number; by number its size and where its ids begin in the last array, the pool."""
        known = len(self.words)
        both = pa.concat_arrays([self.words, pieces]).dictionary_encode()
        index = both.indices.to_numpy()[known:]
        fresh = both.dictionary[known:]
        size, begin, pool = self.size, self.begin, self.pool
        if len(fresh):
            more, ids = self.learn(fresh)
            size = np.concatenate([size, more])
            if ids is not None:
                begin = np.concatenate([begin, len(pool) + np.cumsum(more) - more])
                pool = np.concatenate([pool, ids])
            else:
                begin = np.zeros(len(size), np.int64)
        uses = np.bincount(index, minlength=len(size))
        uses[:known] += self.uses
        short = pc.binary_length(fresh).to_numpy() <= self.limits.longest
        keep = np.concatenate([np.ones(known, bool), short])
        if keep.sum() > self.limits.pieces + self.fixed:
            free = np.flatnonzero(keep)[self.fixed :]
            keep[free[np.argsort(-uses[free], kind="stable")[self.limits.pieces // 2 :]]] = False
            uses = uses // 2
        words = both.dictionary
        if not keep.all():
            words = words.filter(pa.array(keep))
        self.words, self.uses, self.size, self.begin, self.pool = words, uses[keep], size[keep], begin[keep], pool
        if len(pool) > 8 * self.limits.pieces:
            ends = np.cumsum(self.size)
            self.pool = pool[np.repeat(self.begin - (ends - self.size), self.size) + np.arange(ends[-1] if len(ends) else 0)]
            self.begin = ends - self.size
        return index, size, begin, pool


#: Pieces that are one pre-token for sure and hold no digit: a run of letters or marks, with a blank before it or not.
_PLAIN = r"^ ?(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{47F}]+|[!-&(-/:-@\[-`{-~]+)$"


def _special(tok) -> list[str]:
    return sorted({t.content for t in tok.get_added_tokens_decoder().values()})


class ByteBpe:
    """Ids of whole texts."""

    def __init__(self, path: str, limits: Limits = Limits()):
        self.tok = load(path)
        if max(self.tok.get_vocab().values()) >= 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits an id")
        self.special, self.pieces = _special(self.tok), Pieces(self._learn, limits)
        from tokenizers import Tokenizer, pre_tokenizers

        (self.zero,) = self.tok.encode("0", add_special_tokens=False).ids
        self.bare = Tokenizer(self.tok.model)  # the same model
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _learn(self, missing: pa.Array):
        # a call has a price of its own: pieces of one pre-token are encoded many at a time between digits, without the pre-tokenizer's pattern
        plain = pc.match_substring_regex(missing, _PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        words = missing.filter(pa.array(plain)).to_pylist()
        groups = ["0".join(words[k : k + 32]) + "0" for k in range(0, len(words), 32)]
        flat, sizes = array("H"), []
        for e in self.bare.encode_batch_fast(groups, add_special_tokens=False):
            flat.extend(e.ids)
        joined = np.array(flat, np.uint16)
        size = np.diff(np.flatnonzero(joined == self.zero), prepend=-1) - 1
        flat = array("H", joined[joined != self.zero].tobytes())
        for e in self.tok.encode_batch_fast(missing.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False):
            ids = e.ids
            sizes.append(len(ids))
            flat.extend(ids)
        size = np.concatenate([size, np.array(sizes, np.int64)])
        back = np.argsort(order)
        begin, size = (np.cumsum(size) - size)[back], size[back]
        ends = np.cumsum(size)
        return size, np.frombuffer(flat, np.uint16)[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16, texts one after the other) and the offsets of the texts in them. A null is empty."""
        pieces, at = cut(texts, self.special)
        index, size, begin, pool = self.pieces.find(pieces)
        n = size[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(begin[index] - (ends - n), n) + np.arange(total)
        return pool[where], np.concatenate([[0], ends])[at]


class WordCounter:
    """Number of tokens of whole texts, by a table of lengths and a worker's own pieces.

    ``table`` has frequent pieces and their lengths. For vocabularies that drop white space
    and treat each letter run, digit and mark run apart.
    """

    def __init__(self, path: str, table: tuple[list[str], list[int]] | None = None, limits: Limits = Limits()):
        self.tok = load(path)
        self.special, self.pieces = _special(self.tok), Pieces(self.learn, limits, *(table or ()))

    def learn(self, missing: pa.Array):
        return np.array([len(e) for e in self.tok.encode_batch_fast(missing.to_pylist(), add_special_tokens=False)], np.int64), None

    def count(self, texts: pa.Array) -> np.ndarray:
        pieces, at = cut(texts, self.special)
        index, size, _, _ = self.pieces.find(pieces)
        return np.diff(np.concatenate([[0], np.cumsum(size[index])])[at])


def cached(kind, path: str, *args, key=None):
    """One encoder per worker process, vocabulary and ``key`` (of its table); it outlives a task."""
    return worker_cache((kind.__name__, path, key, *[a for a in args if isinstance(a, Limits)]), lambda: kind(path, *args))

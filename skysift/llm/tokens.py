"""Token ids of whole texts, a batch at a time.

Byte-pair encoding works on white-space separated words one by one, so each
different word is encoded once per Python worker and then found by its 64-bit
hash. The result equals the tokenizer's own on the whole text; words outside
plain Latin letters and printable ASCII, or holding a piece of a special token,
are encoded by the unchanged tokenizer.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from skysift.llm.arrays import LOWER, span_hashes, word_spans

# Different words that a Python worker remembers before it starts anew; bounds its memory.
REMEMBERED_WORDS = 1_000_000
# Slots of the hash table of remembered words, a power of two.
TABLE_SLOTS = 1 << 22
# Words joined for one call of the tokenizer.
WORDS_A_CALL = 256
_PLAIN_WORD = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
# Fixed value: how the vocabulary's tokenizer cuts a word into pieces, each of which ends with a word-end token.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")

# 1: letters and digits of ASCII, 2: its symbols but the apostrophe, 7: everything else.
_KIND = np.full(256, 7, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 7


class WordIds:
    """Ids of texts for one vocabulary file; one instance per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.plain = Tokenizer.from_str(json.dumps({**spec, "normalizer": None}))
        self.ends = np.zeros(self.plain.get_vocab_size(), bool)
        for token, i in self.plain.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(TABLE_SLOTS, np.uint64)
        self.slots = np.full(TABLE_SLOTS, -1, np.int32)
        self.n_words = self.n_ids = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each remembered word, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        at = (h & np.uint64(TABLE_SLOTS - 1)).astype(np.int64)
        while len(todo):
            got, same = self.slots[at], self.keys[at] == h[todo]
            hit = same & (got >= 0)
            out[todo[hit]] = got[hit]
            go_on = (got >= 0) & ~same
            todo, at = todo[go_on], (at[go_on] + 1) & (TABLE_SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        todo = np.arange(len(h))
        at = (h & np.uint64(TABLE_SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[todo[free]]  # of several for one slot the last stays
            won = free & (self.slots[at] == numbers[todo])
            self.keys[at[won]] = h[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (TABLE_SLOTS - 1)

    def _append(self, ids: np.ndarray, lens: np.ndarray) -> None:
        for name, need in (("flat", self.n_ids + len(ids)), ("start", self.n_words + len(lens) + 1)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[self.n_words + 1 : self.n_words + 1 + len(lens)] = self.n_ids + np.cumsum(lens)
        self.n_ids += len(ids)
        self.n_words += len(lens)

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        """Encode new words and remember their ids."""
        kinds = ["<|" not in w and _PLAIN_WORD.fullmatch(w) is not None for w in words]
        order: list[int] = []
        plain = [i for i, k in enumerate(kinds) if k]
        rest = [i for i, k in enumerate(kinds) if not k]
        for k in range(0, len(plain), WORDS_A_CALL * 64):
            lowered = [words[i].lower() for i in plain[k : k + WORDS_A_CALL * 64]]
            starts = range(0, len(lowered), WORDS_A_CALL)
            coded = self.plain.encode_batch_fast([" ".join(lowered[g : g + WORDS_A_CALL]) for g in starts], add_special_tokens=False)
            for g, e in zip(starts, coded, strict=True):
                group = lowered[g : g + WORDS_A_CALL]
                ids = np.asarray(e.ids, np.int32)
                last = np.cumsum([1 if _LETTERS.fullmatch(w) else len(_PIECES.findall(w)) for w in group])
                stops = np.flatnonzero(self.ends[ids]) + 1
                of = plain[k + g : k + g + len(group)]
                if len(stops) == last[-1]:
                    self._append(ids, np.diff(stops[last - 1], prepend=0))
                    order += of
                else:
                    rest += of
        for k in range(0, len(rest), 4096):
            coded = [np.asarray(e.ids, np.int32) for e in self.full.encode_batch_fast([words[i] for i in rest[k : k + 4096]], add_special_tokens=False)]
            self._append(np.concatenate(coded), np.asarray([len(x) for x in coded]))
        order += rest
        self._insert(h[order], np.arange(self.n_words - len(order), self.n_words, dtype=np.int32))

    def encode(self, buf: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes end to end) one after the other, each followed by the id `end`; n + 1 offsets."""
        if self.n_words > REMEMBERED_WORDS:
            self.forget()
        buf = LOWER[buf]
        raw = buf.tobytes()
        # Where an ASCII letter or digit meets an ASCII symbol a piece ends, so words are cut there to have fewer
        # different ones. Not at apostrophes, which may begin a contraction, and not with special tokens about.
        kind = _KIND[buf]
        cuts = np.zeros(len(buf), bool)
        if b"<|" not in raw:
            cuts[1:] = (kind[1:] + kind[:-1]) == 3
        starts, ends, first = word_spans(buf, offs, cuts)
        h = span_hashes(buf, starts, ends)
        at = self._find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            self._learn([raw[starts[i] : ends[i]].decode() for i in missing[where]], new)
            at[missing] = self._find(h[missing])
        lens = self.start[at + 1] - self.start[at]
        upto = np.concatenate([[0], np.cumsum(lens)])
        offsets = upto[first] + np.arange(len(offs))
        shift = np.repeat(self.start[at] - upto[:-1], lens)
        out = np.empty(int(offsets[-1]), np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[offsets[1:] - 1] = True
        shift += np.arange(len(shift))
        out[~is_end] = self.flat[shift]
        out[is_end] = end
        return out, offsets

    def encode_texts(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        from skysift.llm.arrays import buffer_of

        return self.encode(*buffer_of(pa.array(texts, pa.string())), end)


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)

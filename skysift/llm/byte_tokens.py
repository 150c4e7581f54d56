"""Token ids of whole texts by a byte-level vocabulary, a batch at a time.

The vocabulary's tokenizer cuts a text into pieces (a word with the blank before
it, a run of digits or symbols, white space, an English contraction) and encodes
each by itself. Here the cuts of a whole block of texts are found by vector
operations on its bytes, and each different piece is encoded once per Python
worker. Texts with characters whose kind the byte rules below do not know (all
but Latin letters, common punctuation and the characters that begin with the
same bytes), or with a special token, are encoded by the unchanged tokenizer.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from tokenizers import Tokenizer

from skysift.llm.arrays import span_hashes
from skysift.llm.tokens import REMEMBERED_WORDS, WordIds

LETTER, DIGIT, SYMBOL, BLANK, ODD = range(5)

# Pieces encoded by one call of the tokenizer.
PIECES_A_CALL = 256


def _kinds() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[33:127] = SYMBOL
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[[32, 9, 10, 13]] = BLANK
    kind[0xC3:0xCA] = LETTER  # lead bytes of U+00C0 to U+027F; what of them is no letter is told apart below
    return kind


_KIND = _kinds()
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def byte_kinds(buf: np.ndarray) -> np.ndarray:
    """Kind of the character that each byte belongs to."""
    kind = _KIND[buf]
    high = np.flatnonzero(buf >= 0x80)
    if not len(high):
        return kind
    lead = high[buf[high] >= 0xC0]
    second = buf[np.minimum(lead + 1, len(buf) - 1)]
    third = buf[np.minimum(lead + 2, len(buf) - 1)]
    first = buf[lead]
    of = kind[lead]
    # U+00D7 and U+00F7 are signs; from U+0250 on the table ends.
    of[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))] = SYMBOL
    of[(first == 0xC9) & (second > 0x8F)] = ODD
    # U+00A1 to U+00BF without letters, digits and the soft hyphen.
    sign = (first == 0xC2) & (second >= 0xA1) & ~np.isin(second, [0xAA, 0xAD, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
    of[sign] = SYMBOL
    # U+2010 to U+2027, U+2030 to U+203F and the euro sign.
    dash = (first == 0xE2) & ((second == 0x80) & ((third >= 0x90) & (third <= 0xA7) | (third >= 0xB0)) | (second == 0x82) & (third == 0xAC))
    of[dash] = SYMBOL
    kind[lead] = of
    for step in (1, 2, 3):
        at = lead + step
        ok = at < len(buf)
        at, of_at = at[ok], of[ok]
        inside = _CONTINUES[buf[at]] & ((step == 1) | (first[ok] >= (0xE0 if step == 2 else 0xF0)))
        kind[at[inside]] = of_at[inside]
    return kind


def piece_starts(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of texts end to end begin."""
    n = len(buf)
    begins = np.ones(n, bool)
    before = np.full(n, 255, np.uint8)  # kind of the byte before, none at the start of a text
    before[1:] = kind[:-1]
    text_start = offs[:-1][offs[:-1] < n]
    before[text_start] = 255
    begins[:] = kind != before
    blank = kind == BLANK
    # The last of several white spaces before a word stands apart, and if it is a blank, the word joins it.
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:]
    last[np.minimum(offs[1:][offs[1:] > 0] - 1, n - 1)] = False
    last[text_start[text_start > 0] - 1] = False
    begins |= last
    joins = np.zeros(n, bool)
    joins[1:] = (last & (buf == 32))[:-1]
    begins &= ~joins
    # 's 't 'm 'd 're 've 'll after anything but a symbol or a blank that joins the apostrophe.
    quote = np.flatnonzero((buf == 39) & begins)
    if len(quote):
        text_end = offs[np.searchsorted(offs, quote, "right")]
        a = np.where(quote + 1 < text_end, buf[np.minimum(quote + 1, n - 1)], 0)
        b = np.where(quote + 2 < text_end, buf[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(a, list(b"stmd"))
        long = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        found, size = quote[short | long], np.where(long, 3, 2)[short | long]
        begins[found + 1] = False
        stop = found + size
        inside = stop < text_end[short | long]
        begins[stop[inside]] |= kind[stop[inside]] == LETTER
    return np.flatnonzero(begins)


class ByteIds(WordIds):
    """Ids of texts for one vocabulary file; one instance per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.spaced = np.zeros(self.full.get_vocab_size(), bool)
        for token, i in self.full.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")  # how the vocabulary writes a blank
        self.forget()

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        """Encode new pieces and remember their ids."""
        order: list[int] = []
        # A blank is written as the first character of its word's first token and nowhere else, so that many
        # words go through one call and are told apart by it.
        joint = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        alone = [i for i, w in enumerate(words) if not (len(w) > 1 and w[0] == " " and not w[1].isspace())]
        starts = range(0, len(joint), PIECES_A_CALL)
        coded = self.full.encode_batch_fast(["".join(words[i] for i in joint[g : g + PIECES_A_CALL]) for g in starts], add_special_tokens=False)
        for g, e in zip(starts, coded, strict=True):
            group = joint[g : g + PIECES_A_CALL]
            ids = np.asarray(e.ids, np.int32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(group) and not at[0]:
                self._append(ids, np.diff(np.append(at, len(ids))))
                order += group
            else:
                alone += group
        for k in range(0, len(alone), 4096):
            coded = [np.asarray(e.ids, np.int32) for e in self.full.encode_batch_fast([words[i] for i in alone[k : k + 4096]], add_special_tokens=False)]
            self._append(np.concatenate(coded), np.asarray([len(x) for x in coded]))
        order += alone
        self._insert(h[order], np.arange(self.n_words - len(order), self.n_words, dtype=np.int32))

    def encode(self, buf: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes end to end) one after the other, each followed by the id `end`; n + 1 offsets."""
        kind = byte_kinds(buf)
        raw = buf.tobytes()
        odd = np.zeros(len(offs) - 1, bool)
        strange = np.flatnonzero(kind == ODD)
        odd[np.searchsorted(offs, strange, "right") - 1] = True
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offs, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        if not odd.any():
            return self._encode_plain(buf, offs, raw, kind, end)
        ids, sizes = [], []
        edges = np.flatnonzero(np.diff(odd)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(odd)], strict=True):
            a, b = int(offs[i]), int(offs[j])
            if odd[i]:
                for k in range(i, j):
                    coded = self.full.encode(raw[offs[k] : offs[k + 1]].decode(), add_special_tokens=False).ids
                    ids.append(np.asarray([*coded, end], np.uint32))
                    sizes.append(np.asarray([len(coded) + 1]))
            else:
                some, at = self._encode_plain(buf[a:b], offs[i : j + 1] - a, raw[a:b], kind[a:b], end)
                ids.append(some)
                sizes.append(np.diff(at))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode_plain(self, buf: np.ndarray, offs: np.ndarray, raw: bytes, kind: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.n_words > REMEMBERED_WORDS:
            self.forget()
        starts = piece_starts(buf, offs, kind)
        ends = np.append(starts[1:], len(buf)).astype(starts.dtype) if len(starts) else starts
        h = span_hashes(buf, starts, ends)
        at = self._find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            self._learn([raw[starts[i] : ends[i]].decode() for i in missing[where]], new)
            at[missing] = self._find(h[missing])
        lens = self.start[at + 1] - self.start[at]
        upto = np.concatenate([[0], np.cumsum(lens)])
        offsets = upto[np.searchsorted(starts, offs)] + np.arange(len(offs))
        shift = np.repeat(self.start[at] - upto[:-1], lens)
        out = np.empty(int(offsets[-1]), np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[offsets[1:] - 1] = True
        out[~is_end] = self.flat[shift + np.arange(len(shift))]
        out[is_end] = end
        return out, offsets


@functools.cache
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)

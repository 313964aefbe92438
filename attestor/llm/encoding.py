"""Exact, memoised encoding with a `tokenizers` vocabulary.

A pre-token's ids don't depend on its neighbours, so each distinct pre-token is encoded once by the
tokenizers library and looked up afterwards. Pre-token borders are found on whole byte buffers with
numpy. That holds for texts of a known alphabet; any other text (apostrophes that may be contractions,
control characters, other scripts, special tokens) goes to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from attestor.llm.common import _LOWER, chunked, same_spans, span_hashes

#: Distinct pre-tokens that a worker keeps, by family; beyond that it starts anew, so memory stays bounded. Those of byte-level
#: BPE, with the space before them, are more.
CACHE_WORDS = {"byte": 800_000, "word": 500_000}

_LETTER, _DIGIT, _OTHER, _BLANK = 1, 2, 3, 0
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
#: Bytes that may stand in a text of the fast path: printable ASCII but the apostrophe, blanks, and U+00C0 to U+01FF.
_KNOWN = np.zeros(256, dtype=bool)
_KNOWN[0x20:0x7F] = _KNOWN[0x09:0x0E] = _KNOWN[0x80:0xC0] = _KNOWN[0xC3:0xC8] = True
_KNOWN[0x27] = False

KINDS = ("byte", "word")
_HELD: dict[tuple[str, str], Encoder] = {}


def unknown_texts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text, whether it holds something outside the fast path's alphabet."""
    bad = ~_KNOWN[buf]
    if len(buf) > 1:
        pair = buf[:-1].astype(np.uint16) * 256 + buf[1:]
        # the signs for multiplication and division, the dotted capital I, and "<|" of special tokens
        bad[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair == 0x3C7C)
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offs[1:]] > total[offs[:-1]]


def byte_borders(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of byte-level BPE: runs of one class with a space before, blanks by themselves."""
    n = len(buf)
    kind = _CLASS[buf]
    blank = kind == _BLANK
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    first = np.ones(n, dtype=bool)
    if n > 1:
        after_blank = blank[:-1]
        solid = np.where(after_blank, buf[:-1] != 0x20, kind[1:] != kind[:-1])
        follows = np.zeros(n - 1, dtype=bool)  # the next byte is of this text and not blank
        follows[:-1] = ~blank[2:] & ~edge[2:n]
        first[1:] = np.where(blank[1:], ~after_blank | follows, solid) | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n)


def word_borders(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the word vocabulary: runs of letters, single digits, runs of signs; blanks go."""
    n = len(buf)
    kind = _CLASS[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    first = np.ones(n, dtype=bool)
    if n > 1:
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != _BLANK
    return starts[keep], ends[keep]


class Encoder:
    """Encodes text columns with the vocabulary file at path; kind is the family of pre-tokens."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
        self.library, self.kind = Tokenizer.from_file(path), kind
        self.forget()

    @staticmethod
    def of(path: str, kind: str) -> Encoder:
        """The process's own encoder for the file."""
        if (path, kind) not in _HELD:
            _HELD[path, kind] = Encoder(path, kind)
        return _HELD[path, kind]

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.n_words = self.n_ids = 0

    def _add(self, keys: list[bytes]) -> None:
        found = [x.ids for x in self.library.encode_batch_fast([k.decode() for k in keys], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(sizes.sum()))
        need = self.n_ids + len(flat)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), dtype=np.uint32)])
        if self.n_words + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + len(keys), dtype=np.int64)])
        self.ids[self.n_ids : need] = flat
        self.ends[self.n_words + 1 : self.n_words + 1 + len(keys)] = self.n_ids + np.cumsum(sizes)
        self.index.update(zip(keys, range(self.n_words, self.n_words + len(keys)), strict=True))
        self.n_words += len(keys)
        self.n_ids = need

    def _known(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of the known alphabet, and where each text's begin.

        Equal pre-tokens are found by hash, then compared byte by byte; the memo's keys are the bytes themselves.
        """
        whole = buf
        if not len(buf):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offs), dtype=np.int64)
        if self.kind == "byte":
            starts, ends = byte_borders(buf, offs)
        else:
            buf = lowered(buf)
            starts, ends = word_borders(buf, offs)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offs), dtype=np.int64)
        _, where, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if not same_spans(buf, starts, ends, where[back]):
            return self._by_library(whole, offs)
        if self.n_words + len(where) > CACHE_WORDS[self.kind]:
            self.forget()
        raw = buf.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if new := [k for k in keys if k not in self.index]:
            self._add(new)
        slot = np.fromiter(map(self.index.__getitem__, keys), dtype=np.int64, count=len(keys))[back]
        begin = self.ends[slot]
        size = self.ends[slot + 1] - begin
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - done[:-1], size) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, offs, side="left")]

    def _by_library(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        found = [x.ids for x in self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)]
        return np.concatenate([np.array(x, dtype=np.uint32) for x in found]), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    def encode(self, text: pa.Array):
        """Yields (first row, end row, ids, where each text's ids begin and the end) for runs of texts."""
        for lo, hi, buf, offs in chunked(text):
            odd = unknown_texts(buf, offs)
            if not odd.any():
                yield lo, hi, *self._known(buf, offs)
                continue
            plain = np.flatnonzero(~odd)
            raw = buf.tobytes()
            sizes = np.diff(offs)
            kept = b"".join(raw[offs[i] : offs[i + 1]] for i in plain)
            ids, at = self._known(np.frombuffer(kept, dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes[plain])]))
            strange = np.flatnonzero(odd)
            whole = self.library.encode_batch_fast([raw[offs[i] : offs[i + 1]].decode() for i in strange], add_special_tokens=False)
            parts: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * (hi - lo)
            for k, i in enumerate(plain):
                parts[i] = ids[at[k] : at[k + 1]]
            for x, i in zip(whole, strange, strict=True):
                parts[i] = np.array(x.ids, dtype=np.uint32)
            yield lo, hi, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case within the fast path's alphabet; every letter there keeps its two bytes."""
    out = _LOWER[buf]
    lead = np.flatnonzero((buf >= 0xC3) & (buf < 0xC8))
    if len(lead):
        text = np.frombuffer(_PAIRS, dtype=np.uint8)
        code = ((buf[lead].astype(np.int64) & 0x1F) << 6 | (buf[lead + 1] & 0x3F)) - 0xC0
        out[lead], out[lead + 1] = text[2 * code], text[2 * code + 1]
    return out


#: The lower-case forms of U+00C0 to U+01FF, two bytes each; U+0130, whose form is longer, is outside the alphabet.
_PAIRS = b"".join((chr(c).lower() if c != 0x130 else chr(c)).encode() for c in range(0xC0, 0x200))

"""Token ids of many texts by a word-level tokenizer file, through the tokenizers library.

The tokenizer lower-cases, drops white space, cuts a text into runs (letters, single digits,
other signs, apostrophe endings) and encodes each run alone. So each distinct run needs the
library once: runs are found and hashed with numpy, and their ids are kept per worker. Texts
with characters outside Latin (where normalisation could join characters) or with special
strings go to the library whole.
"""
from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .common import segment_hash

_TOP = 0x180          # Latin up to Extended-A: no character composes with its neighbour
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = 0, 1, 2, 3, 4
# Fixed by the tokenizer file's pattern.
_ENDINGS = ("re", "ve", "ll", "s", "t", "m", "d")
_MAX_RUNS = 2_000_000  # ids kept per worker; the store starts anew beyond it


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_TOP + 1, _OTHER, np.uint8)
    lower = np.arange(_TOP + 1, dtype=np.uint32)
    for i in range(_TOP):
        c, low = chr(i), chr(i).lower()
        if len(low) != 1 or ord(low) >= _TOP or unicodedata.normalize("NFC", c) != c:
            continue
        lower[i] = ord(low)
        name = unicodedata.category(low)
        if 9 <= i <= 13 or i in (0x20, 0x85, 0xA0):
            kind[i] = _SPACE
        else:
            kind[i] = _LETTER if name[0] == "L" else _DIGIT if name[0] == "N" else _SIGN
    return kind, lower


_KIND, _FOLD = _tables()
_SYMBOL = np.random.default_rng(7).integers(1, 1 << 63, _TOP + 1, dtype=np.uint64)


class WordIds:
    """Ids by run for a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self):
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _slots(self, hashes: np.ndarray, word) -> np.ndarray:
        """Store slot of each distinct hash; ``word(i)`` gives the run behind hashes[i]."""
        at = np.searchsorted(self.known, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == hashes[inside]
        missing = np.flatnonzero(~hit)
        if len(missing):
            if len(self.known) + len(missing) > _MAX_RUNS and len(self.known):
                self._clear()
                return self._slots(hashes, word)
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([word(i) for i in missing], add_special_tokens=False)]
            length = np.array([len(x) for x in ids], np.int64)
            new = len(self.start) + np.arange(len(missing))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, np.array([t for x in ids for t in x], np.uint32)])
            known, slot = np.concatenate([self.known, hashes[missing]]), np.concatenate([self.slot, new])
            order = np.argsort(known, kind="stable")
            self.known, self.slot = known[order], slot[order]
            at = np.searchsorted(self.known, hashes)
        return self.slot[at]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them without added special tokens."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif any(s in t for s in self.specials):
                out[i] = self._whole(t)
            else:
                plain.append(i)
        if not plain:
            return out
        codes = np.frombuffer("\n".join(texts[i] for i in plain).encode("utf-32-le"), np.uint32)
        size = np.array([len(texts[i]) for i in plain], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        folded = np.minimum(codes, _TOP)
        kind = _KIND[folded]
        odd = np.add.reduceat(kind == _OTHER, begin) > 0  # a text's separator is white space
        folded = _FOLD[folded]
        mark = np.ones(len(kind), bool)
        mark[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        self._endings(folded, kind, mark)
        at = np.flatnonzero(mark)
        end = np.append(at[1:], len(kind))
        keep = kind[at] != _SPACE
        at, end = at[keep], end[keep]
        h = segment_hash(_SYMBOL[folded], at, end)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        slot = self._slots(distinct, lambda i: folded[at[first[i]]:end[first[i]]].astype("<u4").tobytes().decode("utf-32-le"))
        slot = slot[back] if len(at) else np.zeros(0, np.int64)
        length = self.length[slot]
        total = np.concatenate([[0], np.cumsum(length)])
        where = np.repeat(self.start[slot] - total[:-1], length) + np.arange(total[-1])
        ids = self.flat[where]
        cut = total[np.searchsorted(at, np.append(begin, len(kind)))]
        for n, i in enumerate(plain):
            out[i] = self._whole(texts[i]) if odd[n] else ids[cut[n]:cut[n + 1]]
        return out

    @staticmethod
    def _endings(folded: np.ndarray, kind: np.ndarray, mark: np.ndarray) -> None:
        """Runs 's 't 're 've 'm 'll 'd: only where an apostrophe starts a run of signs."""
        n = len(folded)
        for i in np.flatnonzero((folded == 39) & mark):
            tail = folded[i + 1:i + 3]
            word = "".join(map(chr, tail))
            for e in _ENDINGS:
                if word.startswith(e):
                    mark[i + 1] = False
                    if i + 1 + len(e) < n:
                        mark[i + 1 + len(e)] = True
                    break


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)

"""Word hashes without a Python object per word: one pass of numpy over the bytes of a normalised text."""

from __future__ import annotations

import re

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BREAK = re.compile(r"[\W_]+")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        m = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_P, _INV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spaced(text: str) -> str:
    """The runs of letters and digits of ``text``, case folded, with one space between them."""
    return _BREAK.sub(" ", text).strip().casefold()


class Words:
    """Positions and hashes in a text made by :func:`spaced` (or of any text whose words are parted by single spaces)."""

    def __init__(self, text: str):
        self.bytes = text.encode("utf-8", "replace")
        b = np.frombuffer(self.bytes, np.uint8)
        if len(b):
            gaps = np.flatnonzero(b == 32)
            self.start, self.end = np.r_[0, gaps + 1], np.r_[gaps, len(b)]
        else:
            self.start = self.end = np.zeros(0, np.int64)
        up, self._down = _powers(len(b) + 1)
        self._sum = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=self._sum[1:])

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, n: int) -> np.ndarray:
        """A hash of each run of ``n`` words: of the first ``len - n + 1`` words on."""
        if len(self) < n:
            return np.zeros(0, np.uint64)
        s, e = self.start[: len(self) - n + 1], self.end[n - 1 :]
        return mix((self._sum[e] - self._sum[s]) * self._down[s])

    def text(self, i: int, n: int) -> str:
        return self.bytes[self.start[i] : self.end[i + n - 1]].decode("utf-8", "replace")


def blocks(text: str, overlap: int, size: int = 1 << 20):
    """``text`` (single spaces between words) in blocks of about ``size`` characters that share ``overlap`` words: bounds memory.
    A block of no more than ``overlap`` words, as one with a very long word may be, grows until it has more."""
    at, least = 0, size
    while len(text) - at > size:
        end = text.find(" ", least)
        if end < 0:
            break
        back = end
        for _ in range(overlap):
            back = text.rfind(" ", at, back)
            if back < 0:
                break
        if back < 0:
            least = end + size
            continue
        yield text[at:end]
        at = back + 1
        least = at + size
    yield text[at:]

"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Characters A-Z to a-z; every other byte stays.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word: 0-9, a-z and every byte of a character beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _MIX) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(31))
_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        table = []
        for base in (_BASE, _INVERSE):
            powers = np.full(size, base, dtype=np.uint64)
            powers[0] = 1
            table.append(np.cumprod(powers, dtype=np.uint64))
        _powers[size] = (table[0], table[1])
    return _powers[size]


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text.

    A-Z become lower case; a word is a longest run of 0-9, a-z and characters beyond ASCII.
    A null text has no words. Equal words have equal hashes; different words share one with a
    probability of about 2^-64.
    """
    encoded = [b"" if t is None else t.encode() for t in texts]
    raw = _LOWER[np.frombuffer(b"\0".join(encoded) + b"\0", dtype=np.uint8)]
    edge = np.diff(_IN_WORD[raw].astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=prefix[1:])
    hashes = (prefix[end] - prefix[start]) * inverse[start]
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    text_end = np.cumsum([len(e) + 1 for e in encoded])
    counts = np.diff(np.searchsorted(start, text_end), prepend=0)
    return hashes, counts

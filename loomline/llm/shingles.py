"""Word shingles of many texts at once, as 48-bit keys, by array operations on their bytes."""

from __future__ import annotations

import numpy as np
import zstandard

#: Words of a shingle.
WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(11)
_BASE = int(_rng.integers(1 << 62)) | 1
_FACTORS = (_rng.integers(1 << 62, size=WORDS + 1).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
#: Powers that a worker keeps.
_KEPT = 1 << 18
_power = _unpower = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _unpower
    if len(_power) >= n:
        return _power, _unpower
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(max(n, _KEPT), b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if n <= _KEPT:  # a longer text has its own
        _power, _unpower = both
    return both[0], both[1]


def word_table(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, hash, text number) of each word of the texts raw[offsets[i]:offsets[i+1]] in UTF-8, A-Z as a-z, and the first word of each text."""
    n = len(raw)
    solid = ~_BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    stop[:-1] &= ~solid[1:] | edge[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    power, unpower = _powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[:n], out=run[1:])
    word = mix((run[b] - run[a]) * unpower[a])
    doc = np.searchsorted(offsets, a, "right") - 1
    return a, b, word, doc, np.searchsorted(doc, np.arange(len(offsets)))


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 48-bit key) of each shingle, repeats included; a text of 1 to 4 words has its whole sequence as one shingle."""
    _, _, word, doc, first = word_table(raw, offsets)
    count = np.diff(first)
    keys, docs = [], []
    if len(word) >= WORDS:
        last = len(word) - WORDS + 1
        same = doc[:last] == doc[WORDS - 1 :]
        h = np.zeros(last, np.uint64)
        for k in range(WORDS):
            h += word[k : last + k] * _FACTORS[k]
        keys.append(mix(h[same]))
        docs.append(doc[:last][same])
    for d in np.flatnonzero((count > 0) & (count < WORDS)).tolist():
        w = word[first[d] : first[d + 1]]
        h = (w * _FACTORS[: len(w)]).sum(dtype=np.uint64) + _FACTORS[WORDS:] * np.uint64(len(w))
        keys.append(mix(h))
        docs.append(np.array([d], np.int64))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys) >> np.uint64(16)


def arrow_text(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def shrink(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    n = len(arrays[0])
    planes = [x.view(np.uint8).reshape(n, x.itemsize).T.tobytes() for x in map(np.ascontiguousarray, arrays)]
    return _zip.compress(b"".join(planes))


def expand(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(_unzip.decompress(blob), np.uint8), 0, []
    for k in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).reshape(n))
        at += n * k.itemsize
    return out

"""Vectorised text work on Arrow batches: word splitting and 64-bit hashing without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Freed batches go back to the system: workers share a bounded memory with their executor.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes that separate words: space and the ASCII controls 9 to 13.
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: As _SEP, and all ASCII that is neither letter nor digit (words as bare letters and digits).
_SEP_ALNUM = np.ones(256, dtype=bool)
_SEP_ALNUM[48:58] = _SEP_ALNUM[65:91] = _SEP_ALNUM[97:123] = False
_SEP_ALNUM[128:] = False
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOW = _BYTE[_LOWER]
_IN, _IN_ALNUM = ~_SEP, ~_SEP_ALNUM
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW = np.ones(64, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        _POW = np.ones(1 << (n - 1).bit_length(), dtype=np.uint64)
    if _POW[-1] == 1:
        _POW[1:] = _P
        np.multiply.accumulate(_POW, out=_POW)
    return _POW


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each (one row at least): bounds the working memory."""
    n = len(column)
    size = np.cumsum(string_parts(column)[1][1:] - string_parts(column)[1][:-1]) if n else np.zeros(0)
    a = 0
    while a < n:
        done = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield a, b
        a = b


#: Powers of _P and of its inverse: a word's hash is a difference of running sums, brought back to its own start.
_RUNS: list[np.ndarray] = []
_LIMIT = 1 << 22


def _running(n: int) -> list[np.ndarray]:
    if not _RUNS or len(_RUNS[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        _RUNS.clear()
        for factor in (int(_P), pow(int(_P), -1, 1 << 64)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            _RUNS.append(np.multiply.accumulate(table, out=table))
    return _RUNS


def words(column: pa.Array, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row, A-Z lower-cased: (hash uint64, index of the first word of each row and the total,
    byte start, byte end; both within the column). Words are runs without white space, or of letters, digits
    and non-ASCII if ``alnum``."""
    data, offsets = string_parts(column)
    n = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), z, z
    inside = (_IN_ALNUM if alnum else _IN)[data]
    cut = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # where words start or end within the bytes, and at their ends
    cut = np.concatenate(([0] if inside[0] else [], cut, [len(data)] if inside[-1] else [])).astype(np.int64)
    begin, end = cut[::2], cut[1::2]
    # a row's end inside such a run ends one word and starts another
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[inside[inner] & inside[inner - 1]] if len(inner) else inner
    if len(inner):
        begin, end = np.sort(np.concatenate((begin, inner))), np.sort(np.concatenate((end, inner)))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), begin, end
    size = end - begin
    if len(data) <= _LIMIT:
        power, back = _running(len(data))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        value = _BYTE_LOW[data]
        value *= power[: len(data)]
        np.cumsum(value, out=total[1:])
        raw = (total[end] - total[begin]) * back[begin]
    else:  # one very long text: its words by their own places
        at = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(at[-1], dtype=np.int64)
        place -= np.repeat(at[:-1], size)
        raw = np.add.reduceat(_BYTE_LOW[data[inside]] * _powers(int(size.max()))[place], at[:-1])
    return mix(raw + size.astype(np.uint64)), np.searchsorted(begin, offsets), begin, end


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (the last n - 1 are to be left out by the caller)."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        out *= _P
        out += h[k : k + len(out)]
    return mix(out)


def fold(h: np.ndarray, n: int) -> np.uint64:
    """The hash of a whole sequence shorter than n words; its length keeps it apart from longer shingles."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in h:
            out = out * _P + x
        return mix(np.array([out + np.uint64(0x51ED27) * np.uint64(len(h) + 1000 * n)]))[0]

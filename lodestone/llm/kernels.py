"""numpy kernels over Arrow string columns: word splitting and hashing without a
Python object per word.

A chunk of texts is one byte array with document offsets.  Words are found from
byte classes, and each word's 64-bit hash is a difference of prefix sums of a
polynomial over its bytes, so the cost is a few array passes per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text makes a chunk of its own, whose
#: words are found and hashed a stretch at a time (``words_of``).
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MULT = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of words [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Separator of lines.
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True

#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[97:123] = NON_WORD[128:] = False

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for slot, base in enumerate((_MULT, _INV)):
            with np.errstate(over="ignore"):
                steps = np.full(size, base, U64)
                steps[0] = 1
                _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 steps)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most CHUNK_BYTES of text (or one row)."""
    data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = int(np.searchsorted(off, off[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield batch.slice(row, end - row), data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(lowered: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by document) of maximal runs of non-separators;
    a run never crosses a document's end."""
    n = len(lowered)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    inside = ~separator[lowered]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes, equal hash, anywhere."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(lowered))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(lowered) + 1, U64)
        np.cumsum(_BYTE[lowered] * up[: len(lowered)], out=sums[1:])
        body = (sums[ends] - sums[starts]) * down[starts]
        return mix(body + (ends - starts).astype(U64) * U64(0xD1B54A32D192ED03))


def stretches(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, lower-cased bytes, offsets) of pieces of about CHUNK_BYTES, cut behind
    separators, so that work arrays over a longer chunk stay bounded."""
    at, total = 0, len(data)
    while at < total:
        end = min(at + CHUNK_BYTES, total)
        while end < total and not separator[LOWER[data[end - 1]]]:
            ahead = separator[LOWER[data[end : end + 4096]]]
            end += int(ahead.argmax()) + 1 if ahead.any() else len(ahead)
        inner = off[np.searchsorted(off, at, "right") : np.searchsorted(off, end, "left")] - at
        yield at, LOWER[data[at:end]], np.concatenate([[0], inner, [end - at]])
        at = end


def words_of(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word offsets by document) of texts, A-Z lower-cased."""
    hashes, begun = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for at, lowered, cut in stretches(data, off, separator):
        starts, ends, _ = word_spans(lowered, cut, separator)
        hashes.append(word_hashes(lowered, starts, ends))
        begun.append(starts + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begun), off)


def shingle_hashes(words: np.ndarray, word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by document) of all k-word shingles in order; a document
    of fewer words, but not none, has its whole sequence as its one shingle."""
    counts = np.diff(word_off)
    per_doc = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_off = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(out_off[-1])
    if total == 0:
        return np.zeros(0, U64), out_off
    at = np.arange(total) - np.repeat(out_off[:-1] - word_off[:-1], per_doc)
    with np.errstate(over="ignore"):
        acc = np.full(total, U64(k), U64)
        short = counts < k
        if short.any():
            have = np.repeat(np.minimum(counts, k), per_doc)
            for j in range(k):
                use = have > j
                acc[use] = mix(acc[use] * _MULT + words[at[use] + j] + U64(1))
            acc[np.repeat(short, per_doc)] ^= np.repeat(counts, per_doc)[np.repeat(short, per_doc)].astype(U64) * U64(0xA24BAED4963EE407)
        else:
            for j in range(k):
                acc = mix(acc * _MULT + words[at + j] + U64(1))
    return acc, out_off


def distinct_sets(hashes: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each document."""
    return [np.unique(hashes[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())

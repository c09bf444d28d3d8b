"""Byte-level BPE encoding and decoding over a given rank file.

A batch's texts are split by the tokenizer's pattern; distinct pieces are encoded
together.  Pieces go into padded matrices by length bucket: one row a piece, one
column a token, and a second matrix of the ranks of neighbouring pairs.  Each
round every row merges its leftmost pair of minimum rank (argmin gives the
leftmost), pair ranks being looked up in an open-addressing hash table in numpy
arrays, and rows that have nothing left to merge are compacted away.  Matrices of pieces over
``WIDE`` bytes also keep the minimum of each block of about sqrt(width) pairs and
links over merged places, so that a round reads two blocks of a row.

Ranks are read by the driver once, from a path that is a parameter, and broadcast
(about 50,000 tokens: a fixed size).

Defined results: null is the empty text: no tokens.  Repeated rows, a null doc_id
and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table, tidied

#: Bytes from which a piece's matrix keeps block minima.
WIDE = 48
#: Cells of a matrix, about.
CELLS = 1 << 18
#: Bytes of text whose pieces are encoded together.
GROUP_BYTES = 1 << 20
#: Pieces that a task remembers; it forgets all when full (speed only).
CACHE_PIECES = 60_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the joined token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        lefts, rights, ids = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    ids.append(rank)
        keys = np.array(lefts, np.int64) << 32 | np.array(rights, np.int64)
        values = np.array(ids, np.int32)
        self.bits = max(10, (len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.reach, slot = 0, self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # each round places one key of those that meet in a free slot
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            won = left[self.keys[slot[left]] == keys[left]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joined ids, NONE where the pair has none or a side is padding (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, keys, mask = out.reshape(-1), keys.reshape(-1), (1 << self.bits) - 1
        slot = self._slot(keys[todo])
        for _ in range(self.reach):
            there = self.keys[slot]
            hit = there == keys[todo]
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out


class Encoder:
    """Encodes pieces by a rank file's merges; decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_off = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.zeros(int(self.token_off[-1]), np.uint8)
        for token, rank in ranks.items():
            self.token_bytes[self.token_off[rank] : self.token_off[rank] + len(token)] = np.frombuffer(token, np.uint8)
        self.start()

    def start(self) -> None:
        self._split, self._cache = regex.compile(self.pattern), {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_split", "_cache")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.start()

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of about one length."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        cols = np.arange(width)
        real = cols < lengths[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[real] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(pieces), 0), np.int32)
        out: list[np.ndarray] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = pair.argmin(axis=1) if pair.shape[1] else np.zeros(len(rows), np.int64)
            merged = pair[np.arange(len(rows)), at] if pair.shape[1] else np.full(len(rows), NONE)
            done = merged == NONE
            if done.any():  # compaction
                for r, row in zip(rows[done], ids[done], strict=True):
                    out[r] = row[row >= 0]
                go = ~done
                rows, ids, pair, at, merged = rows[go], ids[go], pair[go], at[go], merged[go]
                if not len(rows):
                    break
            n, width = len(rows), ids.shape[1]
            r = np.arange(n)
            ids[r, at] = merged
            later = np.arange(width - 1)
            ids = np.take_along_axis(ids, later + (later > at[:, None]), 1)
            if width > 2:
                later = later[:-1]
                # Column at goes: the pair to the right of the merge is set anew below.
                pair = np.take_along_axis(pair, later + (later >= at[:, None]), 1)
                right = at < width - 2
                pair[r[right], at[right]] = self.pairs.find(ids[r[right], at[right]], ids[r[right], at[right] + 1])
                left = at > 0
                pair[r[left], at[left] - 1] = self.pairs.find(ids[r[left], at[left] - 1], ids[r[left], at[left]])
            else:
                pair = np.zeros((n, 0), np.int32)
        return out

    def _wide(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of long pieces of about one length.  A row's pairs stand in blocks with
        their minima, so that a round reads one block of a row and not the row, and
        merged places are skipped by links instead of moving what follows."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        side = int(np.ceil(np.sqrt(width)))
        size = side * side
        n = len(pieces)
        ids = np.full((n, size), -1, np.int32)
        ids[np.arange(size) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = np.full((n, size), NONE, np.int32)
        pair[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        least = pair.reshape(n, side, side).min(axis=2)
        after = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        out: list[np.ndarray] = [None] * n
        rows = np.arange(n)
        while len(rows):
            r = np.arange(len(rows))
            block = least.argmin(axis=1)
            merged = least[r, block]
            done = merged == NONE
            if done.any():  # compaction
                for row, i in zip(rows[done], np.flatnonzero(done), strict=True):
                    out[row] = ids[i][ids[i] >= 0]
                go = ~done
                rows, ids, pair, least, after, before = rows[go], ids[go], pair[go], least[go], after[go], before[go]
                if not len(rows):
                    break
                r, block, merged = np.arange(len(rows)), block[go], merged[go]
            blocks = pair.reshape(len(rows), side, side)
            at = block * side + blocks[r, block].argmin(axis=1)
            gone = after[r, at]
            then = after[r, gone]
            ids[r, at], ids[r, gone] = merged, -1
            after[r, at] = then
            inside = then < size
            before[r[inside], then[inside]] = at[inside]
            pair[r, gone] = NONE
            right = np.where(inside, ids[r, np.minimum(then, size - 1)], -1)
            pair[r, at] = self.pairs.find(merged, right)
            prior = before[r, at]
            has = prior >= 0
            pair[r[has], prior[has]] = self.pairs.find(ids[r[has], prior[has]], merged[has])
            for place in (at, gone, np.where(has, prior, at)):
                least[r, place // side] = blocks[r, place // side].min(axis=1)
        return out

    def encode_pieces(self, pieces: list[str]) -> None:
        """Fill the cache for pieces."""
        buckets: dict[int, list[str]] = {}
        for p in pieces:
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self._cache[p] = np.array([whole], np.int32)
            else:
                # Long pieces share a matrix within a quarter of a power of two.
                size = (len(raw) + 3) // 4
                buckets.setdefault(size if len(raw) <= WIDE else -(len(raw) >> (len(raw).bit_length() - 3) << (len(raw).bit_length() - 3)), []).append(p)
        for size, bucket in buckets.items():
            most = max(1, CELLS // (4 * size if size > 0 else -2 * size))
            for i in range(0, len(bucket), most):
                part = bucket[i : i + most]
                for p, ids in zip(part, (self._matrix if size > 0 else self._wide)([p.encode() for p in part]), strict=True):
                    self._cache[p] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        split = [self._split.findall(t) for t in texts]
        if len(self._cache) > CACHE_PIECES:
            self._cache.clear()
        new = set()
        for pieces in split:
            new.update(pieces)
        self.encode_pieces([p for p in new if p not in self._cache])
        get, empty = self._cache.__getitem__, np.zeros(0, np.int32)
        return [np.concatenate(list(map(get, pieces))).astype("<u4") if pieces else empty.astype("<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, by one gather from all tokens' bytes."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        start, size = self.token_off[ids], self.token_off[ids + 1] - self.token_off[ids]
        total = np.cumsum(size)
        at = np.arange(int(total[-1])) + np.repeat(start - (total - size), size)
        return self.token_bytes[at].tobytes()


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with at most GROUP_BYTES of text, or one text."""
    column, i, texts, size = batch.column(batch.num_columns - 1), 0, [], 0
    for row, value in enumerate(column):
        text = value.as_py() or ""
        if texts and size + len(text) > GROUP_BYTES:
            yield i, texts
            i, texts, size = row, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield i, texts


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` if ``keep_ids``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        coder.start()  # a task's own memory of pieces
        for batch in batches:
            for first, texts in _groups(batch):
                ids = coder.encode(texts)
                cols = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        coder.start()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(tidied(run), schema)


def decode_ids(frame: DataFrame, ranks_path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and ``decoded`` (binary) for a column of token ids; null ids give null."""
    shared = frame.sparkSession.sparkContext.broadcast(Encoder(read_ranks(ranks_path), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else shared.value.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return frame.select(frame[doc_id].alias("doc_id"), frame[ids].alias("ids")).mapInArrow(tidied(run), f"doc_id {frame.schema[doc_id].dataType.simpleString()}, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

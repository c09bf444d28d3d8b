"""Quality classifier by co-training.

Two views of a document share no feature.  The *text* view reads its words without
case or punctuation: the mean weight of the hashed words, and how much they repeat
(each word its predecessor, the share of distinct words and of distinct neighbours).
The *metadata* view is what is known of the page without reading a word: language,
source, length and layout (lines, their length, shares of byte classes).  Each has
a logistic classifier.

Both start from the labels of a part of a bounded labelled sample.  The rest of the
sample is the pool: its labels are hidden.  In each round each view's logits are
calibrated on rows kept apart, and either view labels the pool's documents that it
is surest of and hands them to the other.  In the end a logistic unit over both
calibrated views, with weights that are not negative, combines them.

Training is in one executor task over at most ``MAX_ROWS`` labelled rows of each
class and ``MAX_BYTES`` of their text; all documents are scored on the executors,
whole.

Defined results: null text is empty text; null lang or source is a value of its
own; labels that are null are left out, a doc_id labelled twice is good only if all
its labels say so; without labels of both classes every score is the smoothed share
of good labels; repeated rows are scored alike; empty tables give empty results.
Other columns pass through; an input column called like the output is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.common import fit_in_task, table, tidied, without
from lodestone.llm.toxicity import bounded_sample, held_out

#: Bounds of the labelled sample: rows of each class, and bytes of text.
MAX_ROWS = 4000
MAX_BYTES = 64 << 20
#: One in so many rows of the sample shows its label from the start; one in so many
#: calibrates; the others are the pool.
SHOWN, APART = 3, 6
ROUNDS = 3
#: A view labels for the other what its calibrated probability is so sure of, in each
#: round at most one in HANDED rows of the pool and class, the surest first.
CONFIDENT = 0.97
HANDED = 10
#: What all rows so labelled weigh, against those with labels of their own.
PSEUDO = 0.1
BITS = 16
SLOTS = 1 << BITS
META = 64

#: Measures of repetition beside the words.
REPEATS = 4


def text_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, offsets, repeats): each text's hashed words, and one row a text of how
    much they repeat."""
    words, word_off = K.words_of(data, off, K.NON_WORD)
    counts = np.diff(word_off)
    doc = np.repeat(np.arange(len(counts)), counts)
    per = lambda mask, of: np.bincount(of, mask, len(counts)) / np.maximum(counts, 1)
    out = np.zeros((len(counts), REPEATS), np.float32)
    inner = np.zeros(len(words), bool)
    inner[1:] = doc[1:] == doc[:-1]
    back = np.roll(words, 1)

    def distinct(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, doc))
        v, d = values[order], doc[order]
        return per(np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]).astype(float), d)

    if len(words):
        out[:, 0] = per((inner & (words == back)).astype(float), doc)
        out[:, 1] = 1 - distinct(words)
        with np.errstate(over="ignore"):
            out[:, 2] = 1 - distinct(np.where(inner, K.mix(back * K.U64(0x9E3779B97F4A7C15) + words), words))
    out[:, 3] = np.log1p(counts) / 8
    return (words >> K.U64(64 - BITS)).astype(np.int64), word_off, out


def meta_features(data: np.ndarray, off: np.ndarray, langs: list, sources: list) -> np.ndarray:
    """One row a document: constants, logs and shares, then hashed lang and source."""
    n = len(off) - 1
    out = np.zeros((n, META), np.float32)
    size = np.diff(off).astype(np.float64)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    full = np.maximum(size, 1)
    lines = total(data == 10) + 1
    out[:, 0] = 1
    out[:, 1] = np.log1p(size) / 8
    out[:, 2] = np.log1p(lines) / 4
    out[:, 3] = np.log1p(size / lines) / 6
    other = (data > 32) & (data < 127) & ~(((data | 32) >= 97) & ((data | 32) <= 122)) & ~((data >= 48) & (data <= 57))
    for i, mask in enumerate([(data >= 48) & (data <= 57), (data >= 65) & (data <= 90), data == 32, data >= 128, other, np.isin(data, np.frombuffer(b".,;:!?", np.uint8)), np.isin(data, np.frombuffer(b"|<>{}[]=", np.uint8)), np.isin(data, np.frombuffer(b"#$%&*@", np.uint8))]):
        out[:, 4 + i] = np.minimum(total(mask) / full * 8, 3)
    for i, (a, b) in enumerate(zip(langs, sources, strict=True)):
        out[i, 16 + zlib.crc32(f"l{a}".encode()) % 16] = 1
        out[i, 32 + zlib.crc32(f"s{b}".encode()) % 32] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _means(weights: np.ndarray, slots: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
    return (sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1)


def balanced(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights under which both classes count alike."""
    share = (weight * y).sum() / weight.sum()
    return weight * np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))


def fit_text(slots: np.ndarray, off: np.ndarray, repeats: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, rate: float = 20.0) -> np.ndarray:
    """Weights by slot, then of the repeats and the bias: full-batch gradients with
    Adagrad scaling."""
    w, seen = np.zeros(SLOTS + REPEATS + 1), np.full(SLOTS + REPEATS + 1, 1e-3)
    counts = np.diff(off)
    balance = balanced(y, weight)
    dense = np.column_stack([repeats, np.full(len(y), 0.3)]).astype(np.float64)
    for _ in range(steps):
        d = (_sigmoid(_means(w, slots, off) + dense @ w[SLOTS:]) - y) * balance / balance.sum()
        g = np.concatenate([np.bincount(slots, np.repeat(d / np.maximum(counts, 1), counts), SLOTS), dense.T @ d / 3])
        g += 1e-7 * w
        seen += (g * 100) ** 2
        w -= rate * g / np.sqrt(seen)
    return w


def fit_meta(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    x = x.astype(np.float64)
    balance = balanced(y, weight)
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.5
        step = np.linalg.solve(h, x.T @ (balance * (p - y)) + 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def platt(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes (none negative) and a shift that calibrate columns of logits: Newton
    steps with a ridge, over the columns that are left."""
    n = logits.shape[1]
    x, use = np.column_stack([logits, np.ones(len(logits))]), np.ones(n + 1, bool)
    while True:
        w = np.append(np.full(n, 1.0 / n), 0.0)
        start = w * use
        w = start.copy()
        for _ in range(50):
            own = x[:, use]
            p = _sigmoid(own @ w[use])
            step = np.linalg.solve((own * (p * (1 - p) + 1e-9)[:, None]).T @ own + np.eye(use.sum()) * 1e-2, own.T @ (p - y) + 1e-2 * (w - start)[use])
            w[use] -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        bad = np.flatnonzero(w[:n] < 0)
        if not len(bad):
            return w
        use[bad] = False


@dataclass
class Model:
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    #: Slope and shift of each view, then both slopes and the shift of the union.
    scale: tuple = ((1.0, 0.0), (1.0, 0.0))
    union: tuple = (0.5, 0.5, 0.0)
    constant: float | None = None

    def views(self, features: tuple) -> np.ndarray:
        """Calibrated logits, one column a view."""
        slots, off, repeats, meta = features
        a = _means(self.text, slots, off) + np.column_stack([repeats, np.full(len(off) - 1, 0.3)]) @ self.text[SLOTS:]
        return np.column_stack([s * v + t for v, (s, t) in zip((a, meta @ self.meta), self.scale, strict=True)])

    def scores(self, features: tuple) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features[1]) - 1, self.constant)
        return _sigmoid(self.views(features) @ np.array(self.union[:2]) + self.union[2])


def _take(features: tuple, rows: np.ndarray) -> tuple:
    slots, off, repeats, meta = features
    counts = np.diff(off)[rows]
    cut = np.concatenate([[0], np.cumsum(counts)])
    return slots[np.arange(cut[-1]) + np.repeat(off[rows] - cut[:-1], counts)], cut, repeats[rows], meta[rows]


def co_train(features: tuple, y: np.ndarray, role: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model:
    """``role``: 0 label shown, 1 pool (its labels are not read), 2 calibrates."""
    base, pool, apart = (np.flatnonzero(role == r) for r in range(3))
    model = Model()
    if len(np.unique(y[base])) < 2 or len(np.unique(y[apart])) < 2:
        model.constant = float(((y[role != 1] == 1).sum() + 0.5) / ((role != 1).sum() + 1))
        return model
    extra: list[dict[int, int]] = [{}, {}]
    own, kept = _take(features, pool), _take(features, apart)

    def calibrated(some: tuple) -> np.ndarray:
        """Both views' logits of some rows, calibrated on the rows kept apart."""
        model.scale = ((1.0, 0.0), (1.0, 0.0))
        logits = model.views(kept)
        model.scale = tuple(tuple(platt(logits[:, [v]], y[apart])) for v in range(2))
        return model.views(some)

    for r in range(rounds + 1):
        for view, theirs in enumerate(extra):
            rows = np.concatenate([base, np.fromiter(theirs, np.int64, len(theirs))])
            labels = np.concatenate([y[base], np.fromiter(theirs.values(), np.int64, len(theirs))]).astype(np.float64)
            some, weight = _take(features, rows), np.append(np.ones(len(base)), np.full(len(theirs), min(1.0, PSEUDO * len(base) / max(len(theirs), 1))))
            if view == 0:
                model.text = fit_text(*some[:3], labels, weight)
            else:
                model.meta = fit_meta(some[3], labels, weight)
        if r == rounds or not len(pool):
            break
        for mine, p in enumerate(_sigmoid(calibrated(own)).T):
            theirs = extra[1 - mine]
            for label, sure in ((0, 1 - p), (1, p)):
                order = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= confident and int(pool[i]) not in theirs]
                theirs.update((int(pool[i]), label) for i in order[: max(1, len(pool) // HANDED)])
    model.union = tuple(platt(calibrated(kept), y[apart]))
    return model


def roles(n: int) -> np.ndarray:
    """Roles of n rows in the sample's order."""
    at = np.arange(n)
    return np.where(at % APART == APART - 1, 2, np.where(at % SHOWN == 0, 0, 1))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality", use: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, rounds: int = ROUNDS) -> Model:
    """Fit from at most ``max_rows`` labelled rows of each class and ``max_bytes`` of
    their text, taken in the order of a hash of their id."""
    use = ~held_out(F.col("doc_id")) if use is None else use
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(use).groupBy("doc_id").agg(F.min("y").alias("y"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    constant = Model(constant=(totals.get(1, 0) + 0.5) / (totals.get(0, 0) + totals.get(1, 0) + 1))
    if not totals.get(0) or not totals.get(1):
        return constant

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.chunks(batch):
                slots, cut, repeats = text_features(data, off)
                meta = meta_features(data, off, part.column("lang").to_pylist(), part.column("source").to_pylist())
                cols = [part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(slots.astype(np.int32))), pa.array(list(np.hstack([repeats, meta])), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "slots", "dense"])

    def learn(rows: pa.Table | None) -> Model:
        if rows is None:
            return constant
        rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable")))
        column = rows.column("slots").combine_chunks()
        dense = np.array(rows.column("dense").combine_chunks().flatten()).reshape(-1, REPEATS + META)
        found = (column.values.to_numpy().astype(np.int64), column.offsets.to_numpy().astype(np.int64), dense[:, :REPEATS], dense[:, REPEATS:])
        return co_train(found, rows.column("y").to_numpy(), roles(rows.num_rows), rounds)

    kind = base.schema["doc_id"].dataType.simpleString()
    sample = bounded_sample(known, base, max_rows, max_bytes).mapInArrow(tidied(features), f"doc_id {kind}, y int, slots array<int>, dense array<float>")
    return fit_in_task(sample, learn)


def score(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang", source: str = "source", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            for part, data, off in K.chunks(batch, text):
                meta = meta_features(data, off, part.column(names.index(lang)).to_pylist(), part.column(names.index(source)).to_pylist())
                value = m.scores((*text_features(data, off), meta))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], names=[*names, out])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score (of good quality), predicted, kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = train(docs, table(spark, sf_dir, "labels"))
    kept = F.col("score") >= 0.5
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(kept, 1).otherwise(0).cast("int").alias("predicted"), kept.alias("kept"))

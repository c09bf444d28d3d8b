"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to embeddings; filters of several widths slide over the whole
text, each filter's maximum is taken, and a logistic unit scores the maxima.  The
model is trained on all labelled rows: in each pass every task steps through its own
rows (gradients flow only through the winning positions, so a step costs one forward
pass), and what the tasks learnt is averaged on the executors, a weight over the tasks
that moved it; only the weights come to the driver.  All documents are scored on the executors, a few MB of text at a time, a
longer text by stretches.  Thresholds are calibrated by language on counts of all
scores of the labelled rows kept out of training, one in five; a language is never an input of the score.

Defined results: null or wordless text is scored like any other, from one empty
position; labels that are null are left out, a doc_id labelled twice is toxic if
one label says so; without labels of both classes every score is the smoothed
share of toxic labels; a null doc_id is scored and counts as not held out;
repeated rows are scored alike; empty tables give empty results.  Other columns
pass through; an input column called like an output column is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernels as K
from lodestone.llm.common import materialize, maybe_broadcast, table, tidied, without

#: Labelled rows for each task of a training pass.
TASK_ROWS = 16_384
#: Texts, and their words, that a task holds at once.
CHUNK_ROWS, CHUNK_WORDS = 8192, 1 << 22
#: Vocabulary ids averaged together.
SLICE_BITS = 12
#: Largest change of a weight that a pass hands on.
HALF = 65_504.0
#: Steps of a logit that calibration tells apart.
STEPS = 1024
#: Words whose filter responses are held at once.
STRETCH = 1 << 19
VOCABULARY_BITS = 18
VOCABULARY = 1 << VOCABULARY_BITS
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: A word in fewer training texts than this has the zero embedding of padding.
LEAST_TEXTS = 3
EPOCHS = 6
#: Share of words blanked in a training step, so that no single word decides.
DROPOUT = 0.25
#: Shrinking of the embeddings that a step touches.
DECAY = 3e-3
BATCH = 32
#: Fewer calibration rows of a class than this: the language takes the overall threshold.
LEAST_CALIBRATION = 10
PAD = VOCABULARY


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 5, is 0; such rows teach nothing."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def token_ids(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary ids, offsets): each text's words, or one padding if it has none,
    then padding for the widest filter."""
    words, word_off = K.words_of(data, off, K.NON_WORD)
    ids = (words >> K.U64(64 - VOCABULARY_BITS)).astype(np.int64)
    counts = np.diff(word_off)
    real = np.maximum(counts, 1)
    out_off = np.concatenate([[0], np.cumsum(real + max(WIDTHS) - 1)])
    out = np.full(int(out_off[-1]), PAD, np.int64)
    at = np.arange(len(ids)) + np.repeat(out_off[:-1] - word_off[:-1], counts)
    out[at] = ids
    return out, out_off


def packed(ids: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The words of padded texts in 18 bits each: 16 low bits a word, then the two high
    bits of four words a byte."""
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        own = ids[a:b][ids[a:b] != PAD]
        high = np.zeros(-(-len(own) // 4) * 4, np.uint8)
        high[: len(own)] = own >> 16
        out.append((own & 0xFFFF).astype("<u2").tobytes() + (high.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)).tobytes())
    return out


def unpacked(raw: bytes) -> np.ndarray:
    """Ids of one text, padded as token_ids pads them."""
    n = 4 * len(raw) // 9
    out = np.full(max(n, 1) + max(WIDTHS) - 1, PAD, np.int64)
    high = np.frombuffer(raw, np.uint8, offset=2 * n)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    out[:n] = np.frombuffer(raw, "<u2", n) | high.ravel()[:n].astype(np.int64) << 16
    return out


@dataclass
class Model:
    """Weights, and what calibration found."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def responses(self, ids: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """Each width's filters at each place; -inf where only padding is left."""
        x = self.embed[ids]
        dead = np.zeros(len(ids), bool)
        for j in range(max(WIDTHS) - 1):
            dead[off[1:] - 1 - j] = True
        for w in WIDTHS:
            y = x @ self.filters[w][0]
            for j in range(1, w):
                y[:-j] += x[j:] @ self.filters[w][j]
            y[dead] = -np.inf
            yield y

    def winners(self, ids: np.ndarray, off: np.ndarray):
        """Largest response of each filter in each text, and where it is; STRETCH words
        at a time where a batch has more."""
        edge, found = max(WIDTHS) - 1, []
        for a, b in [(0, len(off) - 1)] if len(ids) <= STRETCH else [(i, i + 1) for i in range(len(off) - 1)]:
            best = None
            for s in range(off[a], off[b] - edge, STRETCH) if len(ids) > STRETCH else (off[a],):
                # A long text's stretches overlap by the widest filter's edge.
                e = min(s + STRETCH + edge, off[b])
                cut = off[a : b + 1] - s if b - a > 1 else np.array([0, e - s])
                own = []
                for y in self.responses(ids[s:e], cut):
                    where = np.array([i + y[i:j].argmax(axis=0) for i, j in zip(cut[:-1], cut[1:], strict=True)])
                    own.append((np.take_along_axis(y, where, 0), where + s))
                best = own if best is None else [(np.maximum(p, q), np.where(q > p, v, u)) for (p, u), (q, v) in zip(best, own, strict=True)]
            found.append(best)
        return [np.concatenate([f[k][0] for f in found]) for k in range(len(WIDTHS))], [np.concatenate([f[k][1] for f in found]) for k in range(len(WIDTHS))]

    def maxima(self, ids: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Largest response of each filter in each text, STRETCH words at a time."""
        edge, parts, first = max(WIDTHS) - 1, [], 0
        while first < len(off) - 1:
            last = max(first + 1, int(np.searchsorted(off, off[first] + STRETCH, "right")) - 1)
            a, b, best = off[first], off[last], None
            own = off[first : last + 1] - a
            for s in range(a, b - edge, STRETCH) if last == first + 1 else (a,):
                # A long text's stretches overlap by the widest filter's edge.
                e = min(s + STRETCH + edge, b) if last == first + 1 else b
                cut = np.array([0, e - s]) if last == first + 1 else own
                tops = [np.maximum.reduceat(y, cut[:-1], axis=0) for y in self.responses(ids[s:e], cut)]
                best = tops if best is None else [np.maximum(p, q) for p, q in zip(best, tops, strict=True)]
            parts.append(best)
            first = last
        return [np.concatenate([p[k] for p in parts]) for k in range(len(WIDTHS))]

    def logits(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        tops = self.maxima(ids, off)
        h = np.concatenate([np.maximum(t + self.bias[w], 0) for w, t in zip(WIDTHS, tops, strict=True)], axis=1)
        return h @ self.out + self.out_bias

    def scores(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(ids, off).astype(np.float64), -30, 30)))


def fresh(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.02, (VOCABULARY + 1, DIM)).astype(np.float32)
    embed[PAD] = 0
    filters = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    return Model(embed, filters, bias, rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)


class Learner:
    """A model in training, with its steps' state: what a task takes up and hands on."""

    def __init__(self, rare: np.ndarray, weight: tuple[float, float], seed: int = 7):
        self.model, self.rare, self.weight, self.seed = fresh(seed), rare, np.array(weight), seed
        self.model.embed[rare] = 0
        self.adam, self.squares = _Adam(0.01), np.full(VOCABULARY + 1, 1e-4, np.float32)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over padded id arrays (one a text, as token_ids cuts them)."""
        model, adam, squares, rare = self.model, self.adam, self.squares, self.rare
        weight = self.weight[labels.astype(int)]
        # Texts of like length share a batch; batches come in random order.
        order = np.argsort([len(t) for t in texts], kind="stable")
        jitter = np.argsort(np.arange(len(order)) + rng.uniform(0, 4 * BATCH, len(order)))
        batches = [order[jitter][i : i + BATCH] for i in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            pick = batches[b]
            ids = np.concatenate([texts[i] for i in pick])
            ids[rng.random(len(ids)) < DROPOUT] = PAD
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            tops, wheres = model.winners(ids, off)
            pre = [t + model.bias[w] for w, t in zip(WIDTHS, tops, strict=True)]
            h = np.concatenate([np.maximum(p, 0) for p in pre], axis=1)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30)))
            d = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            adam.t += 1
            dh = d[:, None] * model.out[None, :]
            adam.step("out", model.out, h.T @ d + 1e-4 * model.out)
            model.out_bias -= 0.05 * float(d.sum())
            rows, grads = [], []
            for k, w in enumerate(WIDTHS):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS] * (pre[k] > 0)
                change = np.zeros_like(model.filters[w])
                for j in range(w):
                    word = ids[np.minimum(wheres[k] + j, len(ids) - 1)]
                    change[j] = np.einsum("nf,nfd->df", g, model.embed[word])
                    rows.append(word.ravel())
                    grads.append((g[:, :, None] * model.filters[w][j].T[None]).reshape(-1, DIM))
                adam.step(("filter", w), model.filters[w], change + 1e-5 * model.filters[w])
                adam.step(("bias", w), model.bias[w], g.sum(axis=0))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            seen, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(seen), DIM), np.float32)
            np.add.at(total, back, grads)
            squares[seen] += (total**2).mean(axis=1)
            model.embed[seen] -= 0.05 * total / np.sqrt(squares[seen])[:, None]
            model.embed[seen[rare[seen]]] = 0
            model.embed[seen] *= 1 - DECAY

    def small(self) -> dict:
        """All weights and state but the embeddings', by name."""
        m = self.model
        parts = {"out": m.out, "out_bias": np.array(m.out_bias), "t": np.array(float(self.adam.t))}
        parts |= {("filter", w, 0): m.filters[w] for w in WIDTHS} | {("bias", w, 0): m.bias[w] for w in WIDTHS}
        return parts | {("adam", name, i): x for name, pair in self.adam.state.items() for i, x in enumerate(pair)}

    def take(self, parts: dict) -> None:
        m = self.model
        m.out, m.out_bias, self.adam.t = parts["out"].astype(np.float32), float(parts["out_bias"]), round(float(parts["t"]))
        for w in WIDTHS:
            m.filters[w], m.bias[w] = (parts[kind, w, 0].astype(np.float32) for kind in ("filter", "bias"))
        names = {key[1] for key in parts if key[0] == "adam"}
        self.adam.state = {name: tuple(parts["adam", name, i].astype(np.float32) for i in (0, 1)) for name in names}


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Padded id arrays and labels, so many at once as a task may hold."""
    texts, labels, words = [], [], 0
    for batch in batches:
        for raw, y in zip(batch.column(batch.schema.get_field_index("ids")), batch.column(batch.schema.get_field_index("y")).to_pylist(), strict=True):
            texts.append(unpacked(raw.as_py()))
            labels.append(y)
            words += len(texts[-1])
            if len(texts) >= CHUNK_ROWS or words >= CHUNK_WORDS:
                yield texts, np.array(labels, np.float32)
                texts, labels, words = [], [], 0
    if texts:
        yield texts, np.array(labels, np.float32)


def _pass(rows: DataFrame, learner: Learner, epoch: int) -> None:
    """One pass over all of ``rows`` (y, ids): each task learns from its own, and the
    averages are put into ``learner``."""
    shared = rows.sparkSession.sparkContext.broadcast(learner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = pickle.loads(pickle.dumps(shared.value)), 0
        rng = np.random.default_rng([own.seed, epoch, TaskContext.get().partitionId()])
        for texts, labels in _texts(batches):
            own.learn(texts, labels, rng)
            n += len(texts)
        if not n:
            return
        ids = np.flatnonzero((own.model.embed != shared.value.model.embed).any(axis=1) | (own.squares != shared.value.squares))
        # What changed, in half the bits: the sums are of changes alone.
        change = np.concatenate([own.model.embed[ids] - shared.value.model.embed[ids], (own.squares[ids] - shared.value.squares[ids])[:, None]], axis=1)
        value = np.clip(change, -HALF, HALF).astype(np.float16)
        starts = np.flatnonzero(np.diff(ids >> SLICE_BITS, prepend=-1))
        ends = np.append(starts[1:], len(ids))
        cols = [[-1], [b""], [pickle.dumps(own.small(), protocol=5)]]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            for col, x in zip(cols, (int(ids[a] >> SLICE_BITS), (ids[a:b] & ((1 << SLICE_BITS) - 1)).astype(np.uint16).tobytes(), value[a:b].tobytes()), strict=True):
                col.append(x)
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), n)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["n", "slice", "ids", "value"])

    def mean(group: pa.Table) -> pa.Table:
        # In order of content, so that sums don't depend on which task came first.
        found = sorted(zip(*(group.column(c).to_pylist() for c in ("value", "ids", "n")), strict=True))
        slot = group.column("slice")[0].as_py()
        if slot < 0:
            parts, n = [pickle.loads(x) for x, _, _ in found], np.array([x for _, _, x in found], float)
            ids, value = b"", pickle.dumps({k: sum(w * p[k] for w, p in zip(n / n.sum(), parts, strict=True)) for k in parts[0]}, protocol=5)
        else:
            total, times = np.zeros((1 << SLICE_BITS, DIM + 1)), np.zeros(1 << SLICE_BITS)
            for raw, own, _ in found:
                at = np.frombuffer(own, np.uint16)
                total[at] += np.frombuffer(raw, np.float16).reshape(-1, DIM + 1)
                times[at] += 1
            at = np.flatnonzero(times)
            ids, value = (at + (slot << SLICE_BITS)).astype(np.int32).tobytes(), (total[at] / times[at, None]).astype(np.float32).tobytes()
        return pa.table([pa.array([slot], pa.int32()), pa.array([ids], pa.binary()), pa.array([value], pa.binary())], names=["slice", "ids", "value"])

    learnt = rows.mapInArrow(tidied(run), "n long, slice int, ids binary, value binary")
    for r in learnt.groupBy("slice").applyInArrow(mean, "slice int, ids binary, value binary").collect():  # the weights
        if r["slice"] < 0:
            learner.take(pickle.loads(bytes(r["value"])))
        else:
            ids, value = np.frombuffer(bytes(r["ids"]), np.int32), np.frombuffer(bytes(r["value"]), np.float32).reshape(-1, DIM + 1)
            learner.model.embed[ids] += value[:, :DIM]
            learner.squares[ids] += value[:, DIM]
    shared.unpersist()


def _rare(rows: DataFrame) -> np.ndarray:
    """True for the ids in fewer than LEAST_TEXTS of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(VOCABULARY + 1, np.int64)
        for texts, _ in _texts(batches):
            for ids in texts:
                times[np.unique(ids)] += 1
        at = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times[at])], names=["id", "n"])

    often = rows.mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    rare = np.ones(VOCABULARY + 1, bool)
    rare[[r["id"] for r in often.select("id").collect()]] = False  # the vocabulary at most
    rare[PAD] = True
    return rare


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Counts of ``rows`` by y, lang and step of the logit."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = [unpacked(raw.as_py()) for raw in batch.column(names.index("ids"))]
            cut = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            logit = np.clip(shared.value.logits(np.concatenate(texts), cut).astype(np.float64), -30, 30) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(names.index("y")), batch.column(names.index("lang")), pa.array(np.round(logit * STEPS).astype(np.int32))], names=["y", "lang", "step"])

    return rows.mapInArrow(tidied(run), "y int, lang string, step int").groupBy("y", "lang", "step").agg(F.count("*").alias("n"))


def calibrate(model: Model, score: np.ndarray, labels: np.ndarray, langs: list[str], weight: np.ndarray) -> None:
    """Shift the scores so that 0.5 is the best threshold overall, and set one by
    language: the middle of the range that gives the largest F1 on rows that training
    did not see.  Each entry stands for ``weight`` rows."""

    def best(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        order = np.argsort(-score, kind="stable")
        s, hit, miss = score[order], np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
        f1 = 2 * hit / (hit + miss + (w * y).sum())
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        k = ends[f1[ends].argmax()]
        below = s[k + 1] if k + 1 < len(s) else 0.0
        return float((s[k] + below) / 2)

    if not len(score) or labels.min() == labels.max():
        return
    overall = np.clip(best(score, labels, weight), 1e-6, 1 - 1e-6)
    # Training weighs the classes alike; with this shift a score of 0.5 is the overall threshold.
    shift = np.log(overall / (1 - overall))
    model.out_bias -= float(shift)
    logit = np.log(np.clip(score, 1e-12, 1 - 1e-12)) - np.log(np.clip(1 - score, 1e-12, 1)) - shift
    score = 1 / (1 + np.exp(-logit))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min((weight * labels)[own].sum(), (weight * (1 - labels))[own].sum()) >= LEAST_CALIBRATION:
            model.thresholds[lang] = best(score[own], labels[own], weight[own])


def _constant(totals: dict[int, int]) -> Model:
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    return Model(*[np.zeros(1)] * 4, 0.0, constant=(n1 + 0.5) / (n0 + n1 + 1))


def _learn(rows: DataFrame, totals: dict[int, int]) -> Model:
    """Fit and calibrate on all of ``rows`` (lang, y, ids, kept: out of training)."""
    shown = {(r["kept"], r["y"]): r["n"] for r in rows.groupBy("kept", "y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = (shown.get((False, y), 0) for y in (0, 1))
    if not n0 or not n1:
        return _constant(totals)
    own = rows.filter("NOT kept").select("y", "ids")
    learner = Learner(_rare(own), ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)))
    for epoch in range(EPOCHS):
        _pass(own, learner, epoch)
    model = learner.model
    cells = _scored(rows.filter("kept"), model).orderBy("step", "y", "lang").toArrow()  # steps of a logit by language
    score = 1 / (1 + np.exp(-cells.column("step").to_numpy() / STEPS))
    calibrate(model, score, cells.column("y").to_numpy().astype(float), cells.column("lang").to_pylist(), cells.column("n").to_numpy().astype(float))
    return model


def bounded_sample(known: DataFrame, docs: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) joined with at most ``max_rows`` rows of each ``y``
    of ``known``, in the order of a hash of their id, and ``max_bytes`` of text."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picks = None
    for y in (0, 1):
        pick = known.filter(F.col("y") == y).orderBy(*order).limit(max_rows)
        picks = pick if picks is None else picks.unionByName(pick)
    found = materialize(docs.join(F.broadcast(picks), "doc_id"), "sample")  # 2 * max_rows rows at most
    sizes = found.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    sizes = sizes.withColumn("before", F.sum("bytes").over(Window.orderBy(*order)))  # one row an id
    return found.join(F.broadcast(sizes.filter(F.col("before") <= max_bytes).select("doc_id")), "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", use: Column | None = None) -> Model:
    """Fit and calibrate from all labelled rows.  ``use`` filters them (a column over
    ``doc_id``); default: those not held out."""
    use = ~held_out(F.col("doc_id")) if use is None else use
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(use)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return _constant(totals)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in K.chunks(batch):
                ids, cut = token_ids(data, off)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("y"), pa.array(packed(ids, cut), pa.binary())], names=["doc_id", "lang", "y", "ids"])

    kind = own.schema["doc_id"].dataType.simpleString()
    known = maybe_broadcast(materialize(known, "toxicity-labels"))
    rows = own.join(known, "doc_id").mapInArrow(tidied(tokens), f"doc_id {kind}, lang string, y int, ids binary")
    order = F.xxhash64("doc_id")
    rows = rows.select("doc_id", "lang", "y", "ids", order.alias("order"), (F.pmod(order, F.lit(5)) == 0).alias("kept"))
    tasks = -(-sum(totals.values()) // TASK_ROWS)
    rows = rows.repartition(tasks, "order").sortWithinPartitions("order", "doc_id", F.xxhash64("ids")).select("lang", "y", "ids", "kept").persist(StorageLevel.DISK_ONLY)
    try:
        return _learn(rows, totals)
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang", out: str = "score") -> DataFrame:
    """``docs`` with ``out`` (double) and ``out``_threshold of the row's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, out, f"{out}_threshold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            for part, data, off in K.chunks(batch, text):
                value = m.scores(*token_ids(data, off))
                limit = [m.thresholds.get(x, m.threshold) for x in part.column(names.index(lang)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64()), pa.array(limit, pa.float64())], names=[*names, out, f"{out}_threshold"])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(f"{out}_threshold", T.DoubleType())])
    return docs.mapInArrow(tidied(run), schema)


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; then threshold (of
    the language) and rejected (score at or above it)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        F.col("score_threshold").alias("threshold"),
        (F.col("score") >= F.col("score_threshold")).alias("rejected"),
    )

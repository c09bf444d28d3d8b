"""Importance resampling against a plain loop with zlib."""

import hashlib
import math
import re
import zlib

import numpy as np

from lodestone.llm import resample

SCHEMA = "doc_id long, text string, weight string, rank string, words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _buckets(text, n, buckets):
    w = _words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def _plain(docs, items, n=2, buckets=10000, percent=25, least=20, seed=7):
    s, t = [0] * buckets, [0] * buckets
    for total, texts in ((s, [x for _, x in docs]), (t, items)):
        for x in texts:
            for b in _buckets(x, n, buckets):
                total[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        found = _buckets(x, n, buckets)
        weight, score = sum(gain[b] for b in found) // len(found) if found else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(_words(x)), len(found), weight, score))
    able = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0], -r[3], -r[2], -r[1]))
    few = percent * len(able) // 100
    place = [(*r, i + 1 if i < few else None) for i, r in enumerate(able)]
    return place + [(*r, None) for r in rows if r[1] < least or r[4] is None]


def _check(spark, docs, items, **how):
    frame = spark.createDataFrame([(i, x, "w", "r", 1) for i, x in docs], SCHEMA).repartition(3)
    target = spark.createDataFrame([(x, 5) for x in items], "text string, doc_id int")
    got = resample.resample(frame, target, **{k: v for k, v in how.items() if k != "least"}, min_words=how.get("least", 20))
    want = _plain(docs, items, **{k: v for k, v in how.items() if k != "chunk"})
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def _text(rng, n):
    return " ".join(f"{'Wé' if rng.random() < 0.2 else 'w'}{rng.integers(300)}{',' if rng.random() < 0.1 else ''}" for _ in range(n))


def test_against_a_plain_loop_with_edge_rows(spark):
    rng = np.random.default_rng(3)
    docs = [(i, _text(rng, int(rng.integers(1, 80)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "!!! ..."), (None, docs[0][1]), (5, docs[5][1]), (5, docs[5][1]), (5, docs[6][1]), (303, "long" * 5000), (304, _text(rng, 20000))]
    items = [_text(rng, 30) for _ in range(20)] + [None, "", "One"]
    _check(spark, docs, items)


def test_chunks_own_what_starts_in_them(spark):
    """Cut every few words, with features of one to four words."""
    rng = np.random.default_rng(5)
    docs = [(i, _text(rng, int(rng.integers(1, 120)))) for i in range(60)] + [(90, "a" * 500 + " b " + "c" * 300), (91, "-" * 400)]
    items = [_text(rng, 200), _text(rng, 3)]
    for n in (1, 2, 4):
        _check(spark, docs, items, n=n, buckets=97, chunk=40, percent=60, least=3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(1, "a b c", "", "", 0)], SCHEMA)
    assert resample.resample(none, none).collect() == []
    assert len(resample.resample(docs, none, min_words=1, percent=100).collect()) == 1
    assert resample.resample(none, docs).collect() == []


def test_crc_of_spans():
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 3800, 200))
    ends = starts + rng.integers(0, 120, 200)
    got = resample.crc32(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resample._spaced(got).tolist() == [zlib.crc32(data[a:b].tobytes() + b" ") for a, b in zip(starts, ends)]

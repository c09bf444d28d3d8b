"""Rows that shorter forms of the training-data operators would leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import kernels, neardup, passages, toxicity

DOCS = "doc_id long, text string"


def _words(rng, n):
    return [f"v{rng.integers(10**9)}" for _ in range(n)]


def _covered(rows, start, end):
    return sum(max(0, min(r["end"], end) - max(r["start"], start)) for r in rows) / (end - start)


@pytest.mark.parametrize("one, gap, two", [(60, 40, 60), (200, 100, 200), (30, 30, 80), (10, 20, 60)])
def test_passages_go_on_behind_a_gap(spark, one, gap, two):
    rng = np.random.default_rng(one)
    texts = []
    for pair in range(10):
        p, q = _words(rng, one), _words(rng, two)
        texts += [(2 * pair + side, " ".join(p + _words(rng, gap) + q)) for side in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(texts, DOCS)).collect()
    for pair in range(10):
        own = [r for r in got if r["doc_id"] == 2 * pair + 1 and r["other_id"] == 2 * pair]
        assert _covered(own, one + gap, one + gap + two) > 0.9
        assert one < 50 or _covered(own, 0, one) > 0.9
        assert all(r["identity"] >= 0.8 and r["end"] - r["start"] >= 50 for r in own)


@pytest.mark.parametrize("parts", [[20, 20, 20], [40] * 4, [20] * 6])
def test_passages_made_of_phrases_seen_before(spark, parts):
    """Two documents share a passage whose every phrase stands alone in an earlier
    document, and in one between the two."""
    rng = np.random.default_rng(len(parts))
    texts = {}
    for trial in range(20):
        phrases = [_words(rng, n) for n in parts]
        for i, phrase in enumerate(phrases):
            for doc in (i, 11 + i):
                texts[100 * trial + doc] = " ".join(_words(rng, 40) + phrase + _words(rng, 40))
        for doc in (10, 20):
            texts[100 * trial + doc] = " ".join(_words(rng, 40) + sum(phrases, []) + _words(rng, 40))
    got = passages.repeated_passages(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    whole = sum(parts)
    found = {t for t in range(20) if _covered([r for r in got if (r["doc_id"], r["other_id"]) == (100 * t + 20, 100 * t + 10)], 40, 40 + whole) > 0.9}
    assert len(found) == 20


def test_neardup_links_inside_a_crowd(spark):
    """800 texts share 175 of 200 words (0.78 alike); row i and row i + 400 of the
    first 20 share 3 more (0.802)."""
    rng = np.random.default_rng(4)
    common, texts, want = _words(rng, 175), {}, {}
    for i in range(400):
        more = _words(rng, 3) if i < 20 else []
        for j in (i, i + 400):
            texts[j] = " ".join(common + more + _words(rng, 25 - len(more)))
            want[j] = i if i < 20 else j
    out = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), DOCS), shingle=1)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want


def test_passages_fuzzy_recall_and_no_false_ones(spark):
    """Planted passages with words changed at random: the share found at three rates,
    and nothing between documents that share nothing."""
    rng = np.random.default_rng(21)
    texts, pairs = {}, []
    for rate in (0.05, 0.1, 0.15):
        for n in (60, 100):
            for _ in range(20):
                run = _words(rng, n)
                changed = [w if rng.random() > rate else f"c{rng.integers(10**9)}" for w in run]
                a = len(texts)
                texts[a] = " ".join(_words(rng, 70) + run + _words(rng, 30))
                texts[a + 1] = " ".join(_words(rng, 20) + changed + _words(rng, 90))
                pairs.append((rate, a, n))
    got = passages.repeated_passages(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    assert {(r["other_id"], r["doc_id"]) for r in got} <= {(a, a + 1) for _, a, _ in pairs}
    assert all(r["identity"] >= 0.8 and min(r["end"] - r["start"], r["other_end"] - r["other_start"]) >= 50 for r in got)
    found = {r["doc_id"] for r in got if _covered([r], 20, 70) > 0.5}
    share = {rate: np.mean([a + 1 in found for x, a, _ in pairs if x == rate]) for rate in (0.05, 0.1, 0.15)}
    print(share)
    assert share[0.05] >= 0.95 and share[0.1] >= 0.9 and share[0.15] >= 0.7


def test_passages_exact_runs_by_brute_force(spark):
    """Every shared exact run of 50 words or more between any two of 40 texts is
    covered by passages of the later text, and repeated ids take one text."""
    rng = np.random.default_rng(23)
    vocabulary = [f"t{i}" for i in range(300)]
    pool = [list(rng.choice(vocabulary, rng.integers(50, 90))) for _ in range(8)]
    texts = {i: _words(rng, 60) + pool[rng.integers(8)] + _words(rng, 40) + pool[rng.integers(8)] for i in range(40)}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(7, "z " + " ".join(texts[7]))]
    got = passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    for later, words in texts.items():
        grams = {tuple(texts[e][i : i + 50]) for e in range(later) for i in range(len(texts[e]) - 49)}
        shared = {p for i in range(len(words) - 49) if tuple(words[i : i + 50]) in grams for p in range(i, i + 50)}
        covered = {p for r in got if r["doc_id"] == later for p in range(r["start"], r["end"])}
        assert shared <= covered


def test_passages_of_a_large_family_are_one_class(spark):
    """150 texts of 100 words, 9 of them changed in each: more than CROWD.  Representative
    pairs and membership hold every pair; texts of their own stay out."""
    rng = np.random.default_rng(150)
    common, texts = _words(rng, 100), {}
    for i in range(150):
        own = list(common)
        for at in rng.choice(100, 9, replace=False):
            own[at] = _words(rng, 1)[0]
        texts[i] = own
    texts |= {200 + i: _words(rng, 100) for i in range(20)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], DOCS)
    found = passages.repeated_passages(docs).cache()
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in passages.passage_classes(found).collect()}
    assert set(rows) == set(range(150)) and {c for c, _ in rows.values()} == {0}
    assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} == set(range(1, 150))
    alike = [(i, j) for i in range(150) for j in range(i) if sum(x == y for x, y in zip(texts[i], texts[j])) >= 80]
    assert len(alike) > 10_000 and all(rows[i][0] == rows[j][0] for i, j in alike)
    assert all(n >= 1 for _, n in rows.values())
    assert passages.passage_classes(found.limit(0)).collect() == []


def test_alignment_by_stretches_equals_word_by_word(monkeypatch):
    """The look at many words at once against a plain loop over single words."""
    rng = np.random.default_rng(8)

    def plain(a, b, reach=passages.REACH, agree=4):
        i = j = 0
        runs = []
        while i < len(a) and j < len(b):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n:
                runs.append((i, j, n))
                i, j = i + n, j + n
            x, y = a[i : i + reach + agree], b[j : j + reach + agree]
            if len(x) < agree or len(y) < agree:
                break
            wide = min(passages.NEAR + 2, len(x)) if len(y) >= min(len(x), passages.NEAR + 2) else 0
            again = [q for q in range(wide - 1) if x[q] == y[q] and x[q + 1] == y[q + 1]]
            if again:
                i, j = i + again[0], j + again[0]
                continue
            meet = [((u + v) * 64 + abs(u - v), u, v) for u in range(len(x) - agree + 1) for v in range(len(y) - agree + 1) if all(x[u + d] == y[v + d] for d in range(agree))]
            if not meet:
                break
            i, j = i + min(meet)[1], j + min(meet)[2]
        return runs

    for t in range(400):
        monkeypatch.setattr(passages, "WINDOW", [2048, 9, 33][t % 3])
        a = rng.integers(0, [3, 12, 1000][t % 3], rng.integers(0, 90)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 12)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 3))] = rng.integers(0, 1050, rng.integers(0, 3)).tolist()
        assert passages.align(np.array(a, np.uint64), np.array(b, np.uint64)) == plain(a, b)


def test_passages_between_all_documents(spark):
    """Fifteen different texts share a passage: each pair is linked, and so are two that
    are only alike where others lie between them.  Equal texts have one row each."""
    rng = np.random.default_rng(31)
    run = _words(rng, 60)
    texts = {i: " ".join(_words(rng, 30) + run + _words(rng, 30)) for i in range(15)}
    texts |= {100 + i: texts[3] for i in range(5)}
    base = _words(rng, 100)
    for i in range(12):
        own = list(base)
        for at in rng.choice(100, 8, replace=False):
            own[at] = f"c{rng.integers(10**9)}"
        texts[200 + i] = " ".join(own)
    got = passages.repeated_passages(spark.createDataFrame(list(texts.items()), DOCS)).collect()
    pairs = {(r["other_id"], r["doc_id"]) for r in got}
    assert {p for p in pairs if p[1] < 15} == {(a, b) for b in range(15) for a in range(b)}
    assert sorted((r["doc_id"], r["other_id"], r["start"], r["end"], r["identity"]) for r in got if 100 <= r["doc_id"] < 200) == [(100 + i, 3, 0, 120, 1.0) for i in range(5)]
    words = {i: t.split() for i, t in texts.items() if i >= 200}
    alike = {(a, b) for b in words for a in words if a < b and sum(x == y for x, y in zip(words[a], words[b], strict=True)) >= 80}
    assert alike and alike <= pairs


@pytest.mark.parametrize("paired", [True, False])
def test_passages_in_runs_of_the_same_two_words(spark, monkeypatch, paired):
    """Seventy documents say two words over and over, 60 or 400 words long: each run is
    covered, at a few chains a document and not one for each place.  The pair's gram is
    one of the quarter that make pairs of seeds, or not."""
    rng = np.random.default_rng(37)
    while True:
        two = _words(rng, 2)
        words, off = kernels.words_of(np.frombuffer(" ".join(two * 8).encode(), np.uint8), np.array([0, len(" ".join(two * 8))]), kernels.NON_WORD)
        if (int(passages.seed_positions(words, off, passages.SEED_WORDS)[1][0]) % 4 == 0) == paired:
            break
    long = [400 if i % 2 else 60 for i in range(70)]
    texts = [(i, " ".join(_words(rng, 20) + two * (n // 2) + _words(rng, 20))) for i, n in enumerate(long)]
    made, write = {}, passages.materialize

    def counted(df, label):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    got = passages.repeated_passages(spark.createDataFrame(texts, DOCS)).collect()
    for i, n in enumerate(long[1:], 1):
        places = {p for r in got if r["doc_id"] == i for p in range(r["start"], r["end"])}
        assert places >= set(range(20, 20 + n)), i
    print(made["passage-chains"])
    assert made["passage-chains"] <= 25 * len(texts)


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """Labelled toxic rows behind the first 8,000 (by a hash of their id) hold a sign of
    their own; passes dealt over several tasks learn it, and the same twice."""
    rng = np.random.default_rng(41)
    ids = spark.range(12_000).filter(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    late = set(ids[8000:])
    assert len(late) > 1000
    rows = [(i, " ".join([f"w{n}" for n in rng.integers(0, 60, 5)] + (["vile" if i in late else "nasty"] if i < 12_000 else [])), "en") for i in range(15_000)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    labels = spark.createDataFrame([(i, int(i < 12_000)) for i in range(15_000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TASK_ROWS", 5000)
    models = [toxicity.train(docs, labels) for _ in range(2)]
    probe = spark.createDataFrame([(1, "w1 w2 vile w3", "en"), (2, "w1 w2 nasty w3", "en"), (3, "w1 w2 w4 w3", "en")], DOCS + ", lang string")
    first, again = ([r["score"] for r in toxicity.score(probe, m).orderBy("doc_id").collect()] for m in models)
    assert first[0] >= 0.5 and first[1] >= 0.5 and first[2] < 0.5
    assert first == again


def test_toxicity_winners_by_stretches(monkeypatch):
    rng = np.random.default_rng(43)
    model = toxicity.fresh()
    ids, off = rng.integers(0, toxicity.VOCABULARY, 400), np.array([0, 3, 250, 400])
    for a, b in zip(off[:-1], off[1:], strict=True):
        ids[b - 2 : b] = toxicity.PAD
    whole = model.winners(ids, off)
    monkeypatch.setattr(toxicity, "STRETCH", 50)
    parts = model.winners(ids, off)
    assert all(np.array_equal(p, q) for p, q in zip(whole[1], parts[1], strict=True))
    assert all(np.allclose(p, q) for p, q in zip(whole[0], parts[0], strict=True))


def test_toxicity_training_moves_little(spark, monkeypatch):
    """Six passes over four tasks: what all of the training shuffles stays under 45 bytes
    a word of training text (34; with four-byte ids and weights 63)."""
    rng = np.random.default_rng(47)
    rows = [(i, " ".join([f"w{n}" for n in rng.integers(0, 20_000, 60)] + ["vile"] * (i % 2)), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TASK_ROWS", 1000)
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = shuffled()
    toxicity.train(docs, labels)
    moved = (shuffled() - before) / (4000 * 60)
    print(moved)
    assert 0 < moved < 45


def test_toxicity_ids_keep_their_bits():
    rng = np.random.default_rng(53)
    for n in range(9):
        own = rng.integers(0, toxicity.VOCABULARY, n)
        padded = np.append(own if n else [toxicity.PAD], [toxicity.PAD] * (max(toxicity.WIDTHS) - 1))
        assert np.array_equal(toxicity.unpacked(toxicity.packed(padded, np.array([0, len(padded)]))[0]), padded)

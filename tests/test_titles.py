"""Title lists, postings, spellings, row ranges, commits and checksums of a generation."""

import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import checksums, engine, titles
from lodestone.operators import index as I
from lodestone.operators import papers as P

PAPERS = "row_id long, work_id string, title string, snippet string, publication_year int, cited_by_count long, topic string, field string, is_oa boolean, doi string, authors array<string>"
HOT = 12_000


def _titles():
    rng = random.Random(3)
    words = ["deep", "sea", "river", "cold-water", "Érosion", "model", "pre-training"]
    rows = [f"a study of {rng.choice(words)} {i}" for i in range(HOT)]
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    return [*rows, "pre training of models", "pre-training of models", "pre-training-of models", "training pre of models", ""]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, f"W{i}", t, "text", rng.choice([0, 1990, 2000, 2010]), rng.choice([0, 0, 0, 1, 3, 3, rng.randint(0, 5000)]), f"t{i % 3}", "en", rng.random() < 0.02, "", []) for i, t in enumerate(_titles())]
    papers = spark.createDataFrame(rows, PAPERS).withColumn("normalized_title", X.normalize_title(F.col("title")))
    random_ = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in random_.normal(size=4)]) for i in range(40)], "vec_id long, embedding array<double>")
    centroids = vectors.filter("vec_id < 2").select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("c"))
    out = str(tmp_path_factory.mktemp("titles") / "one")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    I.build(papers, vectors, out, centroids=centroids)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return out, rows


PATCHES = {"W5": ({"title": "a study of patched things"}, False), "W7": ({"title": "Something else"}, False), "W9": ({}, True), "W11": ({"cited_by_count": "900000", "is_oa": "true"}, False)}


def _now(rows, patches):
    for i, w, t, _, year, cited, topic, _, oa, *_ in rows:
        changes, unreliable = patches.get(w, ({}, False))
        cited = int(changes.get("cited_by_count", cited))
        yield i, X.plain_key(changes.get("title", t)), year, 0 if unreliable else cited, topic, changes.get("is_oa", str(oa).lower()) == "true"


@pytest.mark.parametrize("patches", [{}, PATCHES])
def test_most_cited_rows_equal_a_full_sort(spark, built, patches):
    """A prefix of more than 10,000 rows, with filters that few of them pass."""
    out, rows = built
    frame = spark.createDataFrame([(w, c, u) for w, (c, u) in patches.items()], "work_id string, changes map<string,string>, unreliable boolean") if patches else None
    index = I.open_index(spark, out, patches=frame)
    cases = [(P.Filters(), lambda r: True), (P.Filters(is_oa=True), lambda r: r[5]), (P.Filters(is_oa=True, year_min=2005, topic="t1"), lambda r: r[5] and r[2] >= 2005 and r[4] == "t1"), (P.Filters(min_citations=10**9), lambda r: False)]
    for filters, passes in cases:
        for limit in (1, 50):
            want = sorted(((c, i) for r in _now(rows, patches) if passes(r) and r[1].startswith("a study of ") for i, c in [(r[0], r[3])]), key=lambda x: (-x[0], x[1]))[:limit]
            assert engine.prefix_rows(index, ["a study of", "a study of deep"], filters, limit) == want
    key = X.plain_key(rows[HOT + 3][2])
    want = sorted(((r[3], r[0]) for r in _now(rows, patches) if r[1] == key), key=lambda x: (-x[0], x[1]))[:100]
    assert engine.exact_title_rows(index, [key], P.Filters()) == want
    assert engine.exact_title_rows(index, [], P.Filters()) == [] and engine.prefix_rows(index, ["two words"], P.Filters()) == []


def test_a_common_prefix_is_not_read_to_its_end(spark, built):
    index = I.open_index(spark, built[0])
    top = index.probe_plain("prefixes", ["a study of"]).filter("level >= 9")
    assert 0 < top.count() < HOT / 4
    order = [tuple(r) for r in index.table("prefixes").filter("bucket is not null").select("_metadata.file_path", "plain", "key", "level", "cited_by_count", "row_id").collect()]
    assert all((a[1], a[2], -a[3], -a[4], a[5]) <= (b[1], b[2], -b[3], -b[4], b[5]) for a, b in itertools.pairwise(order) if a[0] == b[0])


def test_spellings_are_all_that_are_stored(spark, built):
    index = I.open_index(spark, built[0])
    stored = {X.plain_key(t) for t in _titles()}
    for key in ("pre training of models", "pre-training of models", "a study of cold water 7", "pre training", "deep", "cold water sea"):
        words = key.split()
        every = {"".join(w + s for w, s in zip(words, (*seps, ""), strict=True)) for seps in itertools.product(" -", repeat=len(words) - 1)} if len(words) > 1 else set()
        assert titles.spellings(titles.gathered(index, [key])["titles"], key) == sorted((every & stored) - {key}, key=lambda s: (s.count("-"), s))[: titles.SPELLINGS]
    exact, _, keys = engine.title_candidates(index, "training pre-of models", P.Filters())
    assert exact and keys


def test_title_search_by_postings(spark, built):
    out, rows = built
    index = I.open_index(spark, out)
    split = {i: [w for w in re.split("[ -]", X.fold_accents(X.plain_key(t))) if w] for i, _, t, *_ in rows}

    def want(phrases):
        words = {w for p in phrases for w in p}
        has = lambda w, p: any(w[k : k + len(p)] == p for k in range(len(w)))
        return {i for i, w in split.items() if words <= set(w) and all(has(w, p) for p in phrases)}

    for query, phrases in (("erosion deep", [["erosion"], ["deep"]]), ("Érosion", [["erosion"]]), ("pre-training", [["pre", "training"]]), ("pre training", [["pre"], ["training"]]), ("pre-training-of models", [["pre", "training", "of"], ["models"]]), ("nowhere deep", [["nowhere"], ["deep"]])):
        assert {r["row_id"] for r in titles.search(index, query, 10**6).collect()} == want(phrases), query
    oa = {r[0] for r in rows if r[8]}
    assert {r["row_id"] for r in titles.search(index, "study", 10**6, P.Filters(is_oa=True)).collect()} == want([["study"]]) & oa
    assert titles.search(index, "...", 5).collect() == []
    scores = [r["bm25"] for r in titles.search(index, "deep sea", 50).collect()]
    assert scores == sorted(scores, reverse=True)


def test_fetch_opens_the_files_of_its_ids(spark, built):
    index = I.open_index(spark, built[0])
    files = {r["file"] for r in index.table("ranges").filter("name = 'papers'").collect()}
    assert len(files) > 1
    rows = index.fetch([3, 4, 5, -7, 10**12])
    assert {r["row_id"] for r in rows.collect()} == {3, 4, 5} and len(rows.inputFiles()) == 1
    assert index.fetch([-1]).collect() == [] and index.fetch([]).collect() == []


def test_checksums_notice_one_byte(spark, built, tmp_path):
    checksums.verify(spark, built[0])
    I.open_index(spark, built[0], verify=True)
    base = tmp_path / "t"
    (base / "a").mkdir(parents=True)
    (base / "a" / "x.bin").write_bytes(bytes(range(256)) * 40)
    (base / "a" / "y.bin").write_bytes(b"")
    for size in (1000, checksums.RANGE):
        one = sorted(tuple(r) for r in checksums.sums(spark, str(base), ["a"], size=size).collect())
        two = sorted(tuple(r) for r in checksums._by_binary_reader(spark, str(base), {"a/x.bin": 10240, "a/y.bin": 0}, size).collect())
        assert one == two and [r[1] for r in one] == [10240, 0]
    checksums.write(spark, str(base), ["a"])
    data = bytearray((base / "a" / "x.bin").read_bytes())
    data[5000] ^= 1
    (base / "a" / "x.bin").write_bytes(data)
    with pytest.raises(ValueError, match="a/x.bin"):
        checksums.verify(spark, str(base))


def test_pointers_and_stopped_writers(spark, built, tmp_path):
    files = I.Files(spark, str(tmp_path))
    root = str(tmp_path / "g")
    assert I.current(files, root) is None
    with pytest.raises(ValueError, match="not complete"):
        I.publish(files, root, "one")
    for name in ("one", "two"):
        assert files.create(f"{root}/{name}/manifest.json", "{}")
    assert I.publish(files, root, "one") == 0 and I.current(files, root) == "one"
    # A writer that stopped inside its pointer: the one before stays in force.
    Path(f"{root}/pointers/000000000001.json").write_text('{"gener')
    assert I.current(files, root) == "one"
    assert I.publish(files, root, "two") == 2 and I.current(files, root) == "two"
    assert not files.create(f"{root}/one/manifest.json", "other") and files.read(f"{root}/one/manifest.json") == "{}"
    with pytest.raises(ValueError, match="part"):
        files.read(f"{root}/pointers/000000000001.json")
    with pytest.raises(FileExistsError):
        I.build(I.open_index(spark, built[0]).table("papers"), spark.createDataFrame([], "vec_id long, embedding array<double>"), built[0])


def test_case_folding_of_every_character(spark):
    """Spark's keys are Python's, for each character that folding changes, in words."""
    odd = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c and c.isalpha()]
    # Letters that are newer than the JVM's own Unicode data are none to its patterns.
    known = spark.createDataFrame([(c,) for c in odd], "c string").filter(F.rlike("c", F.lit(r"^\p{L}$"))).collect()
    texts = [f"x{r['c']}y {r['c']}" for r in known] + ["Περί Λόγος", "ΛΌΓΟΣ", "Straße ﬁn", "İstanbul"]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.normalize_title(F.col("t")).alias("k"))
    assert [r["k"] for r in got.orderBy("i").collect()] == [X.plain_key(t) for t in texts]

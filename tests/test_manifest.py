"""The manifest source: order, retries inside a part, resume, streams; and numbering."""

import gzip
import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import numbering
from lodestone.sources import manifest, works


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Three files, newest name first c, b, a; one compressed, one without a last line end."""
    root = tmp_path_factory.mktemp("m")
    held = {"d=3/c.gz": [f"c{i} é" for i in range(500)], "d=2/b.txt": [f"b{i}\rx" for i in range(300)] + [""], "d=1/a.txt": [f"a{i}" for i in range(40)]}
    for name, rows in held.items():
        (root / name).parent.mkdir(exist_ok=True)
        raw = ("\n".join(rows) + ("\n" if "a.txt" not in name else "")).encode()
        (root / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
    listed = {"entries": [{"url": f"s3://bucket/x/{n}", "meta": {"record_count": len(held[n])} if "b.txt" not in n else {}} for n in ("d=1/a.txt", "d=3/c.gz", "d=2/b.txt")]}
    (root / "manifest").write_text(json.dumps(listed))
    return root, held


def _read(spark, root, stream=False, **options):
    spark.dataSource.register(manifest.ManifestSource)
    reader = (spark.readStream if stream else spark.read).format("manifest_lines").option("manifest", f"file://{root}/manifest").option("strip", "s3://bucket/x/")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def _want(held, skip=(0, 0)):
    rows = [(f, i, v) for f, n in enumerate(held) for i, v in enumerate(held[n])]
    return [r for r in rows if (r[0], r[1]) >= skip]


@pytest.mark.parametrize("per", [0, 7, 10_000])
def test_rows_in_the_order_of_the_manifest(spark, files, per):
    root, held = files
    got = [(r["file_rank"], r["line"], r["value"]) for r in _read(spark, root, lines_per_part=per).orderBy("file_rank", "line").collect()]
    assert got == _want(held)
    got = [(r["file_rank"], r["line"], r["value"]) for r in _read(spark, root, lines_per_part=per, skip_files=1, skip_lines=290).orderBy("file_rank", "line").collect()]
    assert got == _want(held, (1, 290))


def test_a_broken_read_goes_on_from_the_first_line_not_handed_over(files, monkeypatch):
    root, held = files
    monkeypatch.setattr(manifest, "ROWS", 10)
    monkeypatch.setattr(manifest, "READ_BYTES", 64)
    pauses: list[float] = []
    monkeypatch.setattr(manifest.time, "sleep", pauses.append)
    reading = manifest._Reading({"manifest": f"file://{root}/manifest", "strip": "s3://bucket/x/"})
    whole, opened, broken = reading._open, [], {1: 200, 2: 1500, 3: 10}

    class Breaking:
        def __init__(self, inner, after):
            self.inner, self.left = inner, after

        def read(self, n):
            self.left -= n
            if self.left < 0:
                raise OSError("connection lost")
            return self.inner.read(n)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.inner.close()

    def open_(path):
        opened.append(path)
        return Breaking(whole(path), broken.get(len(opened), 10**9))

    monkeypatch.setattr(reading, "_open", open_)
    (part,) = reading.parts((0, 0), (0, 500))
    rows = [v for b in reading.read(part) for v in b.column(2).to_pylist()]
    assert rows == held["d=3/c.gz"] and len(opened) == 4 and pauses[0] == 1.0
    broken.update({i: 10 for i in range(5, 50)})
    with pytest.raises(OSError, match="lost"):
        list(reading.read(part))
    assert len(opened) == 4 + manifest.ATTEMPTS and max(pauses) <= manifest.LONGEST_PAUSE


@pytest.mark.parametrize("promised", [499, 501])
def test_a_file_must_hold_what_the_manifest_says(spark, files, tmp_path, promised):
    root, _ = files
    (tmp_path / "manifest").write_text(json.dumps({"entries": [{"url": "d=3/c.gz", "meta": {"record_count": promised}}]}))
    reading = manifest._Reading({"manifest": f"file://{tmp_path}/manifest", "root": f"file://{root}"})
    with pytest.raises(ValueError, match="of the manifest"):
        [b for p in reading.parts((0, 0), None) for b in reading.read(p)]


def test_a_stream_goes_on_from_its_offset(spark, files, tmp_path):
    root, held = files

    def go(most):
        rows = _read(spark, root, stream=True, progress=f"file://{tmp_path}/at", lines_per_batch=120)
        seen: list[int] = []

        def sink(batch, n):
            seen.append(batch.count())
            batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
            if len(seen) == most:
                raise RuntimeError("stopped here")

        query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return seen

    with pytest.raises(Exception, match="stopped here"):
        go(3)
    go(10**9)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted({(r["file_rank"], r["line"], r["value"]) for r in out.collect()})
    assert got == _want(held)
    # Only the batch that was stopped in its sink came twice; no other line did.
    twice = out.groupBy("file_rank", "line").count().filter("count > 1").count()
    assert 0 < twice <= 120 and go(10**9) == []


def test_a_stream_without_progress_takes_what_is_left(spark, files, tmp_path):
    root, held = files
    rows = _read(spark, root, stream=True, skip_files=1, skip_lines=100)
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r["file_rank"], r["line"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == _want(held, (1, 100))


def test_lines_are_numbered_without_a_window(spark, tmp_path):
    """A plain file of many splits, a compressed one, and an empty one."""
    text = [f"line {i}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(text) + "\n")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress("\n".join(text[:77]).encode()))
    (tmp_path / "c.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = works.read_lines(spark, str(tmp_path))
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in rows.collect()}
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("a.txt", i): v for i, v in enumerate(text)} | {("b.txt.gz", i): v for i, v in enumerate(text[:77])}
    assert "Window" not in plan


def test_numbers_from_0_in_an_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(5)
    got = [r["k"] for r in numbering.numbered(rows, F.desc("k")).orderBy("pos").collect()]
    assert got == sorted(got, reverse=True)
    assert sorted(r["pos"] for r in numbering.numbered(rows, "k").collect()) == list(range(1000))
    assert numbering.numbered(rows.limit(0), "k").collect() == []
    assert isinstance(pa.array(got), pa.Array)


def test_parts_of_a_file_do_not_grow_with_it(tmp_path):
    """Each part reads from the file's begin: a part for every five lines is a reading of the
    whole file for every ten."""
    (tmp_path / "a").write_bytes(b"".join(b"line %d\n" % i for i in range(5000)))
    (tmp_path / "manifest").write_text(json.dumps({"entries": [{"url": "a", "meta": {"record_count": 5000}}]}))
    reading = manifest._Reading({"manifest": (tmp_path / "manifest").as_uri(), "lines_per_part": "5"})
    parts = reading.parts((0, 0), None)
    assert len(parts) <= 16
    got = [v for p in parts for b in reading.read(p) for v in zip(b.column("line").to_pylist(), b.column("value").to_pylist(), strict=True)]
    assert got == [(i, f"line {i}") for i in range(5000)]


def test_skipped_lines_are_counted(monkeypatch):
    monkeypatch.setattr(manifest, "READ_BYTES", 4)
    for text in (b"", b"a", b"a\n", b"a\nbcdefghij\n\n\nk", b"\n\n\nabcdefgh\n"):
        whole = list(manifest.lines(io.BytesIO(text)))[1:]
        assert whole == [x for x in text.split(b"\n")][: len(text.split(b"\n")) - (not text.split(b"\n")[-1])]
        for skip in range(len(whole) + 3):
            found = list(manifest.lines(io.BytesIO(text), skip))
            assert found[0] == min(skip, len(whole)) and found[1:] == whole[skip:]

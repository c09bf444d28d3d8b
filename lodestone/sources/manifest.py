"""A data source over a manifest of line files, for batches and streams.

The manifest is a JSON object whose ``entries`` name files (``url``) and, where known,
their numbers of lines (``meta.record_count``).  Files are taken newest name first;
``file_rank`` and ``line`` say where a row comes from.  Each part of a file is a
partition of its own: Spark tries a failed one again alone, and inside a try a broken
read goes on from the first line that was not handed over, up to ``attempts`` times with
growing pauses.  A file that ends before, or goes on behind, the lines that the manifest
promises is an error.  A stream's offsets are (file, line), so it goes on where its
checkpoint says.

    spark.dataSource.register(ManifestSource)
    spark.read.format("manifest_lines").option("manifest", path).load()
    spark.readStream.format("manifest_lines").option("manifest", path).option("progress", folder)...

Options: manifest, root (default: the manifest's folder; urls are taken below it by
their path behind ``strip``), strip, skip_files, skip_lines, lines_per_part,
lines_per_batch, progress, attempts.  Compressed files (by name: .gz, .bz2, .zst) are read as one
stream; they are split into parts by lines all the same, and each part skips to its
first line.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file_rank int, line bigint, value string, file string"
READ_BYTES, ROWS = 1 << 20, 4096
#: Most parts of one file.
MOST_PARTS = 16
#: Tries of one part, and the longest pause between two, in seconds.
ATTEMPTS, LONGEST_PAUSE = 5, 10.0


@dataclass(frozen=True)
class Entry:
    rank: int
    url: str
    path: str
    records: int | None


@dataclass
class Part(InputPartition):
    """Lines ``first`` to ``last`` (None: to the end) of a file; ``whole`` if the file's promised
    number ends it."""

    entry: Entry
    first: int
    last: int | None
    whole: bool


def entries(options: dict[str, str]) -> tuple[str, list[Entry]]:
    """(root, files newest name first) of a manifest."""
    where = options["manifest"]
    system, path = pafs.FileSystem.from_uri(where)
    with system.open_input_stream(path) as f:
        raw = json.loads(f.read())
    root = options.get("root") or where.rsplit("/", 1)[0]
    strip, out = options.get("strip", ""), []
    for rank, e in enumerate(sorted(raw["entries"], key=lambda e: e["url"], reverse=True)):
        n = (e.get("meta") or {}).get("record_count")
        out.append(Entry(rank, e["url"], e["url"].removeprefix(strip).lstrip("/"), n if n is None else int(n)))
    return root, out


def lines(stream: pa.NativeFile, skip: int = 0) -> Iterator[bytes | int]:
    """Lines of a stream of bytes, cut at ``\\n`` alone; a last one without it counts.  The
    first ``skip`` are only counted, block by block: how many of them there were comes first."""
    rest, left = b"", skip
    while left:
        block = stream.read(READ_BYTES)
        if not block:
            yield skip - left + bool(rest)
            return
        n = block.count(b"\n")
        if n < left:
            left -= n
            rest = block[block.rfind(b"\n") + 1 :] if n else rest + block[:1]  # only whether it is empty counts
            continue
        at = -1
        for _ in range(left):
            at = block.index(b"\n", at + 1)
        left, rest = 0, block[at + 1 :]
    yield skip
    *whole, rest = rest.split(b"\n")
    yield from whole
    while True:
        block = stream.read(READ_BYTES)
        if not block:
            break
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class _Reading:
    """What batch and stream share."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.root, self.entries = entries(self.options)
        self.attempts = int(self.options.get("attempts", ATTEMPTS))
        self.part_lines = int(self.options.get("lines_per_part", 0))

    def parts(self, begin: tuple[int, int], end: tuple[int, int] | None) -> list[Part]:
        """Parts from (file, line) to (file, line), or to the end of all files."""
        out = []
        end = None if end is not None and end[0] >= len(self.entries) else end
        for e in self.entries[begin[0] : None if end is None else end[0] + 1]:
            first = begin[1] if e.rank == begin[0] else 0
            last = end[1] if end is not None and e.rank == end[0] else e.records
            to_end = end is None or e.rank < end[0] or (e.records is not None and end[1] >= e.records)
            if last is not None and first >= last and not (to_end and first == last == 0):
                continue
            step = self.part_lines or (max(1, last - first) if last is not None else 0)
            if last is not None and step:
                # Each part reads from the file's begin, so their number must not grow with it.
                step = max(step, -(-(last - first) // MOST_PARTS))
            if last is None or not step:
                out.append(Part(e, first, last, False))
                continue
            cuts = list(range(first, last, step)) or [first]
            out += [Part(e, a, min(a + step, last), to_end and a + step >= last) for a in cuts]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        at, tried = partition.first, 0
        while True:
            try:
                for batch, n in self._from(partition, at):
                    yield batch
                    at += n
                    tried = 0  # what was handed over is not read again
                return
            except (OSError, pa.ArrowInvalid):
                tried += 1
                if tried >= self.attempts:
                    raise
                time.sleep(min(LONGEST_PAUSE, 2.0 ** (tried - 1)))

    def _open(self, path: str) -> pa.NativeFile:
        system, base = pafs.FileSystem.from_uri(self.root)
        return system.open_input_stream(f"{base}/{path}", compression="detect")

    def _from(self, p: Part, at: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        held: list[str] = []

        def batch() -> tuple[pa.RecordBatch, int]:
            n, begin = len(held), seen - len(held)
            made = pa.RecordBatch.from_arrays([pa.array([p.entry.rank] * n, pa.int32()), pa.array(range(begin, seen), pa.int64()), pa.array(held, pa.string()), pa.array([p.entry.url] * n, pa.string())], names=["file_rank", "line", "value", "file"])
            return made, n

        seen, more = 0, False
        with self._open(p.entry.path) as f:
            found = lines(f, at)
            seen = next(found)
            for line in found:
                if p.last is not None and seen >= p.last:
                    more = True
                    break
                seen += 1
                held.append(line.decode("utf-8", "replace"))
                if len(held) == ROWS:
                    yield batch()
                    held = []
        if held:
            yield batch()
        if p.last is not None and seen < p.last or p.whole and more:
            raise ValueError(f"{p.entry.url} has {'more' if more else seen} lines, not the {p.entry.records} of the manifest")


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.reading = _Reading(options)
        self.begin = (int(options.get("skip_files", 0)), int(options.get("skip_lines", 0)))

    def partitions(self) -> list[Part]:
        return self.reading.parts(self.begin, None)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.reading.read(partition)


class StreamReader(DataSourceStreamReader):
    """Without ``progress`` a batch goes to the end of the manifest.  With it, a batch goes on
    for ``lines_per_batch`` lines, or, where a file's number of lines is not known, to
    the end of that file.  Spark does not tell a source that starts anew where it is, so
    each planned batch leaves its end as an empty file there; Spark plans a batch after
    it has logged it, so a batch that was logged and not planned is planned again."""

    def __init__(self, options: dict[str, str]):
        self.reading = _Reading(options)
        self.begin = (int(options.get("skip_files", 0)), int(options.get("skip_lines", 0)))
        self.progress = options.get("progress")
        self.most = int(options.get("lines_per_batch", 100_000))
        self.at: tuple[int, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": self.begin[0], "line": self.begin[1]}

    def _reached(self) -> tuple[int, int]:
        if self.at is None:
            self.at = self.begin
            if self.progress:
                system, path = pafs.FileSystem.from_uri(self.progress)
                found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
                self.at = max([self.begin, *[tuple(map(int, f.base_name.split("-"))) for f in found]])
        return self.at

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.reading.entries
        if not self.progress:
            return {"file": len(files), "line": 0}
        (file, line), left = self._reached(), self.most
        while left > 0 and file < len(files):
            n = files[file].records
            if n is None:
                file, line, left = file + 1, 0, 0
            elif n - line <= left:
                file, line, left = file + 1, 0, left - (n - line)
            else:
                line, left = line + left, 0
        return {"file": file, "line": line}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        reached = (end["file"], end["line"])
        if self.progress:
            system, path = pafs.FileSystem.from_uri(self.progress)
            system.create_dir(path, recursive=True)
            system.open_output_stream(f"{path}/{reached[0]:09d}-{reached[1]:018d}").close()
        self.at = max(self._reached(), reached)
        return self.reading.parts((start["file"], start["line"]), reached)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.reading.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: files are not changed by being read."""


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)

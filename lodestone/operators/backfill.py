"""Backfill in shards with a marker last, resume, and assembly.

A shard is one batch of input in its explicit order.  Its rows are written to
``shards/shard=<n>`` and then its marker to ``markers/<n>.json``; markers without a gap
from 0 are the truth, and whatever else a stopped run left behind is deleted before
the next one goes on.  Settings and the snapshot's identity are pinned at the start;
a run with others is refused, and a snapshot that changes around a shard stops it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators import builds, search
from lodestone.operators.index import Files
from lodestone.operators.numbering import numbered

#: Fixed value: the share of clipped components that stops a shard.
MAX_CLIPPED = 0.01


def snapshot_identity(files: DataFrame, url: str = "url", records: str = "record_count") -> DataFrame:
    """One row: files, records, and a SHA-256 over names and counts in order of names."""
    line = F.concat_ws(" ", url, F.col(records).cast("string"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(url).alias("u"), line.alias("l")))), lambda x: x["l"]), "\n")
    return files.agg(F.count("*").alias("files"), F.sum(records).alias("records"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("identity"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under ``path``, empty ones as well; each file
    is one task's row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty = [(name, 0, hashlib.sha256().hexdigest()) for name in Files(spark, path).empty(path)]
    return found.unionByName(spark.createDataFrame(empty, "name string, bytes long, sha256 string")) if empty else found


def read_shards(spark: SparkSession, path: str, schema: str, expected: int) -> DataFrame:
    """JSON lines of a known schema, refused if they are not ``expected`` rows."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    n = rows.count()
    if n != expected:
        raise ValueError(f"{path} holds {n} rows, not {expected}")
    return rows


def pin(files: Files, path: str, settings: dict) -> None:
    """Write settings once; refuse others later."""
    if files.complete(path):
        held = json.loads(files.read(path))
        differ = sorted(k for k in held.keys() | settings.keys() if held.get(k) != settings.get(k))
        if differ:
            raise ValueError(f"settings differ from the pinned ones: {', '.join(differ)}")
    else:
        files.write(path, json.dumps(settings))


def committed(files: Files, out: str) -> list[dict]:
    """Markers from 0 without a gap whose running sums agree."""
    markers, total = [], 0
    while files.complete(f"{out}/markers/{len(markers)}.json"):
        m = json.loads(files.read(f"{out}/markers/{len(markers)}.json"))
        total += m["records"]
        if m["records_done"] != total:
            break
        markers.append(m)
    return markers


def clear_orphans(files: Files, out: str, done: int) -> list[str]:
    """Delete shards and markers beyond the committed ones; their names."""
    gone = []
    for name in files.list(f"{out}/shards"):
        if name.startswith("shard=") and int(name.split("=")[1]) >= done:
            files.delete(f"{out}/shards/{name}")
            gone.append(name)
    for name in files.list(f"{out}/markers"):
        if not name.split(".")[0].isdigit() or int(name.split(".")[0]) >= done:
            files.delete(f"{out}/markers/{name}")
            gone.append(name)
    return gone


def first_places(rows: DataFrame, out: str) -> DataFrame:
    """(id, shard, line): where each id comes first, over all shards.  Found once for a
    snapshot, in one aggregation, and kept by shard; so no shard rereads those before."""
    spark, files = rows.sparkSession, Files(rows.sparkSession, out)
    if not files.complete(f"{out}/first.json"):
        files.delete(f"{out}/first")
        first = rows.groupBy("id").agg(F.min(F.struct("shard", "line")).alias("at")).select("id", "at.*")
        first.repartitionByRange("shard", "line").write.partitionBy("shard").parquet(f"{out}/first")
        files.write(f"{out}/first.json", "{}")
    return spark.read.parquet(f"{out}/first")


def run(
    rows: DataFrame,
    out: str,
    *,
    settings: dict,
    snapshot: Callable[[], str],
    shards: int,
    stride: int = 7,
    stop_after: int | None = None,
    seed: str | None = None,
    code: str | None = None,
) -> list[dict]:
    """Write the shards that are missing of ``rows`` (shard, line, id, embedding) and
    return all markers.  The first row of an id in (shard, line) order wins, over all
    shards.  ``stop_after`` ends a run early.  The identity of the seed records and the
    code's version are pinned beside the snapshot where they are given."""
    spark, files = rows.sparkSession, Files(rows.sparkSession, out)
    pin(files, f"{out}/settings.json", settings)
    pin(files, f"{out}/snapshot.json", {"identity": snapshot()})
    for name, value in (("seed", seed), ("code", code)):
        if value is not None:
            pin(files, f"{out}/{name}.json", {name: value})
    markers = committed(files, out)
    clear_orphans(files, out, len(markers))
    winners = first_places(rows, out)
    for shard in range(len(markers), shards):
        if stop_after is not None and shard >= stop_after:
            break
        pin(files, f"{out}/snapshot.json", {"identity": snapshot()})
        mine = winners.filter(F.col("shard") == shard).select("id", "line")
        own = numbered(rows.filter(F.col("shard") == shard).join(mine, ["id", "line"], "left_semi"), "line").drop("shard")
        if not files.complete(f"{out}/scales.json"):  # the first shard calibrates
            scales = [r["scale"] for r in search.fit_scales(own).orderBy("pos").collect()]
            files.write(f"{out}/scales.json", json.dumps(scales))
        scales = F.array(*map(F.lit, json.loads(files.read(f"{out}/scales.json"))))
        over = F.aggregate(F.zip_with("embedding", scales, lambda x, s: (F.abs(x.cast("double") / s) > 127.0000001).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        coded = own.select("id", "line", "pos", V.quantize(F.col("embedding"), scales).alias("code"), (F.col("pos") % stride == 0).alias("truth"), F.when(F.col("pos") % stride == 0, F.col("embedding")).alias("truth_vector"), over.alias("clipped"))
        path = f"{out}/shards/shard={shard}"
        coded.write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("clipped").alias("clipped"), F.sum(F.size("code")).alias("parts")).first()
        share = (found["clipped"] or 0) / max(found["parts"] or 0, 1)
        if share > MAX_CLIPPED:
            raise ValueError(f"shard {shard}: {share:.2%} of the components are clipped")
        pin(files, f"{out}/snapshot.json", {"identity": snapshot()})
        marker = {"shard": shard, "records": found["n"], "records_done": sum(m["records"] for m in markers) + found["n"], "clipped": share, "config": json.dumps(settings, sort_keys=True)}
        files.write(f"{out}/markers/{shard}.json", json.dumps(marker))
        markers.append(marker)
    return markers


def assemble(spark: SparkSession, out: str, *, shards: int) -> DataFrame:
    """row_id (from 0, by shard and place), id, code, truth and truth_vector of a complete
    backfill.  Refuses missing shards, counts that disagree, and repeated ids."""
    files = Files(spark, out)
    markers = committed(files, out)
    if len(markers) != shards:
        raise ValueError(f"{len(markers)} of {shards} shards are complete")
    offsets = spark.createDataFrame([(m["shard"], m["records_done"] - m["records"]) for m in markers], "shard int, before long")
    rows = spark.read.parquet(f"{out}/shards").join(F.broadcast(offsets), "shard")  # a row a shard
    rows = rows.select((F.col("before") + F.col("pos")).alias("row_id"), "shard", "id", "code", "truth", "truth_vector")
    check = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("row_id").alias("top")).first()
    if check["n"] != markers[-1]["records_done"] or check["ids"] != check["n"] or check["top"] != check["n"] - 1:
        raise ValueError("shards do not add up to their markers")
    return rows


def truth_rows(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, row_id) of truth vectors; a missing or repeated id is an error."""
    found = truth.select("id").join(rows.select("id", "row_id"), "id")
    n, distinct = found.count(), found.select("id").distinct().count()
    if not n == distinct == truth.count():
        raise ValueError("truth ids are missing or repeated")
    return found


def manifest(spark: SparkSession, out: str) -> dict:
    """Totals, the largest clipped share, and the runs of shards with one configuration."""
    markers = committed(Files(spark, out), out)
    frame = spark.createDataFrame([(m["shard"], m["config"]) for m in markers], "shard int, config string")
    history = [r.asDict() for r in builds.config_history(frame).orderBy("first_shard").collect()]
    return {"shards": len(markers), "records": markers[-1]["records_done"] if markers else 0, "max_clipped": max((m["clipped"] for m in markers), default=0.0), "history": history}

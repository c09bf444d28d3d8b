"""A built index: tables written once, opened with checks, probed by pruned reads.

``papers`` and ``row_codes`` lie in ranges of row_id, and ``ranges`` says which file holds
which, so that a fetch opens the files of its ids alone.  Lookup tables (titles,
prefixes, words, work ids) are partitioned by a bucket of their key's hash and sorted
inside, so that a lookup reads the buckets of its keys alone.  ``codes`` is partitioned
by inverted list.

The manifest, with every file's size and checksum, is the last file written, and only
by a create that fails where one exists: a folder without one is no generation.  Nothing
is renamed, so a store without atomic rename will do; ``publish`` and ``current`` name
the generation in use by numbered pointers, written the same way.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from bisect import bisect_left
from dataclasses import asdict, dataclass, field
from functools import cached_property
from typing import TYPE_CHECKING

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.operators import checksums, search
from lodestone.operators import papers as P
from lodestone.operators import titles as T

if TYPE_CHECKING:
    from lodestone.operators.ivfpq import Settings

FORMAT_VERSION = 2
#: Fewest and most buckets of a lookup table, and papers a bucket between them.
BUCKETS = (8, 4096, 50_000)
#: Ids of one shard of product codes.
SHARD_ROWS = 1_000_000
#: Most keys of one lookup; their buckets go into the plan as literals.
MAX_KEYS = 10_000
#: Ids that a fetch puts into its plan as literals; more are joined.
LITERAL_KEYS = 100
TABLES = (
    "papers", "titles", "titles_levels", "prefixes", "prefixes_levels", "words", "postings",
    "work_ids", "years", "codes", "row_codes", "ranges", "centroids",
)


#: Last line of a file that ``Files.create`` wrote to its end.
END = "\n# end\n"


@dataclass(frozen=True)
class Stage:
    name: str
    records: int


#: The sizes that a build may be confirmed for.
STAGES = {"10k": Stage("10k", 10_000), "100k": Stage("100k", 100_000), "1m": Stage("1m", 1_000_000)}


def stage(name: str) -> Stage:
    """A stage by its name, in any case."""
    found = STAGES.get(name.strip().lower())
    if found is None:
        raise ValueError(f"stage must be one of {', '.join(STAGES)}")
    return found


def confirm_stage(name: str, token: str | None) -> Stage:
    """A stage of over 100,000 records wants its own name as confirmation."""
    found = stage(name)
    if found.records > 100_000 and token != found.name:
        raise ValueError(f"a build of {found.records} records wants the confirmation {found.name!r}")
    return found


def list_count(records: int) -> int:
    """Inverted lists of a corpus: 4 times the square root, 16 to 131,072."""
    return int(min(max(4 * records**0.5, 16), 131_072))


def probe_count(lists: int) -> int:
    return max(8, lists // 8)


class Files:
    """The Hadoop file system of a path: local, distributed or an object store."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a} can't be renamed to {b}")

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def qualified(self, path: str) -> str:
        """The path with its scheme, as executors need it."""
        return self._fs.makeQualified(self._path(path)).toUri().toString().rstrip("/")

    def list(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def empty(self, path: str) -> list[str]:
        """Names of the files without a byte under ``path``, but for hidden ones; Spark's
        readers leave them out."""
        if not self.exists(path):
            return []
        files, out = self._fs.listFiles(self._path(path), True), []
        top = len(self._fs.getFileStatus(self._path(path)).getPath().toUri().getPath())
        while files.hasNext():
            file = files.next()
            if file.getLen() == 0:
                parts = file.getPath().toUri().getPath()[top:].strip("/").split("/")
                if not any(x.startswith(".") or (x.startswith("_") and "=" not in x) for x in parts):
                    out.append(file.getPath().getName())
        return sorted(out)

    def read(self, path: str, check: bool = True) -> str:
        stream = self._fs.open(self._path(path))
        try:
            text = self._io.toString(stream, "UTF-8")
        finally:
            stream.close()
        if check and not text.endswith(END):
            raise ValueError(f"{path} is a part of a file")
        return text.removesuffix(END) if check else text

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does.  The text ends with a
        line of its own that ``read`` wants, so that a part of a file is no file."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Py4JJavaError as e:
            if self.exists(path):
                return False
            raise OSError(f"{path} can't be created") from e
        stream.write(bytearray(f"{text}{END}".encode()))
        stream.close()
        return True

    def plain(self, path: str, text: str) -> None:
        """A file of this text alone, for readers other than ``read``."""
        stream = self._fs.create(self._path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def complete(self, path: str) -> bool:
        """Whether a file is there as a whole."""
        return self.exists(path) and self.read(path, check=False).endswith(END)

    def write(self, path: str, text: str) -> None:
        """Replace a file.  A reader may find none for a moment, but never a part: what a
        stopped writer leaves is not complete."""
        self.delete(path)
        if not self.create(path, text):
            raise FileExistsError(path)

    def stamp(self, path: str) -> tuple[int, int]:
        """(bytes, latest change) of a file or of all files of a folder."""
        if not self.exists(path):
            return 0, 0
        status = self._fs.getFileStatus(self._path(path))
        held = list(self._fs.listStatus(self._path(path))) if status.isDirectory() else [status]
        return sum(s.getLen() for s in held), max((s.getModificationTime() for s in held), default=0)

    def sizes(self, path: str) -> dict[str, int]:
        """Bytes of each file under ``path`` by its name from there, hidden ones left out."""
        files, out = self._fs.listFiles(self._path(path), True), {}
        top = len(self._fs.getFileStatus(self._path(path)).getPath().toUri().getPath())
        while files.hasNext():
            file = files.next()
            name = file.getPath().toUri().getPath()[top:].strip("/")
            if not any(x.startswith(".") or (x.startswith("_") and "=" not in x) for x in name.split("/")):
                out[name] = file.getLen()
        return out


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session makes one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/lodestone"


def bucket_count(records: int) -> int:
    low, high, each = BUCKETS
    return min(max(records // each, low), high)


def bucket(key, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _by_bucket(rows: DataFrame, key: str, buckets: int, path: str, *order: str | Column) -> DataFrame:
    """Write a lookup table and return its scan."""
    # A bucket of a much larger table is still many files: its rows are dealt by key and
    # what follows it, so that one key's rows may lie in several.
    rows = rows.withColumn("bucket", bucket(key, buckets)).repartitionByRange("bucket", key, *order).sortWithinPartitions("bucket", key, *order)
    return _stored(rows, path, "bucket")


def _held(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` from files of the shared folder, for steps that read them more than once."""
    path = f"{scratch(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _stored(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """Write a table, in folders by ``by``, and return its scan; a table without a row has no
    file to learn the columns from."""
    rows.write.partitionBy(*by).parquet(path)
    schema = StructType([f for f in rows.schema if f.name not in by] + [f for f in rows.schema if f.name in by])
    return rows.sparkSession.read.schema(schema).parquet(path)


def train_centroids(vectors: DataFrame, lists: int, *, seed: int = 4711) -> DataFrame:
    """(list_id, c): k-means over about 50,000 or 40 vectors a list, whichever is more,
    in even parts from all shards of ids.  For tens of thousands of lists build product
    codes instead: their quantiser has two levels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from lodestone.operators import ivfpq

    rows = vectors.select(F.col("vec_id").alias("id"), F.expr(f"vec_id div {SHARD_ROWS}").alias("shard"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    shards = rows.select("shard").distinct().count()
    sample = ivfpq.sample(rows, -(-max(50_000, 40 * lists) // max(shards, 1)), seed)
    model = KMeans(k=lists, seed=seed, featuresCol="f", maxIter=8).fit(sample.select(array_to_vector("embedding").alias("f")))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centers, "list_id int, c array<double>")


def range_rows(table: DataFrame, name: str) -> DataFrame:
    """(name, file, low, high): the row ids of each file of a table."""
    file = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return table.select(file.alias("file"), "row_id").groupBy("file").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high")).select(F.lit(name).alias("name"), "file", "low", "high")


def build(papers: DataFrame, vectors: DataFrame, out: str, *, records: int | None = None, centroids: DataFrame | None = None, generation: str | None = None, pq: Settings | None = None, shard_rows: int = SHARD_ROWS) -> dict:
    """Write a generation to ``out`` and return its manifest.  Refuses to overwrite one, and
    to publish anything but ``records`` rows with a vector each.  Tables that a stopped
    build left in ``out`` are written anew; with ``pq``, product codes are built by shards
    of ``shard_rows`` ids as well, and go on from the shards that are complete."""
    from lodestone.operators import ivfpq

    spark = papers.sparkSession
    files = Files(spark, out)
    if files.complete(f"{out}/manifest.json"):
        raise FileExistsError(out)
    # What dealing by ranges samples and then reads is read from files, not made twice.
    papers = _held(papers, "papers")
    n = papers.count()
    if records is not None and n != records:
        raise ValueError(f"the stage wants {records} records, not {n}")
    if papers.select("row_id").distinct().count() != n:
        raise ValueError("row_id is not unique")
    at = lambda name: f"{out}/{name}"
    for name in TABLES:
        files.delete(at(name))
    buckets = bucket_count(n)
    made: dict[str, DataFrame] = {}
    rows = made["papers"] = _stored(papers.repartitionByRange("row_id").sortWithinPartitions("row_id"), at("papers"))
    for name, each in (("titles", T.title_rows(rows)), ("prefixes", T.prefix_rows(rows))):
        made[name] = _by_bucket(each, "plain", buckets, at(name), "key", F.desc("level"), F.desc("cited_by_count"), "row_id")
        made[f"{name}_levels"] = _by_bucket(T.level_rows(made[name]), "plain", buckets, at(f"{name}_levels"), "key", F.desc("level"))
    made["postings"] = _by_bucket(_held(T.posting_rows(rows), "postings"), "word", buckets, at("postings"), "row_id")
    made["words"] = _by_bucket(made["postings"].groupBy("word").agg(F.count("*").alias("n")), "word", buckets, at("words"))
    made["work_ids"] = _by_bucket(rows.select("work_id", "row_id"), "work_id", buckets, at("work_ids"), "row_id")
    made["years"] = _stored(P.selective_years(rows).repartition("publication_year").sortWithinPartitions("row_id"), at("years"), "publication_year")
    held = vectors.join(rows.select(F.col("row_id").alias("vec_id")), "vec_id", "left_semi")
    scales = [r["scale"] for r in search.fit_scales(held).orderBy("pos").collect()]
    if pq is not None:
        # Lists are those of the product codes, of which there may be too many for folders.
        sharded = held.select(F.col("vec_id").alias("id"), F.expr(f"cast(vec_id div {shard_rows} as int)").alias("shard"), "embedding")
        ivfpq.build(sharded, at("pq"), pq)
        made["centroids"] = _stored(spark.read.parquet(at("pq/lists")).select("list_id", "c"), at("centroids"))
        lists = held.join(spark.read.parquet(at("pq/codes")).select(F.col("row_id").alias("vec_id"), "list_id"), "vec_id")
    else:
        made["centroids"] = _stored(train_centroids(held, list_count(n)) if centroids is None else centroids, at("centroids"))
        lists = search.assign(held, made["centroids"])
    code = V.quantize(F.col("embedding"), V.literal(scales))
    coded = lists.select(F.col("vec_id").alias("row_id"), "list_id", code.alias("code"))
    made["codes"] = _stored(coded.repartitionByRange("list_id", "row_id").sortWithinPartitions("list_id", "row_id"), at("codes"), *([] if pq is not None else ["list_id"]))
    made["row_codes"] = _stored(made["codes"].select("row_id", "code").repartitionByRange("row_id").sortWithinPartitions("row_id"), at("row_codes"))
    ranged = [range_rows(made[name], name) for name in ("papers", "row_codes")]
    made["ranges"] = _stored(ranged[0].unionByName(ranged[1]).coalesce(1), at("ranges"))  # a row a file
    stats = rows.agg(F.count_if("is_oa").alias("open_access"), F.max("row_id").alias("top"), F.avg(F.size(T.tokens(F.col("normalized_title")))).alias("mean_title")).first()
    counts = {t: made[t].count() for t in TABLES}  # from Parquet footers
    manifest = {
        "format_version": FORMAT_VERSION,
        "generation": generation or uuid.uuid4().hex,
        "records": n,
        "vectors": counts["codes"],
        "open_access": stats["open_access"],
        "top": stats["top"] if stats["top"] is not None else -1,
        "mean_title": stats["mean_title"] or 0.0,
        "buckets": buckets,
        "years": {str(r["publication_year"]): r["n"] for r in P.year_histogram(rows).collect()},
        "scales": scales,
        "lists": counts["centroids"],
        "pq": pq is not None,
        "rows": counts,
        "component_bytes": {t: files.size(at(t)) for t in TABLES},
        "schemas": {t: made[t].schema.jsonValue() for t in TABLES},
    }
    checksums.write(spark, out, [*TABLES, *(["pq"] if pq is not None else [])])
    files.create(at("manifest.json"), json.dumps(manifest))
    return manifest


def publish(files: Files, root: str, generation: str) -> int:
    """Make ``root/generation`` the one in use and return the pointer's number.  Pointers
    count up and are created once, so of two writers one goes behind the other, and a
    stopped one leaves the pointer before in force."""
    if not files.complete(f"{root}/{generation}/manifest.json"):
        raise ValueError(f"{generation} is not complete")
    number = max((int(x.split(".")[0]) for x in files.list(f"{root}/pointers") if x.split(".")[0].isdigit()), default=-1) + 1
    while not files.create(f"{root}/pointers/{number:012d}.json", json.dumps({"generation": generation})):
        number += 1
    return number


def current(files: Files, root: str) -> str | None:
    """The generation that the highest complete pointer names."""
    for name in reversed(files.list(f"{root}/pointers")):
        if files.complete(f"{root}/pointers/{name}"):
            return json.loads(files.read(f"{root}/pointers/{name}"))["generation"]
    return None


@dataclass(frozen=True)
class Tuning:
    """Sizes of a search; ``from_environment`` reads LODESTONE_<NAME>."""

    candidates: int = 1000
    filter_candidates: int = 2000
    nprobe: int = 192
    filter_nprobe: int = 1024
    selective: int = 10_000
    window: int = 40

    @staticmethod
    def from_environment(env: dict[str, str]) -> Tuning:
        given = {}
        for name, default in asdict(Tuning()).items():
            raw = env.get(f"LODESTONE_{name.upper()}")
            if raw is not None:
                if not raw.isdigit() or int(raw) < 1:
                    raise ValueError(f"LODESTONE_{name.upper()} must be a positive integer")
                given[name] = int(raw)
            else:
                given[name] = default
        return Tuning(**given)


@dataclass
class Index:
    """An opened generation; corrections and supplement are applied where rows are read."""

    spark: SparkSession
    path: str
    manifest: dict
    tuning: Tuning = field(default_factory=Tuning)
    patches: DataFrame | None = None
    supplement: list[dict] = field(default_factory=list)
    _tables: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        """A table of the generation; its files, which never change, are listed once."""
        if name not in self._tables:
            schema = StructType.fromJson(self.manifest["schemas"][name])
            self._tables[name] = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self._tables[name]

    @property
    def records(self) -> int:
        return self.manifest["records"]

    @cached_property
    def papers(self) -> DataFrame:
        """All papers with their corrections applied."""
        return self.corrected(self.table("papers"))

    def corrected(self, rows: DataFrame) -> DataFrame:
        if self.patches is None:
            return rows.withColumns({"overridden_fields": F.array().cast("array<string>"), "effective_citations": F.col("cited_by_count")})
        return P.corrected(rows, self.patches, small=self._few_patches)

    @cached_property
    def _few_patches(self) -> bool:
        return self.patches.limit(P.MAX_PATCHES + 1).count() <= P.MAX_PATCHES

    @cached_property
    def patched(self) -> DataFrame | None:
        """The corrected papers alone, written once to the shared folder."""
        if self.patches is None:
            return None
        if not self._few_patches:
            raise ValueError(f"more than {P.MAX_PATCHES} corrections")
        ids = self.table("work_ids").join(F.broadcast(self.patches.select("work_id")), "work_id", "left_semi").select("row_id")
        rows = self.corrected(self.table("papers").join(F.broadcast(ids), "row_id", "left_semi"))
        path = f"{scratch(self.spark)}/patched-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def _patched_keys(self) -> dict[str, set[str]] | None:
        """Keys of the corrected papers' titles, where few are corrected."""
        if self.patched is None or self.patched.count() > MAX_KEYS:
            return None
        key = X.normalize_title(F.col("title"))
        rows = self.patched.select(key.alias("key"), X.prefixes(key).alias("prefixes")).collect()
        return {"titles": {r["key"] for r in rows}, "prefixes": {p for r in rows for p in r["prefixes"]}}

    def may_be_patched(self, table: str, keys: list[str]) -> bool:
        """Whether a corrected paper may have one of the keys."""
        return bool(keys) and (self._patched_keys is None or not self._patched_keys[table].isdisjoint(keys))

    @cached_property
    def _ranges(self) -> dict[str, list]:
        """Files of the tables in ranges of row_id: a row a file."""
        out: dict[str, list] = {}
        for r in self.table("ranges").orderBy("low").collect():
            out.setdefault(r["name"], []).append((r["low"], r["high"], r["file"]))
        return out

    def probe(self, name: str, key: str, keys: list[str]) -> DataFrame:
        """Rows of a lookup table with one of ``keys``: literal buckets prune partitions,
        literal keys reach the scan."""
        if len(keys) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} keys in one lookup; split them")
        if not keys:
            return self.table(name).limit(0)
        hashed = [bucket(F.lit(k), self.manifest["buckets"]) for k in keys]
        wanted = self.spark.sql("SELECT 1").select(F.array(*hashed)).collect()[0][0]  # folded: no job
        return self.table(name).filter(F.col("bucket").isin(sorted(set(wanted)))).filter(F.col(key).isin(sorted(set(keys)))).drop("bucket")

    def probe_plain(self, name: str, keys: list[str]) -> DataFrame:
        """Rows of a title table with one of ``keys``, found by their plain forms."""
        return self.probe(name, "plain", sorted({T.plain(k) for k in keys})).filter(F.col("key").isin(sorted(set(keys))))

    def probe_many(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a title table with a key of a whole set (column ``key``), by a join: of
        any size, for batches that literals are too many for."""
        asked = keys.distinct().select("key", T.plain_column(F.col("key")).alias("plain"))
        asked = asked.withColumn("bucket", bucket(F.col("plain"), self.manifest["buckets"]))
        return self.table(name).join(asked, ["bucket", "plain", "key"], "left_semi").drop("bucket")

    def files_of(self, name: str, ids: list[int]) -> list[str]:
        """Files of a table in ranges that may hold one of the ids."""
        ids = sorted(set(ids))
        holds = lambda low, high: (at := bisect_left(ids, low)) < len(ids) and ids[at] <= high
        return [f"{self.path}/{name}/{file}" for low, high, file in self._ranges.get(name, []) if holds(low, high)]

    def rows_of(self, name: str, ids: list[int]) -> DataFrame:
        """Rows of a table in ranges; ids out of range are left out."""
        if len(ids) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} ids in one fetch; split them")
        files, schema = self.files_of(name, ids), self.table(name).schema
        if not files:
            return self.spark.createDataFrame([], schema)
        rows, asked = self.spark.read.schema(schema).parquet(*files), sorted(set(ids))
        if len(asked) <= LITERAL_KEYS:
            return rows.filter(F.col("row_id").isin(asked))
        return rows.join(F.broadcast(self.spark.createDataFrame(pd.DataFrame({"row_id": asked}))), "row_id", "left_semi")

    def fetch(self, ids: list[int]) -> DataFrame:
        """Papers of row ids, corrections applied; ids out of range are left out."""
        return self.corrected(self.rows_of("papers", ids))

    def fetch_works(self, values: list[str]) -> DataFrame:
        """Papers of work ids in any spelling, corrections applied."""
        normal = self.spark.createDataFrame([(v,) for v in values], "v string").select(X.work_id(F.col("v")).alias("w")).filter("w <> ''")
        keys = [r["w"] for r in normal.distinct().collect()]
        found = [r["row_id"] for r in self.probe("work_ids", "work_id", keys).select("row_id").collect()]
        return self.fetch(found)

    def year_ids(self, low: int | None, high: int | None) -> DataFrame | None:
        """Ordered row ids of a range of years, or None if they are too many."""
        low, years = max(1, low or 1), {int(y): n for y, n in self.manifest["years"].items()}
        wanted = [y for y in years if y >= low and (high is None or y <= high)]
        if sum(years[y] for y in wanted) > P.EXACT_ROWS:
            return None
        return self.table("years").filter(F.col("publication_year").isin(wanted)).select("row_id").orderBy("row_id")

    def all_year_ids(self, low: int | None, high: int | None) -> DataFrame:
        """The same of any number: years that are too large for the list are read from
        ``papers``."""
        few = self.year_ids(low, high)
        if few is not None:
            return few
        year = F.col("publication_year")
        rows = self.table("papers").filter(year >= max(1, low or 1))
        return (rows if high is None else rows.filter(year <= high)).select("row_id").orderBy("row_id")


def open_index(spark: SparkSession, path: str, *, verify: bool = False, **more) -> Index:
    """Open a generation after checks of its version, tables, columns and counts; with
    ``verify``, also of every file's checksum."""
    files = Files(spark, path)
    if not files.complete(f"{path}/manifest.json"):
        raise ValueError(f"{path} holds no complete generation")
    manifest = json.loads(files.read(f"{path}/manifest.json"))
    if manifest.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"{path} has format {manifest.get('format_version')!r}; this is {FORMAT_VERSION}")
    index = Index(spark, path, manifest, **more)
    if sorted(manifest["schemas"]) != sorted(TABLES):
        raise ValueError("tables are not those of this format")
    if not manifest["records"] == manifest["rows"]["papers"] == manifest["rows"]["work_ids"] or manifest["vectors"] != manifest["rows"]["codes"]:
        raise ValueError("the manifest's counts disagree")
    for name, n in manifest["rows"].items():
        if index.table(name).count() != n:  # from Parquet footers
            raise ValueError(f"{name} does not hold the {n} rows of the manifest")
    if verify:
        checksums.verify(spark, path)
    if manifest["vectors"] > manifest["records"] or any(s <= 0 for s in manifest["scales"]):
        raise ValueError("vectors do not match the papers")
    return index

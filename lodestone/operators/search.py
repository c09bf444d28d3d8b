"""Vector search: exact top-k, INT8 codes, and inverted lists.

One query's vectors are scored where they lie, and a few of each partition are kept
before anything is shuffled; a query set of any size meets them in blocks (``exact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators import exact

TRAINING_ROWS = 20_000
#: Most lists whose centroids are broadcast.
MAX_LISTS = 20_000


def topk(vectors: DataFrame, query: list[float], k: int, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine top-k of one query vector; ties to smaller ids."""
    q = V.literal(query)
    return vectors.select(vec_id, F.round(V.cosine(F.col(vector), q), 9).alias("score")).orderBy(F.desc("score"), vec_id).limit(k)


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int, *, score=V.cosine, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top-k for each row of ``queries`` (query_id, query), of which there may be any number,
    by ``V.cosine`` or ``V.dot``."""
    if score not in (V.cosine, V.dot):
        raise ValueError("score must be V.cosine or V.dot")
    found = exact.nearest(vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")), queries, k, cosine=score is V.cosine)
    kind = {f.name: f.dataType for f in [*vectors.schema, *queries.schema]}
    scored = found.select(F.col("query_id").cast(kind["query_id"]).alias("query_id"), F.col("id").cast(kind[vec_id]).alias(vec_id), F.round("score", 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), vec_id)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit_scales(vectors: DataFrame, *, quantile: float = 1.0, vector: str = "embedding") -> DataFrame:
    """(pos, scale): largest (or a quantile of) |x| by dimension, over 127."""
    if not 0.9 <= quantile <= 1:
        raise ValueError("quantile must be in [0.9, 1]")
    parts = vectors.select(F.posexplode(vector).alias("pos", "x")).select("pos", F.abs(F.col("x").cast("double")).alias("x"))
    top = F.max("x") if quantile == 1 else F.percentile("x", quantile)
    return parts.groupBy("pos").agg(top.alias("top")).select("pos", F.when(F.col("top") < V.EPSILON, F.lit(1.0)).otherwise(F.col("top") / 127).alias("scale"))


def scale_row(scales: DataFrame) -> DataFrame:
    """One row with the scales as an array (as many as dimensions: safe to broadcast)."""
    return F.broadcast(scales.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "scale"))), lambda s: s["scale"]).alias("scales")))


def encode(vectors: DataFrame, scales: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return vectors.crossJoin(scale_row(scales)).select(vec_id, V.quantize(F.col(vector), F.col("scales")).alias("code"))


def decode(codes: DataFrame, scales: DataFrame, *, vec_id: str = "vec_id") -> DataFrame:
    return codes.crossJoin(scale_row(scales)).select(vec_id, V.dequantize(F.col("code"), F.col("scales")).alias("embedding"))


def clip_rate(vectors: DataFrame, scales: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """The share of components beyond the codes' range."""
    over = F.explode(F.zip_with(F.col(vector), F.col("scales"), lambda x, s: (F.abs(x.cast("double") / s) > 127.0000001).cast("int")))
    return vectors.crossJoin(scale_row(scales)).select(over.alias("over")).agg(F.round(F.avg("over"), 9).alias("clip_rate"))


def assign(vectors: DataFrame, centroids: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, list_id): the centroid of largest inner product, ties to smaller ids.
    Centroids come as (list_id, c) and are packed into one broadcast row, so that a
    vector is assigned where it lies, without a shuffle: MAX_LISTS at most."""
    if centroids.limit(MAX_LISTS + 1).count() > MAX_LISTS:
        raise ValueError(f"more than {MAX_LISTS} lists; build product codes, whose quantiser has two levels")
    packed = F.broadcast(centroids.groupBy().agg(F.array_sort(F.collect_list(F.struct("list_id", "c"))).alias("lists")))
    best = F.array_max(F.transform("lists", lambda t: F.struct(F.round(V.dot(F.col(vector), t["c"]), 9).alias("s"), (-t["list_id"]).alias("n"))))
    return vectors.crossJoin(packed).select(vec_id, vector, (-best["n"]).cast("int").alias("list_id"))


def probe(lists: DataFrame, centroids: DataFrame, queries: DataFrame, *, nprobe: int, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top-k by inner product among each query's ``nprobe`` nearest lists.  Queries, of which
    there may be any number, meet the vectors of a list in blocks."""
    near = exact.nearest(centroids.select(F.col("list_id").alias("id"), F.col("c").alias("v")), queries, nprobe, cosine=False)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= nprobe).select("query_id", F.col("id").alias("list_id"))
    asks = near.join(queries.select(F.col("query_id").cast("long").alias("query_id"), "query"), "query_id")
    found = exact.nearest(lists.select("list_id", F.col(vec_id).alias("id"), F.col(vector).alias("v")), asks, k, cosine=False, by="list_id")
    kind = {f.name: f.dataType for f in [*lists.schema, *queries.schema]}
    scored = found.select(F.col("query_id").cast(kind["query_id"]).alias("query_id"), F.col("id").cast(kind[vec_id]).alias(vec_id), F.round("score", 9).alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), vec_id)
    return scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def recall(truth: DataFrame, found: DataFrame, k: int, *, vec_id: str = "vec_id") -> DataFrame:
    """(query_id, recall): the share of the true k that was found."""
    hits = truth.select("query_id", vec_id).join(found.select("query_id", vec_id, F.lit(1).alias("hit")), ["query_id", vec_id], "left")
    return hits.groupBy("query_id").agg(F.round(F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 6).alias("recall"))


class IvfPq:
    """Inverted lists with product quantisation, after the public papers.

    Coarse centroids and one codebook for each sub-vector of the residuals are
    k-means models over at most ``TRAINING_ROWS`` rows; assignment and encoding are
    one map stage.
    """

    def __init__(self, lists: int = 16, parts: int = 8, codes: int = 16, seed: int = 20260831):
        self.lists, self.parts, self.codes, self.seed = lists, parts, codes, seed

    def fit(self, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> IvfPq:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        sample = vectors.orderBy(F.xxhash64(F.col(vec_id), F.lit(self.seed))).limit(TRAINING_ROWS).select(F.transform(vector, lambda x: x.cast("double")).alias("v")).cache()
        fit = lambda df, k: [c.tolist() for c in KMeans(k=k, seed=self.seed, featuresCol="f", maxIter=15).fit(df.select(array_to_vector("v").alias("f"))).clusterCenters()]
        self.coarse = fit(sample, self.lists)
        rest = self._residual(sample)
        width = len(self.coarse[0]) // self.parts
        self.books = [fit(rest.select(F.slice("r", 1 + p * width, width).alias("v")), self.codes) for p in range(self.parts)]
        sample.unpersist()
        return self

    def _residual(self, df: DataFrame) -> DataFrame:
        centroids = F.array(*[F.array(*map(F.lit, c)) for c in self.coarse])
        far = F.transform(centroids, lambda c, i: F.struct(V.dot(F.zip_with("v", c, lambda a, b: a - b), F.zip_with("v", c, lambda a, b: a - b)).alias("d"), i.alias("i")))
        df = df.withColumn("list_id", F.array_min(far)["i"])
        return df.withColumn("r", F.zip_with("v", F.get(centroids, F.col("list_id")), lambda a, b: a - b))

    def encode(self, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """vec_id, list_id, pq (one code a sub-vector)."""
        df = self._residual(vectors.select(vec_id, F.transform(vector, lambda x: x.cast("double")).alias("v")))
        width = len(self.coarse[0]) // self.parts
        codes = []
        for p, book in enumerate(self.books):
            words = F.array(*[F.array(*map(F.lit, c)) for c in book])
            sub = F.slice("r", 1 + p * width, width)
            gap = lambda c, sub=sub: F.zip_with(sub, c, lambda a, b: a - b)
            codes.append(F.array_min(F.transform(words, lambda c, i: F.struct(V.dot(gap(c), gap(c)).alias("d"), i.alias("i"))))["i"].cast("smallint"))
        return df.select(vec_id, "list_id", F.array(*codes).alias("pq"))

    def search(self, encoded: DataFrame, query: list[float], *, nprobe: int, k: int, vec_id: str = "vec_id") -> DataFrame:
        """Candidates by inner product with the decoded vectors: a table of the
        query's products with each codeword, looked up by code."""
        width = len(query) // self.parts
        product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        coarse = [product(query, c) for c in self.coarse]
        probes = sorted(range(len(coarse)), key=lambda i: -coarse[i])[:nprobe]
        lut = [[product(query[p * width : (p + 1) * width], c) for c in book] for p, book in enumerate(self.books)]
        base = F.get(F.array(*map(F.lit, coarse)), F.col("list_id"))
        parts = [F.get(F.array(*map(F.lit, row)), F.col("pq")[p].cast("int")) for p, row in enumerate(lut)]
        score = sum(parts, base)
        return encoded.filter(F.col("list_id").isin(probes)).select(vec_id, F.round(score, 9).alias("score")).orderBy(F.desc("score"), vec_id).limit(k)

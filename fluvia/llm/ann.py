"""Nearest neighbours by multi-index hashing.

A bounded sample gives a mean, principal axes and a learned rotation; the signs of the rotated
coordinates are a vector's binary code. A code is split into substrings, and each is indexed: sorted
with its postings. A code within Hamming distance r = m s + a of a query's (m substrings, a < m) is within s in one of the
first a + 1 substrings or within s - 1 in one of the others, so probing every indexed substring that near retrieves every code
within r; the vectors retrieved are ranked by their distance in double precision. The radius is the
least one that finds ``RECALL`` of the true neighbours inside the sample, where neighbours are further
apart than in the whole; a query with too few codes in its radius widens it until it has enough.

Equal vectors are one entry with its smallest ids, so copies never multiply. Entries and queries meet
in a grid of shards and query blocks of bounded size, and each cell sends its best few per query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table, written

#: Learning uses at most so many vectors, and that many of them as queries.
SAMPLE = 8000
SAMPLE_QUERIES = 400
BITS = 128
SUBSTRINGS = 4
RECALL = 0.95
#: Entries of a shard and queries of a block: a cell of both is what one task holds. Every entry is sent once a block, every query once a shard.
SHARD = 65_536
BLOCK = 65_536


@dataclass
class Coder:
    mean: np.ndarray
    axes: np.ndarray  # (dimensions, bits)
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) uint32 parts of the binary codes."""
        bits = ((x - self.mean) @ self.axes > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(f"<u{BITS // SUBSTRINGS // 8}")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances (rows of a, rows of b)."""
    return sum(np.bitwise_count(a[:, i, None] ^ b[None, :, i]).astype(np.int16) for i in range(a.shape[1]))


def learn(x: np.ndarray, k: int = 10, seed: int = 1) -> Coder:
    """Axes, rotations and radius from a sample of vectors; each block of as many bits as dimensions has a rotation of its own."""
    rng, mean = np.random.default_rng(seed), x.mean(0)
    z = x - mean
    _, _, v = np.linalg.svd(z, full_matrices=False)
    v = v.T
    d, blocks = v.shape[1], []
    while sum(b.shape[1] for b in blocks) < BITS:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        p = z @ v
        for _ in range(20):  # turn towards the signs, then the signs towards the turned points
            u, _, w = np.linalg.svd(np.sign(p @ r).T @ p)
            r = (u @ w).T
        blocks.append(v @ r)
    coder = Coder(mean, np.concatenate(blocks, 1)[:, :BITS], BITS)
    q = rng.permutation(len(x))[:SAMPLE_QUERIES]
    near = (z[q] ** 2).sum(1)[:, None] + (z**2).sum(1)[None] - 2 * z[q] @ z.T
    near[np.arange(len(q)), q] = np.inf
    k = min(k, len(x) - 1)
    if k > 0:
        best = np.argpartition(near, k - 1, axis=1)[:, :k]
        c = coder.codes(x)
        h = np.sort(np.take_along_axis(distances(c[q], c), best, 1).reshape(-1))
        coder.radius = int(h[min(len(h) - 1, int(np.ceil(RECALL * len(h))) - 1)])
    return coder


class Index:
    """Multi-index over the codes of one shard."""

    def __init__(self, coder: Coder, x: np.ndarray):
        self.coder, self.x, self.codes = coder, x, coder.codes(x)
        self.parts = []
        for i in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, i], kind="stable")
            values, first = np.unique(self.codes[order, i], return_index=True)
            self.parts.append((values, np.append(first, len(order)), order))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with a substring as near to that of ``code`` as the pigeonhole principle asks for ``radius``."""
        hit, (near, spare) = np.zeros(len(self.x), bool), divmod(radius, len(self.parts))
        for i, (values, first, order) in enumerate(self.parts):
            most = near if i <= spare else near - 1
            probe = np.flatnonzero(np.bitwise_count(values ^ code[i]) <= most) if most >= 0 else np.zeros(0, int)
            sizes = first[probe + 1] - first[probe]
            if len(probe):
                at = np.repeat(first[probe] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                hit[order[at]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within ``radius`` of ``code``: all of them."""
        rows = self.probe(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int16) <= radius]

    def shares(self, queries: np.ndarray) -> tuple[float, float]:
        """Mean share of the rows that probing reaches, and that are ranked by distance, for these queries."""
        codes, r = self.coder.codes(queries), self.coder.radius
        return tuple(float(np.mean([len(f(c, r)) for c in codes])) / max(1, len(self.x)) for f in (self.probe, self.within))

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and squared distances of the ``k`` nearest found and any as near as the last."""
        radius, code, bits = self.coder.radius, self.coder.codes(q[None])[0], BITS
        rows = self.within(code, radius)
        while len(rows) < min(k, len(self.x)) and radius < bits:
            radius += 8
            rows = self.within(code, radius)
        d = ((self.x[rows] - q) ** 2).sum(1)
        if len(d) > k:
            keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            rows, d = rows[keep], d[keep]
        return rows, d


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, v) of rows whose vector has ``dimensions`` finite components, not all zero."""
    v = F.col("embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = v.isNotNull() & (F.size(v) == dimensions) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    # -0.0 and 0.0 are the same component
    return vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def search(vectors: DataFrame, is_query, k: int = 10, dimensions: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row with ``is_query``, among all other rows.

    Ties go to the smaller vec_id; score is the Euclidean distance. Vectors that are null, zero, of another length than the
    commonest or hold null or non-finite components take no part. Repeated ids count as one row each; other columns are
    ignored; an empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    if dimensions is None:
        sizes = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimensions = sizes.d if sizes else 0
    rows = usable(vectors, dimensions).withColumn("q", is_query).withColumn("h", F.xxhash64("v"))
    # of equal vectors only the k + 1 smallest ids can be among anyone's neighbours
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.select("vec_id", "v", "h").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.first("h").alias("h"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    asked = written(rows.where("q").select("vec_id", "v", "h"), "queries")
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("asker"))
    n, nq = entries.count(), queries.count()
    sample = [r.v for r in entries.orderBy("h", "entry").limit(SAMPLE).select("v").collect()]
    if not sample or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = spark.sparkContext.broadcast(learn(np.array(sample), k + 1))
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-nq // BLOCK))
    least = max(shards, min(12, -(-n // 1024)))  # small tables still use several tasks
    hashed = lambda c, m: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(m)).cast("int")
    left = entries.select(hashed("entry", least).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("entry").alias("id"), "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(least - 1))).alias("shard"), hashed("asker", blocks).alias("block"), F.col("asker").alias("id"), "v")

    def meet(entry: pa.Table, query: pa.Table) -> pa.Table:
        out: dict[str, list] = {"asker": [], "entry": [], "d2": []}
        if entry.num_rows and query.num_rows:
            matrix = lambda t: np.stack(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1))
            index, ids = Index(coder.value, matrix(entry)), entry.column("id").to_numpy()
            for asker, q in zip(query.column("id").to_pylist(), matrix(query), strict=True):
                found, d = index.nearest(q, k + 1)
                out["asker"] += [asker] * len(found)
                out["entry"] += ids[found].tolist()
                out["d2"] += d.tolist()
        return pa.table(out, schema=pa.schema([("asker", pa.int64()), ("entry", pa.int64()), ("d2", pa.float64())]))

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "asker long, entry long, d2 double")
    best = Window.partitionBy("asker").orderBy("d2")
    near = near.withColumn("r", F.rank().over(best)).where(F.col("r") <= k + 1)
    pairs = near.join(entries.select("entry", "ids"), "entry").select("asker", "d2", F.explode("ids").alias("vec_id"))
    # every row that asks for the same vector shares its answer, less itself
    everyone = asked.select(F.col("vec_id").alias("query_id"), "v").join(queries, "v").select("query_id", "asker")
    order = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    short = pairs.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("d2", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    ranked = everyone.join(short, "asker").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.sqrt("d2").alias("score"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

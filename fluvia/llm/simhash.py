"""SimHash near-duplicates by a segment-popcount grid join.

A fingerprint's 64 bits are 32 segments of two; each segment's bit count (0, 1 or 2) is one
coordinate. The Manhattan distance of two such points is at most the Hamming distance of their
fingerprints, so points further apart than ``bits`` can be dropped unseen. Written in unary (00, 01,
11) the point is again a 64-bit word, and the Manhattan distance is the bit count of an exclusive or.

Grid: the coordinates are cut into b blocks. Points within Manhattan distance 3 differ in at most three
blocks, so they agree in all coordinates of some b - 3 of them: each such choice of blocks is a grid, its
coordinates there are a point's cell, and points meet where they share a cell. The join keeps pairs within the
Manhattan bound and then checks the fingerprints themselves. b grows with the number of different
fingerprints (``blocks_for``), so that a cell holds a few of them whatever their number.

Copies cost nothing here: the join sees each different fingerprint once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, map_arrow, table, written

SEED = 42
SHINGLE = 3
BITS = 3
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOW_BITS = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash over 3-word shingles; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp) for every row; version is a hash of the text; null texts are empty."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "version": cols["version"], "fp": [fingerprint(t) for t in cols["text"]]}

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("version")), make, "doc_id long, version long, fp long")


def _unary(fp: str) -> str:
    up = f"shiftrightunsigned({fp}, 1)"
    return f"(shiftleft(({fp} & {up}) & {_LOW_BITS}L, 1) | (({fp} | {up}) & {_LOW_BITS}L))"


def blocks_for(n: int, most: float = 8.0) -> int:
    """The least number of blocks (5 at least) with which a cell holds at most ``most`` of ``n`` random points on average.

    A coordinate of two random bits (1/4, 1/2, 1/4) agrees with another's with probability 3/8.
    """
    blocks = 5
    while n * 0.375 ** (32 * (blocks - BITS) / blocks) > most and blocks < 32:
        blocks += 1
    return blocks


def near_links(classes: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp, distinct) at 3 or fewer differing bits; n is their number, counted if not given."""
    blocks = blocks_for(classes.count() if n is None else n)
    of = [i * blocks // 32 for i in range(32)]  # the block of each coordinate
    masks = [sum(3 << 2 * i for i in range(32) if of[i] not in left_out) for left_out in combinations(range(blocks), BITS)]
    grids = F.array(*(F.lit(m - (m >> 63 << 64)) for m in masks))
    point = F.expr(_unary("fp"))
    cells = classes.select("fp", F.posexplode(F.transform(grids, lambda m: m.bitwiseAND(point))).alias("grid", "cell"))
    x, y = cells.alias("x"), cells.alias("y")
    bound = f"bit_count({_unary('x.fp')} ^ {_unary('y.fp')}) <= {BITS} AND bit_count(x.fp ^ y.fp) <= {BITS}"
    met = x.join(y, F.expr(f"x.grid = y.grid AND x.cell = y.cell AND x.fp < y.fp AND {bound}"))
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _marks(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of ``edges`` (a, b).

    Alternating large-star and small-star steps; every round is a written table, so a lost executor costs one reread.
    """
    edges = written(edges, "links")
    marks = _marks(edges)
    while marks[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.explode(F.expr("array(struct(a AS a, m AS b), struct(b AS a, m AS b))")).alias("e")).select("e.*").where("a <> b").distinct()
        last, edges = edges, written(star, "links")
        discard(last)
        before, marks = marks, _marks(edges)
        if marks == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp, root, component_id), one row per input row; component_id is the smallest doc_id reachable by links of 3 bits or fewer.

    root, the smallest fingerprint of the component, names it even where two of them share their smallest doc_id (one id with several
    texts); version is a hash of the text. Null and empty texts have fingerprint 0 and link like any other. A null doc_id
    never becomes a component_id. Repeated rows come back each. Other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "classes")
    roots = components(near_links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = written(rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "version", "fp", "root", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

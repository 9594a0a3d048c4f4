"""Phrase collocations by hierarchical pair naming.

Documents of one language are gathered into blocks of bounded size, whose words become local numbers. A level names what
the one before left: adjacent frequent (k-1)-grams that overlap in all but their ends are a pair, a block counts its
different pairs, and one shuffle by the pair adds the counts of all blocks and gives each frequent pair a global id, which
goes back to the blocks that hold it. So texts are cut once, only different pairs of a block are ever shuffled, and a hot
pair costs one row a block. A pair's two ids are its parent pointers: they lead to the counts of all its beginnings and
ends (the cuts), and back from a longer phrase to the two it holds (subsumption; counts never grow with length, so one
level up is enough to look).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import discard, table, written

#: A block holds texts of so many bytes at most, or one longer text.
BLOCK_BYTES = 32_000_000
#: A word or pair of a block is known by the partition (21 bits), the block in it and the local number.
BLOCK_BITS, IDX_BITS = 16, 26
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _BREAKS, bytes(range(97, 123)) + b" " + b"\n" * len(_BREAKS))


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, words, counts): a local number for each word in order of place, -1 between pieces, and the different words."""
    data = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([data], pa.large_binary()), pattern=" ").flatten().dictionary_encode()
    words, codes = tokens.dictionary, tokens.indices.to_numpy()
    none, gap = (pc.index(words, pa.scalar(x, words.type)).as_py() for x in (b"", b"\n"))
    codes = codes[codes != none] if none >= 0 else codes
    if gap >= 0:
        codes = np.where(codes == gap, -1, codes)
    counts = np.bincount(codes[codes >= 0], minlength=len(words))
    kept = np.flatnonzero(counts)
    kept = kept[np.argsort(-counts[kept], kind="stable")]  # small numbers for frequent words
    renamed = np.full(len(words) + 1, -1, np.int32)
    renamed[kept] = np.arange(len(kept), dtype=np.int32)
    return renamed[codes], words.take(pa.array(kept)), counts[kept]


def numbered_pairs(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, left, right, counts): a local number for each pair of neighbours with ids (-1: none), at the left one's place."""
    ended = np.append(codes, np.int32(-1))
    ended[:-1][ids[codes] < 0] = -1
    at = np.flatnonzero((ended[:-1] >= 0) & (ended[1:] >= 0))
    keys = ended[at].astype(np.int64) << 32 | ended[at + 1]
    pairs, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    out = np.full(len(codes), -1, np.int32)
    out[at] = where
    return out, ids[pairs >> 32], ids[pairs & 0xFFFFFFFF], counts


def _row(values) -> pa.Array:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.int64())
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def word_blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, codes, words, counts) of blocks of documents of one language."""
    schema = "block long, lang string, codes binary, words array<string>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        block = TaskContext.get().partitionId() << BLOCK_BITS

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal block
            codes, words, counts = numbered_words(held.pop(lang))
            sizes.pop(lang)
            block += 1
            if block >> BLOCK_BITS != block - 1 >> BLOCK_BITS or len(words) >> IDX_BITS or block >> BLOCK_BITS + 21:
                raise ValueError("a partition has too many blocks or languages, or a block too many words: use more, smaller partitions")
            columns = [pa.array([block - 1]), pa.array([lang]), pa.array([codes.tobytes()]), _row(words.cast(pa.string())), _row(counts)]
            return pa.RecordBatch.from_arrays(columns, ["block", "lang", "codes", "words", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, text in zip(*(batch.column(n).slice(at, 256).to_pylist() for n in ("lang", "text")), strict=True):
                    data = text.encode("utf-8", "replace")
                    if sizes.get(lang, 0) + len(data) > BLOCK_BYTES and lang in held:
                        yield flush(lang)
                    held.setdefault(lang, []).append(data)
                    sizes[lang] = sizes.get(lang, 0) + len(data)
                    if sum(sizes.values()) > 2 * BLOCK_BYTES:
                        yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def pair_blocks(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """(block, codes, left, right, counts): the pairs of each block's neighbours that have names (uid, id)."""
    schema = "block long, codes binary, left array<long>, right array<long>, counts array<long>"

    def run(block: pa.Table, named: pa.Table) -> pa.Table:
        if not block.num_rows or not named.num_rows:
            return empty
        codes = np.frombuffer(block.column("codes")[0].as_py(), np.int32)
        ids = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)  # the last is for places without a number
        ids[named.column("idx").to_numpy()] = named.column("id").to_numpy()
        out, left, right, counts = numbered_pairs(codes, ids)
        columns = [block.column("block").combine_chunks(), pa.array([out.tobytes()]), _row(left), _row(right), _row(counts)]
        return pa.table(columns, ["block", "codes", "left", "right", "counts"])

    empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)], ["block", "codes", "left", "right", "counts"])
    theirs = names.select(F.shiftright("uid", IDX_BITS).alias("block"), F.col("uid").bitwiseAND((1 << IDX_BITS) - 1).alias("idx"), "id")
    return blocks.select("block", "codes").groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(run, schema)


def named(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(uid, id, f, *keys): the global count and id of keys that occur ``least`` times; uid is block and local number.

    A key's id is its least uid. Each block counts a key once, so a window holds at most as many rows as there are blocks.
    """
    w = Window.partitionBy(*keys)
    return counted.withColumns({"f": F.sum("n").over(w), "id": F.min("uid").over(w)}).where(F.col("f") >= least).select("uid", "id", "f", *keys)


def _counted(blocks: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """(uid, n, *more, *columns): a row for each block's different words or pairs."""
    rows = blocks.select("block", *more, F.posexplode(F.arrays_zip(*columns, "counts")).alias("idx", "x"))
    return rows.select((F.shiftleft("block", IDX_BITS) + F.col("idx")).alias("uid"), F.col("x.counts").alias("n"), *more, *(F.col("x")[c].alias(c) for c in columns))


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(l) + wide(r))


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80) -> DataFrame:
    """All phrases that stay: lang, phrase, a, l, r, n, score, with the cut that scores lowest.

    Null texts are empty and have no words, null languages are ``und``; repeated rows count each; other columns are
    ignored; an empty table gives no rows. A phrase with ``share`` percent of its occurrences inside one longer phrase
    of at most ``longest`` words goes.
    """
    blocks = written(word_blocks(docs), "words")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = written(blocks.groupBy("lang").agg(F.sum(total).alias("n")), "totals")
    names = written(named(_counted(blocks, ["words"], "lang"), ["lang", "words"], least), "names1")
    own = F.col("id") == F.col("uid")
    level = written(names.where(own).select("id", "lang", F.col("words").alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails")), "phrases1")
    whole = []
    for k in range(2, longest + 1):
        pairs = written(pair_blocks(blocks, names), f"pairs{k}")
        discard(blocks)
        discard(names)
        blocks, names = pairs, written(named(_counted(pairs, ["left", "right"]), ["left", "right"], least), f"names{k}")
        left = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), "heads")
        right = level.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("word"), "tails")
        joined = names.where(own).select("id", "left", "right", "f").join(left, "left").join(right, "right")
        grown = {"phrase": F.concat_ws(" ", "first", "word"), "heads": F.concat("heads", F.array("f")), "tails": F.concat("tails", F.array("f"))}
        longer = written(joined.withColumns(grown).drop("first", "word"), f"phrases{k}")
        if k > 2:  # single words are no candidates
            whole.append(_whole(level, longer, share))
        level = longer
    discard(blocks)
    discard(names)
    found = level.select(*_KEPT)
    for part in whole:
        found = found.unionByName(part)
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("heads") - 1),
        lambda j: F.struct(_score(F.col("f"), F.col("heads")[j - 1], F.col("tails")[F.size("heads") - j - 1]).alias("score"), j.alias("k"), F.col("heads")[j - 1].alias("l"), F.col("tails")[F.size("heads") - j - 1].alias("r")),
    )
    scored = found.withColumn("cut", F.array_min(cuts)).join(totals, "lang")
    return scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


_KEPT = ("lang", "phrase", "f", "heads", "tails")


def _whole(level: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Phrases without ``share`` percent of their occurrences inside a phrase that is one word longer."""
    around = longer.select(F.col("left").alias("id"), F.col("f").alias("g")).unionByName(longer.select(F.col("right").alias("id"), F.col("f").alias("g"))).groupBy("id").agg(F.max("g").alias("g"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    inside = wide("g") * F.lit(100).cast("decimal(3,0)") >= wide("f") * F.lit(share).cast("decimal(3,0)")
    return level.join(around, "id", "left").where(~F.coalesce(inside, F.lit(False))).select(*_KEPT)


def best(found: DataFrame, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and phrase; the best of 256 parts of a language are ranked first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    near = found.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(phrases(table(spark, sf_dir, "documents")))


#: The same in DuckDB's SQL: every phrase of every piece, counted.
SQL = """WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz '), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM places, unnest([1, 2, 3, 4]) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY 1),
cuts AS (SELECT lang, k, p, a, string_split(p, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1),
scored AS (
    SELECT c.lang, c.k, c.p, c.a, c.j, l.a AS l, r.a AS r, (CAST(c.a AS HUGEINT) * 2000000) // (l.a + r.a) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:c.j], ' ') JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
parts AS (SELECT lang, k, a, w, unnest(range(1, k)) AS i FROM cuts WHERE j = 1 AND k > 2),
inside AS (SELECT q.lang, array_to_string(q.w[q.i:q.i + m - 1], ' ') AS p, max(q.a) AS g FROM parts q, unnest([2, 3]) AS t(m) WHERE m < q.k AND q.i + m - 1 <= q.k GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i USING (lang, p) WHERE i.g IS NULL OR CAST(i.g AS HUGEINT) * 100 < CAST(s.a AS HUGEINT) * 80)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""

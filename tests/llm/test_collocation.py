"""Collocations against counting every phrase, and against DuckDB."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fluvia.llm import collocation

SF = "/root/testdata/sf0.001"


def slow(rows, least=30, longest=4, share=80, top=2000):
    grams, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                grams[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in grams.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], a)
        rows = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * around[p] < share * a:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def check(df, top=2000, **settings):
    got = sorted(tuple(r) for r in collocation.best(collocation.phrases(df, **settings), top).collect())
    assert got == slow([(r.lang, r.text) for r in df.collect()], top=top, **settings)
    return got


def test_random_texts(spark):
    r = np.random.default_rng(5)
    words = ["a", "B", "c", "É", "d-d", "the", "'s", "\x00", "x　y", "of", "of"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", "\r", "\x0b", "?"]
    texts = ["".join(words[r.integers(len(words))] + ends[r.integers(len(ends))] for _ in range(r.integers(200))) for _ in range(60)] + [None, "", " \t.", "a"]
    df = spark.createDataFrame([((None, "en", "und", "fr")[i % 4], t, i) for i, t in enumerate(texts)], "lang string, text string, n long").repartition(5)
    for settings in ({"least": 3}, {"least": 9, "top": 7}, {"least": 2, "longest": 2}, {"least": 4, "longest": 3, "share": 55}, {"least": 10_000}):
        check(df, **settings)


def test_odd_rows_and_small_blocks(spark, odd, monkeypatch):
    rows = odd.union(odd)
    assert check(rows, least=2)
    assert collocation.best(collocation.phrases(odd.limit(0))).count() == 0
    # blocks are bounded by bytes, counts don't depend on them
    blocks = collocation.word_blocks(rows.coalesce(1)).count()
    assert blocks == 5  # a language each, and und


def test_ties_of_cuts_and_of_ranks(spark):
    df = spark.createDataFrame([("en", ". ".join(["p q r"] * 30 + ["q p"] * 30 + ["z y"] * 30))], "lang string, text string")
    got = check(df)
    assert [(r[2], r[3], r[4], r[5]) for r in got] == [("z y", 30, 30, 30), ("p q r", 30, 60, 30), ("q p", 30, 60, 60)]


def test_scores_pass_64_bits(spark):
    rows = spark.createDataFrame([(9 * 10**17, 9 * 10**17, 9 * 10**17), (9 * 10**17 - 1, 9 * 10**17, 9 * 10**17 + 7), (10**12, 3 * 10**18, 5 * 10**18)], "a long, l long, r long")
    from pyspark.sql import functions as F

    for r in rows.withColumn("s", collocation._score(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert r.s == 2_000_000 * r.a // (r.l + r.r)


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(tuple(r) for r in collocation.op13_collocations(spark, SF).collect())
    assert got == sorted(con.execute(collocation.SQL).fetchall())
    assert got == slow([(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


@pytest.mark.parametrize("texts", [[], [b""], [b"."], [b"a"], [b"a b", b"c"]])
def test_small_blocks(texts):
    codes, words, counts = collocation.numbered_words(texts)
    assert counts.sum() == (codes >= 0).sum() == sum(len(re.findall(rb"[a-z]", t)) for t in texts)
    ids = np.append(np.arange(len(words)), -1)
    out, left, right, n = collocation.numbered_pairs(codes, ids)
    assert len(out) == len(codes) and n.sum() == sum(max(0, len(t.split()) - 1) for t in texts)

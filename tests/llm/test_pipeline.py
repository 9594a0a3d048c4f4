"""Stages of the pipeline against brute force on small tables."""

import corpus_pipeline
from fluvia.llm import pii, simhash, toxicity

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_and_do_their_work(spark, docs):
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        kept, had = {r.doc_id: r for r in after.collect()}, {r.doc_id: r for r in before.collect()}
        assert kept.keys() <= had.keys()
        if name == "personal_data":
            assert kept.keys() == had.keys() and all(not pii.base_spans(r.text) or "[" in r.text for r in kept.values())
            assert all(r.n_chars == len(r.text) for r in kept.values())
        elif name == "near_duplicates":
            groups = {}
            for r in simhash.near_duplicates(before).collect():
                groups.setdefault(r.component_id, []).append(r.doc_id)
            assert sorted(kept) == sorted(min(g) for g in groups.values())
        elif name == "toxicity":
            from fluvia.llm.base import fold

            model = toxicity.fit(toxicity.labelled_sample(before, spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 5) == 0))
            want = toxicity.score_documents(before, model).where("score < 0.5")
            assert sorted(kept) == ids(want)
        elif name == "language":
            assert len(kept) > 0.95 * len(had)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in before.collect()}


def test_odd_rows(spark, odd):
    first = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, first, SF)
        assert out.columns == odd.columns
        first = spark.createDataFrame(out.collect(), odd.schema)
    left = [r.doc_id for r in first.collect()]
    assert 6 not in left and left.count(5) == 1 and not {2, 3, 4} & set(left)
    empty = spark.createDataFrame([], odd.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_no_text_is_lost_for_a_shared_id(spark, odd):
    rows = [(1, "alpha beta gamma delta", "a"), (1, "completely other words are here now", "a"), (2, "alpha beta gamma delta", "b"), (1, "alpha beta gamma delta", "a"), (None, "alpha beta gamma delta", "c"), (None, "alpha beta gamma delta", "c")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == [(0, "alpha beta gamma delta")] * 2 + [(1, "alpha beta gamma delta"), (1, "completely other words are here now")]


def test_run_leaves_only_what_its_rows_need(spark):
    import os

    from fluvia.llm import base

    folder = base.shared_dir(spark).removeprefix("file://") + "/fluvia"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"personal_data", "tokens"}


def test_clashing_names_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", "x", 5), (2, "alpha beta gamma delta", "y", 6), (3, "other words are here", "z", None)], "doc_id long, text string, __near_version string, __near_id int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(kept.collect()) == [(1, "alpha beta gamma delta", "x", 5), (3, "other words are here", "z", None)]

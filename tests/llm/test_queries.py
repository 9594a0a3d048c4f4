"""Every registered query gives its contract's columns, by name, type and order, and one row per document, page or piece."""

import os

import pytest

from fluvia.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_telephony": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_html": "page_id bigint, url string, text string, n_chars bigint",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_dialogue": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_pieces": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


def test_all_are_registered():
    assert queries.queries().keys() == COLUMNS.keys()


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    out = queries.queries()[name](spark, SF)
    want = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert out.dtypes[: len(want)] == want
    rows = out.collect()
    table = {"op8_html": "pages", "op2_ann": "embeddings", "op11_dialogue": "conversations"}.get(name, "documents")
    read = spark.read.parquet(os.path.join(SF, f"{table}.parquet"))
    n = read.select("conv_id").distinct().count() if table == "conversations" else read.count()
    if name == "op2_ann":
        assert sorted((r.query_id, r["rank"]) for r in rows) == sorted({(r.query_id, k) for r in rows for k in range(1, 11)})
        assert all(r.query_id % 100 == 0 and r.vec_id != r.query_id for r in rows)
    elif name == "op13_collocations":
        assert sorted((r.lang, r["rank"]) for r in rows) == sorted((x, k) for x in {r.lang for r in rows} for k in range(1, sum(r.lang == x for r in rows) + 1))
    elif name == "op10_packing":
        assert len({r.doc_id for r in rows}) == n
    else:
        assert len(rows) == n
    if name == "op1_simhash":
        assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 and r.fingerprint == r.fingerprint.lower() for r in rows)
    if "held_out" in out.columns:
        import zlib

        parts, rest = (5, 0) if name == "op3_toxicity" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 for r in rows)
    if name == "op3_toxicity":
        assert all(r.predicted == (r.score >= 0.5) for r in rows)

"""The sentencepiece model against the tiktoken library with the same ranks."""

import base64
import hashlib
import sys
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fluvia.llm import pieces

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    return library(request.param), pieces.PieceEncoder(request.param, public_tokenizers.PATTERN)


def check(both, texts):
    want, own = both
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert array("I", ids).tolist() == want.encode_ordinary(text), repr(text[:80])
        assert own.decode(ids) == text.encode()


def test_every_entry_encodes_to_itself(both):
    _, own = both
    shown = ["".join(map(pieces._SHOWN.__getitem__, e)) for e in own.entries]
    assert own.library.encode(shown, out_type=int, num_threads=1) == [[i] for i in range(len(shown))]


def test_every_character(both):
    points = [chr(i) for i in (*range(0x3400), *range(0x3400, sys.maxunicode + 1, 11)) if not 0xD800 <= i <= 0xDFFF]
    for form in (" {0} {0}", "1{0}{0}'s.{0}", "\n{0}  {0}x"):
        check(both, ["|".join(form.format(c) for c in points[at : at + 400]) for at in range(0, len(points), 400)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", "'s", "'ll", "don't", "word", "99", "\t", "\x1c", "\xa0", "▁", "Ġ", "<unk>", "<|endoftext|>", "é", "é", "🙂"])), max_size=30))
def test_random_texts(parts):
    for path in PATHS[:1]:
        both = _kept.get(path) or _kept.update({path: (library(path), pieces.PieceEncoder(path, public_tokenizers.PATTERN))}) or _kept[path]
        check(both, ["".join(parts)])


_kept: dict = {}


def test_documents_and_odd_rows(spark, odd, docs):
    want = library(PATHS[0])
    for df in (odd, docs):
        texts = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()))
        got = sorted(pieces.encode_decode(df).collect(), key=lambda r: r.doc_id)
        assert len(got) == len(texts)
        for (doc, text), r in zip(texts, got, strict=True):
            ids = want.encode_ordinary(text) if len(text) < 40_000 else array("I", _kept_encoder().encode([text])[0]).tolist()
            assert (r.doc_id, r.n_tokens, r.ids, bytes(r.decoded)) == (doc, len(ids), ids, text.encode())
            assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert pieces.encode_decode(odd.limit(0)).count() == 0


def _kept_encoder():
    return _kept.get("encoder") or _kept.update(encoder=pieces.PieceEncoder(PATHS[0], public_tokenizers.PATTERN)) or _kept["encoder"]


def test_caches_may_be_dropped(both, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHARS", 20)
    for _ in range(3):
        check(both, ["one two three", "three two one", "word " * 50 + "x" * 200])


def test_broken_ranks_are_refused(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        pieces.ranks(str(tmp_path / "ranks"))

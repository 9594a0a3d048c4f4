"""Vocabulary bytes of byte-level BPE tokenizers, and a direct merge of single pre-tokens.

Merging the adjacent pair of lowest rank gives the tokenizers library's ids for one pre-token as long
as every vocabulary entry encodes to itself (then a pair of pieces can only ever be joined by the
entry's own merge); ``tests/llm`` verify that for the two vocabularies used.
"""

from __future__ import annotations

from collections.abc import Callable

#: Code points of the byte-level alphabet (fixed values of the format): printable bytes stand for themselves.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def token_bytes(tokenizer) -> list[bytes]:
    """Bytes of each id; an end-of-word mark becomes byte 0, special tokens their text."""
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    mark = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        if token in special:
            out[i] = token.encode()
        elif mark and token.endswith(mark):
            out[i] = bytes(BYTE_OF[c] for c in token.removesuffix(mark)) + b"\0"
        else:
            out[i] = bytes(BYTE_OF[c] for c in token)
    return out


def merger(tokenizer) -> Callable[[str], list[int]]:
    """Ids of one pre-token; where the vocabulary marks word ends, the caller appends chr(0)."""
    import tiktoken

    special = {*tokenizer.get_added_tokens_decoder()}
    ranks = {b: i for i, b in enumerate(token_bytes(tokenizer)) if i not in special}
    return tiktoken.Encoding("merges", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

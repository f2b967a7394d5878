import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zonetide.llm import bpe
from zonetide.llm.splitting import splitter, word_ids

WORD, BYTE = (bpe.read_file(public_tokenizers.path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def _library(file, text):
    return Tokenizer.from_str(file).encode(text or "", add_special_tokens=False).ids


def test_ids_and_decoded_text_equal_the_library(documents, texts):
    tok = Tokenizer.from_str(WORD)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.encode_decode(documents, WORD).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        ids = _library(WORD, t)
        assert got[d] == (ids, tok.decode(ids, skip_special_tokens=False)), t


def test_counts_equal_the_library(documents, texts):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in bpe.token_counts(documents, BYTE).collect()}
    assert got == {d: (len((t or "").encode()), len(_library(BYTE, t))) for d, t in texts}


@pytest.mark.parametrize("file", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("aB'sté 1½\n\t\x1c\x85\xa0<|>ſΣ"), st.characters(codec="utf-8")), max_size=40))
def test_split_and_encode_equal_the_library(file, text):
    assert [i for w in splitter(file)(text) for i in word_ids(file)(w)] == _library(file, text)


def test_round_trip_through_the_piece_join(spark, few):
    rows = [(1, "the cat sat"), (2, None), (3, "<|endoftext|> déjà")]
    ids = {d: _library(WORD, t) for d, t in rows}
    table = spark.createDataFrame([(d, i) for d, i in ids.items()], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(table, bpe.pieces(spark, WORD)).collect()}
    assert got == {r.doc_id: r.decoded for r in bpe.encode_decode(few(rows), WORD).collect()}


def test_repeated_rows_and_empty_table(few, nothing):
    assert [tuple(r) for r in bpe.token_counts(few([(1, "a b"), (1, "a b")]), BYTE).collect()] == [(1, 3, 2)] * 2
    assert bpe.encode_decode(nothing, WORD).count() == bpe.token_counts(nothing, BYTE).count() == 0

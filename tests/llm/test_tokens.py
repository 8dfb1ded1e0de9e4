import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_pack_round_trip(values):
    control, data = tokens.pack(np.array(values, np.uint32))
    assert tokens.unpack(control, data, len(values)).tolist() == values


def test_pieces_equal_the_whole_text():
    plain = Tokenizer.from_file(PATH)
    texts = ["The end. It's, it's. A,b.c", "  Ünïcode É.́, x y.  <|endoftext|>, <|ENDOFTEXT|>. 'S. 12.5, ...", "", "\x0b\x1c a b Σας ΣΑΣ. İI KK. .,", "we'll. don't, é. ﬁ. 한글. 漢字, ½. á."]
    got = tokens.Encoder(PATH).batch([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'sStTreE<|>endoftxENDKİΣ́é½5"), st.characters(exclude_categories=["Cs"]))))
def test_pieces_equal_any_text(text):
    plain = Tokenizer.from_file(PATH)
    got = tokens.Encoder(PATH).batch([text.encode()])[0]
    assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_files_round_trip(spark):
    rows = [(5, "b b a."), (1, None), (None, "null id"), (9, ""), (5, "b b a."), (5, "other"), (3, "word, " * 5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    folder, files = tokens.write(docs, PATH)
    got = tokens.read(spark, folder, files).collect()
    plain = Tokenizer.from_file(PATH)
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((repr(i), ids(t)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 3, 5, 5, 5, 9]


def test_empty(spark):
    folder, files = tokens.write(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert files == [] and tokens.read(spark, folder, files).collect() == []


def test_query_against_the_library(spark):
    from roadloom.llm.queries import op5_token_ids

    sf = "/root/testdata/sf0.001"
    plain, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in op5_token_ids(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


if __name__ == "__main__":
    pytest.main([__file__])

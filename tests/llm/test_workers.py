"""The check of round 2: operator 5 learns words of Latin-1 letters by the model alone, and the pipeline's workers and driver give memory back."""

from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadloom.llm import common, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LATIN = "".join(chr(c) for c in range(0xC0, 0x100))


@cache
def both():
    return tokens.Encoder(PATH), Tokenizer.from_file(PATH)


def test_latin_words_do_without_the_whole_tokenizer(monkeypatch):
    encoder, plain = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr(encoder, "_words", None)
    monkeypatch.setattr(encoder, "_encode", None)
    text = "Straße, ÉTÉ. übÿr5 ýþ### word,%%% (çà) " + LATIN.replace("×", " ").replace("÷", " ")
    assert np.frombuffer(encoder.batch([text.encode()])[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(LATIN + "aZsS15 .,#'<|>́")))
def test_latin_texts_equal_the_library(text):
    encoder, plain = both()
    assert np.frombuffer(encoder.batch([text.encode()])[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_worker_keeps_the_first_pieces_only():
    encoder = tokens.Encoder(PATH)
    encoder.batch([b"the end of the story"])
    encoder.forget(2)
    assert len(encoder.known) == 2 and not encoder.former


def test_memory_goes_back_after_a_task():
    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    pins = []

    def run(batches):
        for batch in batches:
            held = [bytes(2000) for _ in range(100_000)]
            pins.append(held[-1])  # keeps the heap's end in use, so that only a trim gives back what is below
            yield batch

    common.give_back()
    before = rss()
    assert list(common.tidied(run)([1])) == [1]
    assert rss() - before < 60_000_000


def test_the_driver_gives_memory_back_with_each_table(spark):
    jvm = spark._jvm
    rss = lambda: int(open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm").read().split()[1]) * 4096
    table = spark.range(1).toDF("n")
    common.stored(table, "first")
    before = rss()
    held = [jvm.java.util.zip.Deflater() for _ in range(2000)]  # memory outside the JVM's heap
    assert (most := rss()) - before > 120_000_000
    for x in held[:-1]:  # the last one keeps the heap's end in use
        x.end()
    common.stored(table, "second")
    assert most - rss() > 80_000_000


def test_each_stage_of_the_pipeline_begins_with_memory_given_back(monkeypatch):
    import corpus_pipeline

    seen = []
    monkeypatch.setattr(common, "settle", seen.append)
    for _, stage in corpus_pipeline.STAGES:
        try:
            stage("spark", None, "")
        except (AttributeError, AssertionError):  # there are no documents
            pass
    assert seen == ["spark"] * len(corpus_pipeline.STAGES)

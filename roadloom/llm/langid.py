"""Language identification: known words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language.  An unseen word backs off to its longest character n-grams that
are known, from ``longest`` characters down to one, and adds the mean of their log frequencies; a word of which
nothing is known adds nothing.  The language with the largest sum is predicted (ties: the smallest name) and the
score is its share after a softmax over the sums.

Words are maximal runs of letters after lower-casing.  The model is fitted on a bounded sample of labelled rows: about
``sample_docs`` distinct texts of each language, chosen by a hash of the text, so that copies count once whatever their
ids.  All languages and all words of the sample are learnt; words and n-grams of two or more letters count from ``least``
occurrences on.  Counting runs on the cluster; the driver and the executors hold sorted 64-bit hashes of words and n-grams with
their log frequencies, of the sample only; what is broadcast before is one row a language, which the model holds anyway.  Prediction reads whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows with a null language are no
training rows; with no training rows at all every text is ``und``; a text with a letter has a learnt language, whatever
stands beside the letter; repeated rows and ids are judged each by themselves; an empty table gives no rows.  Only the
id, text and language columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, stored, tidied

LETTERS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
BORDER = "_"


def words_in(text: str | None) -> list[str]:
    """Maximal runs of letters; numbers such as superscripts end a run too."""
    found = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def word_keys(words: list[str]) -> np.ndarray:
    """A hash of each whole word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def gram_keys(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each n-gram of the words with their borders (single letters: without), and the word it belongs to."""
    padded = "".join(f"{BORDER}{w}{BORDER}" for w in words)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    skip = 1 if n == 1 else 0
    counts = np.maximum(sizes - 2 * skip - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), counts)
    begin = (ends - sizes + skip)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    acc = np.full(len(begin), np.uint64(n))
    for k in range(n):
        acc = (acc + points[begin + k]) * _P
    return mix64(acc), owner


class Model:
    """Log frequencies of words (table 0) and n-grams (table n) in each language, by sorted hashes."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    @property
    def longest(self) -> int:
        return len(self.tables) - 1

    def look(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the keys are known, and the rows of those that are."""
        known, rows = self.tables[table]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros((0, len(self.langs)))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, rows[at[hit]]

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        hit, rows = self.look(0, word_keys(words))
        out[hit] = rows
        unseen = np.flatnonzero(~hit)
        for n in range(self.longest, 0, -1):
            if not len(unseen):
                break
            keys, owner = gram_keys([words[i] for i in unseen], n)
            hit, rows = self.look(n, keys)
            of = owner[hit]
            if not len(of):
                continue
            counts = np.bincount(of, minlength=len(unseen))
            some = np.flatnonzero(counts)
            starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            out[unseen[some]] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64) / counts[some, None]
            unseen = unseen[counts == 0]
        return out

    def scorer(self, most: int = 200_000):
        """A function from texts to their (language, score), with a bounded memory of words."""
        place: dict[str, int] = {}
        matrix = np.zeros((4096, len(self.langs)), np.float32)

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal matrix
            docs = [words_in(t) for t in texts]
            if len(place) > most:
                place.clear()
            fresh = [*(set().union(*docs) - place.keys())]
            if fresh and self.langs:
                begin, now = len(place), len(place) + len(fresh)
                if now > len(matrix):
                    matrix = np.concatenate([matrix[:begin], np.zeros((2 * now - begin, len(self.langs)), np.float32)])
                for at in range(0, len(fresh), 8192):
                    some = fresh[at : at + 8192]
                    matrix[begin + at : begin + at + len(some)] = self.of_words(some)
                place.update(zip(fresh, range(begin, now), strict=True))
            out = []
            for words in docs:
                if not words or not self.langs:
                    out.append(("und", 0.0))
                    continue
                ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                total = sum(matrix[ids[at : at + 16384]].sum(axis=0, dtype=np.float64) for at in range(0, len(ids), 16384))
                best = int(np.argmax(total))
                out.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
            return out

        return score


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of the sample's texts."""

    def run(batches):
        for batch in slices(batches, 2000):
            lang, word = [], []
            for text, of in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                found = words_in(text)
                word += found
                lang += [of] * len(found)
            table = pa.table({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string())}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from table.rename_columns({"count_all": "n"}).select(["lang", "word", "n"]).combine_chunks().to_batches()

    return sample.select("text", "lang").mapInArrow(tidied(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _grams(counts: DataFrame, longest: int) -> DataFrame:
    """(size, key, lang, n) of all words (size 0) and n-grams."""

    def run(batches):
        for batch in slices(batches, 8192):
            words, langs = batch["word"].to_pylist(), batch["lang"]
            n = batch["n"].to_numpy()
            yield pa.RecordBatch.from_pydict({"size": pa.array(np.zeros(len(words), np.int32)), "key": pa.array(word_keys(words).view(np.int64)), "lang": langs, "n": pa.array(n)})
            for size in range(1, longest + 1):
                keys, owner = gram_keys(words, size)
                yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(keys), size, np.int32)), "key": pa.array(keys.view(np.int64)), "lang": langs.take(pa.array(owner)), "n": pa.array(n[owner])})

    return counts.mapInArrow(tidied(run), "size int, key long, lang string, n long").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rows: Column | None = None, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500, longest: int = 5, least: int = 2) -> Model:
    """A model from the labelled documents that ``rows`` selects (all, if not given)."""
    known = docs.where(F.col(lang_col).isNotNull() if rows is None else rows & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")
    parts = 1 << 20
    texts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    share = texts.select("lang", (F.floor(parts * F.least(F.lit(1.0), sample_docs / F.col("texts"))) + 1).alias("share"))
    sample = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(parts)) < F.col("share")).select("lang", "text").distinct()
    counts = stored(_grams(_counts(sample), longest), "language-counts")
    sizes = {r["size"]: r["keys"] for r in counts.groupBy("size").agg(F.countDistinct("key").alias("keys")).collect()}
    totals = counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in totals})
    at = {lang: i for i, lang in enumerate(langs)}
    sums = np.zeros((longest + 1, len(langs)))
    for r in totals:
        sums[r["size"], at[r["lang"]]] = r["n"]
    enough = counts.groupBy("size", "key").agg(F.sum("n").alias("all")).where((F.col("all") >= least) | (F.col("size") == 1)).select("size", "key")
    tables = []
    for size in range(longest + 1):
        got = counts.where(F.col("size") == size).join(enough.where(F.col("size") == size).select("key"), "key").select("key", "lang", "n").toArrow()
        keys, place = np.unique(got["key"].to_numpy().view(np.uint64), return_inverse=True)
        lang = got["lang"].combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        number = np.array([at[x] for x in lang.dictionary.to_pylist()], np.int64)
        found = np.zeros((len(keys), len(langs)), np.float32)
        if len(keys):
            found[place, number[lang.indices.to_numpy()]] = got["n"].to_numpy()
        found = np.log((found + np.float32(0.5)) / (sums[size] + 0.5 * sizes.get(size, 0)).astype(np.float32)) if len(keys) else found
        tables.append((keys, found))
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: id, ``lang_pred`` and ``lang_score``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = held.value.scorer()
        for batch in slices(batches):
            found = score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "lang_pred": pa.array([x[0] for x in found], pa.string()), "lang_score": pa.array([x[1] for x in found], pa.float64())})

    return source.mapInArrow(tidied(run), f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, lang_score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or a score under ``least``.  All columns stay."""
    place, held = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = held.value.scorer()
        for batch in slices(batches):
            found = score(batch.column(place).to_pylist())
            yield batch.filter(pa.array([x[0] != "und" and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)

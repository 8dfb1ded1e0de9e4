"""The registered queries of the text operators: thin wrappers that derive the contracts' columns from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, licenses, mixing, neardup, quality, sharding, suffixdedup, tokens
from .common import documents
from .sql import ORACLES


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of all documents against all items: windows of 10 words."""
    found = decontam.scan(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of all documents.  ``score``: 1 where a whole notice matches, 0.5 where only a name phrase does, else 0."""
    found = licenses.scan(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    names = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.when(F.exists("matches", lambda m: ~m["base"]), 1.0).when(F.size("matches") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from those whose crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files in ascending doc_id order and read back."""
    folder, files = tokens.write(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
    return tokens.read(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``rows``: proportional stratified interleaving by source."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.interleave(docs, 8, carry=["size", "text_crc32"])
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: shingles of five words, similarity of 85 % or more."""
    return neardup.groups(documents(spark, sf_dir, "doc_id", "text"), 85)


#: Token weights of the domains told by ``labels``: more good text, little that is toxic.
MIXTURE = {"good": 0.85, "poor": 0.13, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target mixture, with their tokens and posteriors."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    mixture = mixing.fit(docs, domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), MIXTURE)
    names = mixture.classifier.domains
    return mixture.rates(docs).select("row.doc_id", "n_tokens", *[F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(names)], "rate")


#: Grades told by ``labels``: 0 toxic, 1 poor, 2 good.
GRADES = 3


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labelled documents."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).cast("int").alias("grade"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of all documents, the probability of the best grade, and whether that selects them."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.fit(docs, grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), GRADES)
    return quality.predict(docs, model, tail=2).select("doc_id", "score", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 50-byte strings that start in an earlier document too."""
    found = suffixdedup.removed(documents(spark, sf_dir, "doc_id", "text"), 50)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    raw = F.coalesce("text", F.lit(b""))
    return found.select("doc_id", (F.length(raw) + gone).alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all vectors to those whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.Index(vectors).search(F.col("id") % 50 == 0, k=5)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_neardup, op3_mixing, op4_language, op5_token_ids, op6_quality, op7_repeats, op8_nearest, op9_decontam, op10_sharding)}
ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}

"""The queries of the operators of this package, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescale.llm import cotrain, crf, dac, katz, licenses, packing, phrases, quality, secrets, simhash, spelling, vectors, winnow
from tonescale.session import scratch_path

POLICY = "web@2"
TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark, sf_dir):
    return secrets.secret_digest(documents(spark, sf_dir))


def op2_katz(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return katz.score(docs, katz.fit(docs))


def op3_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER)


def op4_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return crf.predict(docs, crf.fit(docs))


def op5_token_codes(spark, sf_dir):
    folder = scratch_path(spark, "codes")
    dac.write(documents(spark, sf_dir), folder, TOKENIZER)
    return dac.read(spark, folder)


def op6_decontamination(spark, sf_dir):
    return phrases.contamination_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality(spark, sf_dir):
    stored = quality.ledger(documents(spark, sf_dir))
    return stored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.kept("base@1")).alias("base_failed"),
        quality.kept(POLICY).alias("kept"),
        "fail_bits",
    )


def op8_quality_classifier(spark, sf_dir):
    return cotrain.quality_verdict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_licenses(spark, sf_dir):
    return licenses.license_digest(documents(spark, sf_dir))


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark, sf_dir):
    return vectors.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_winnowing(spark, sf_dir):
    return winnow.compare_edited(documents(spark, sf_dir))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


QUERIES: tuple[Callable, ...] = (
    op1_secrets, op2_katz, op3_packing, op4_language, op5_token_codes, op6_decontamination, op7_quality, op8_quality_classifier,
    op9_licenses, op10_simhash, op11_vector_codes, op12_winnowing, op13_spelling_variants,
)

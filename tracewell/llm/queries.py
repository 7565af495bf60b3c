"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, fim, hnsw, langid, line_dedup, mixing, quality, simhash, substring, suffix, toxicity, webp
from .common import in_fold, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, keep=~in_fold("doc_id", 4, 2))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    lines = pages.select("page_id", line_dedup.page_host(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("lines"))
    kept = line_dedup.drop_boilerplate(lines)
    return kept.select(
        "page_id", "host", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(F.array_join("kept", "\n"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.decode_media(webp.encode_media(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, keep=~in_fold("doc_id", 5, 0))
    scored = quality.quality_scores(docs, model)
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"), "strength")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return hnsw.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, keep=~in_fold("doc_id", 5, 0))
    return langid.predict_languages(docs, model).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", fim.sha256_text(F.col("output")).alias("output_sha256"), fim.sha256_text(F.col("restored")).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_mixing, op4_line_dedup, op5_webp, op6_simhash, op7_quality, op8_bpe, op9_hnsw, op10_language, op11_suffix_dedup, op12_audit, op13_fim)}
ORACLES = {"op3_mixing": mixing.ORACLE_SQL, "op4_line_dedup": line_dedup.ORACLE_SQL, "op12_audit": audit.ORACLE_SQL, "op13_fim": fim.ORACLE_SQL}

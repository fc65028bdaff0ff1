"""The registered queries of this subpackage: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import codes, decontam, jaccard, langid, lines, mixing, pages, pieces, ranking, sql, token_counts, token_files, toxicity, vectors
from runlens.session import importable, shared_dir, table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    found = lines.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    path = shared_dir(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path, digest=True)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    found = decontam.measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated",
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard.link(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).drop("text")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return vectors.search(table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    found = codes.compress(table(spark, sf_dir, "embeddings"))
    hex_code = F.array_join(F.transform("code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    return found.select("vec_id", hex_code.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    model = vocabulary("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text"), model)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_line_dedup, op3_html_extraction, op4_toxicity, op5_source_mixing, op6_token_files,
        op7_benchmark_decontamination, op8_ngram_jaccard_join, op9_token_counts, op10_exact_top_k, op11_ranked_search, op12_vector_codes, op13_sentencepiece,
    )
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": lines.SQL,
    "op5_source_mixing": mixing.SQL,
    "op7_benchmark_decontamination": sql.DECONTAMINATION,
    "op8_ngram_jaccard_join": sql.JACCARD,
    "op10_exact_top_k": sql.TOP_K,
    "op11_ranked_search": sql.RANKED,
    "op12_vector_codes": sql.vector_codes(),
}

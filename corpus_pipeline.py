"""From raw documents to token files: the stages in order, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontam, jaccard, mixing, token_files, toxicity
from runlens.llm.queries import vocabulary
from runlens.session import importable, materialise, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score reaches the threshold go."""
    importable(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 4-word shingles, at a similarity of 0.85 or more, the one of the smallest id stays."""
    importable(spark)
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the coverage rule calls contaminated go; the others stay as they are."""
    importable(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, in the order of the schedule: part after part, row after row."""
    return mixing.mixed(docs)


def written_order(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The columns that tell where a row stood in the files it was read from; rows that come from no file go by doc_id."""
    try:
        docs = docs.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs, [F.col("doc_id")]
    return docs, [F.coalesce(F.expr("try_cast(regexp_extract(_file, 'part-(\\\\d+)', 1) as int)"), F.lit(0)), F.col("_file"), F.col("_row")]


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture, read back: doc_id, start, n_tokens and ids_crc32."""
    importable(spark)
    path = shared_dir(spark)
    docs, order = written_order(docs)
    token_files.write_tokens(docs, path, vocabulary("byte_bpe_50k.json"), order_by=order)
    return token_files.read_tokens(spark, path, digest=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokenize),
]

#: The classifier of the first stage has no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(spark, docs)
    return docs

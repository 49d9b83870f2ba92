"""The corpus pipeline: language ID, near duplicates, benchmark contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with
the columns of `documents`; the last gives tokens. Between stages the documents are
written as Parquet into the shared folder and read again. The executors first return
memory that the stage before has left unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, jaccard, language, pii
from tidelog.llm.common import executors_give_back, stored, table
from tidelog.llm.queries import BYTE_BPE


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose language is rejected (no letter, or a margin below the calibrated one) go."""
    model = language.train(docs, "text", "lang", "doc_id")
    names = [f"__{k}" for k in range(len(docs.columns))]  # docs may have columns named as predict's
    return language.predict(docs.toDF(*names), model, names[docs.columns.index("text")]).where("not rejected").select(*names).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near duplicates (five words, similarity 0.8), the document with the smallest id stays."""
    executors_give_back(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a window of a benchmark item go."""
    executors_give_back(spark)
    found = decontaminate.matches(docs.select(F.struct("doc_id", F.xxhash64("text")).alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    hit = found.where("n_hit > 0").select("key.*").toDF("__id", "__hash").distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data and the terms that give it away are replaced; all documents stay."""
    executors_give_back(spark)
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents' tokens and digests of them and of what they decode to."""
    executors_give_back(spark)
    return bpe.token_digest(docs, BYTE_BPE, ["doc_id", "lang", "source"])


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("bpe", tokens),
]

#: No SQL: a trained model and a tokenizer are among the stages. tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs

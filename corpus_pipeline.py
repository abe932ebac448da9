"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, language_id, mixing, near_dedup, token_files
from sightline.llm.common import Workspace
from sightline.llm.queries import tokenizer_path

#: Words of a shingle and least similarity (percent) of near-duplicates in a corpus.
SHINGLE_WORDS, SIMILAR = 5, 80


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; a document without a language gets the predicted one.

    Null, empty and other texts without a letter are rejected. A table of which no row has a language teaches
    nothing, and then none goes. Repeated rows are judged alike, and null ids are no matter. Texts of any length
    are read whole. An empty table gives an empty result.
    """
    found = language_id.identify(docs, language_id.fit(docs))
    language, _, rejected = found.columns[-3:]
    filled = F.coalesce(F.col("lang").cast("string"), F.when(F.col(language) != language_id.UNDETERMINED, F.col(language)))
    return found.where(~F.col(rejected)).withColumn("lang", filled).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least id (null last); all other rows stay, whatever their ids.

    Rows without words (null, empty and white texts) are no near-duplicates; of those that are alike in a
    doc_id (not null) and text, one stays. Texts of any length are compared whole. An empty table gives an empty result.
    """
    return near_dedup.drop_near_duplicates(docs, k=SHINGLE_WORDS, percent=SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in spans of the benchmark.

    Rows are judged by their own text, so null and repeated ids do no harm. Null and empty texts have no
    words and stay. Texts of any length are read whole. An empty table gives an empty result.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by ranges of training position.

    Null and empty texts have no words: they are taken once at most. A null source is a source of its own.
    Rows without an id and repeated rows each have their own place. An empty table gives an empty result.
    """
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32.

    A null text is encoded as an empty one; rows without an id come first, rows of one id in the order of
    their texts. An empty table gives an empty result.
    """
    folder = f"{Workspace(spark, 'pipeline').path}/tokens"
    token_files.write_token_files(docs, folder, tokenizer_path())
    return token_files.digest(token_files.read_token_files(spark, folder))


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: No stage's method (trained model, hashed signatures, tokenizer) can be put in SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    space = Workspace(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

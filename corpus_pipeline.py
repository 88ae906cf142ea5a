"""Training-data pipeline over ``documents``: five stages, each one of the operators in ``riskspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet
to the shared folder and rereads it as the next one's docs. All stages but the last return the
columns of ``docs``; other columns than doc_id, text, lang and n_chars pass through them untouched.

Defined cases, for every stage: an empty table gives an empty result; NULL texts count as empty (language and quality decide on
them as such); repeated rows and rows of equal or NULL id are separate documents, except where a stage says otherwise; the models
learn from rows with an id as the operators do."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import langid, near_dedup, packing, quality, repeats
from riskspark.llm.common import keep_rows, materialize, table
from riskspark.llm.queries import BYTE_FILE, RANK_FILE, language_prototypes, quality_model

CAPACITY = 2048


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; those without text or letters go, and those that share no letter
    sequence with any language (score 0)."""
    prototypes = language_prototypes(docs)

    def known(b) -> list[bool]:
        langs, scores = langid.identify(b.column("text").to_pylist(), prototypes)
        return [lang != langid.UNKNOWN and score > 0 for lang, score in zip(langs, scores)]

    return keep_rows(docs, known)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more stay."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))

    def good(b) -> list[bool]:
        return [score >= 0.5 for score in quality.scorer(model).scores(b.column("text").to_pylist())]

    return keep_rows(docs, good)


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for every row: its file's number and its place there, the same in every run over the
    files. What isn't a plain table of files is written as one first."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.children().isEmpty() or not docs.inputFiles():
        docs = materialize(docs, "pipeline-rows")
    spark, path = docs.sparkSession, F.col("_metadata.file_path")
    paths = sorted(r[0] for r in docs.select(path).distinct().collect())  # one a file
    files = spark.createDataFrame(list(enumerate(paths)) or [(0, "")], "_file long, _path string")
    placed = docs.withColumn("_place", F.col("_metadata.row_index")).withColumn("_at", path).join(F.broadcast(files), F.col("_at") == F.col("_path"))
    return placed.withColumn("_row", F.shiftleft("_file", 36) + F.col("_place")).drop("_place", "_at", "_file", "_path")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (5-word shingles, similarity 0.8): the first row.

    Rows are told apart by a number, so that of repeated rows, rows of equal id and rows without one each group keeps
    one too. Documents without a word are in no group: all stay."""
    numbered = numbered_rows(docs)
    found = near_dedup.near_duplicates(numbered.select("_row", "text"), size=5, percent=80, id_col="_row", label="pipeline-near")
    return numbered.join(found.where(~F.col("kept")).select("_row"), "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier are cut out; ``n_chars`` follows the text."""
    found = repeats.remove_repeats(docs, label="pipeline-repeats", as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most ``CAPACITY`` tokens."""
    added = packing.added_tokens(public_tokenizers.path(BYTE_FILE))
    return packing.pack_documents(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, CAPACITY, label="pipeline-pieces", added=added)


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages' models and searches have no SQL form; tests compare every stage's rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

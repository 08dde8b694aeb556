"""A corpus pipeline: language ID, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and gets all rows that the stage before kept, as Parquet. All
but the last return the columns of ``documents``, whatever they are called, with their values. Rows are
judged one by one; ids may repeat or be null. An empty table passes through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm.common import id_bucket, numbered, only, removed, settled, shared_dir, table, written
from quillveil.llm.decontamination import overlaps
from quillveil.llm.language_id import fit, identify
from quillveil.llm.mixing import mix
from quillveil.llm.ngram_join import ngram_groups
from quillveil.llm.queries import token_rows


#: Tables that the last stage's result reads.
_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Once a stage's result is written, the next stage removes what that result was made from.

    If the next one's rows still read those tables, they stay.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {p.rsplit("/", 1)[-1] for p in _left}
        if names and not any(names.intersection(file.split("/")) for file in docs.inputFiles()):
            for path in [p for p in _left if p in written]:
                removed(spark, at := written.index(path), at + 1)
        known = set(written)
        out = f(spark, docs, sf_dir)
        _left[:] = [p for p in written if p not in known]
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose language is rejected.

    These are null and empty texts, texts without a letter, and texts with a narrow margin. Whole texts
    count, however long. Repeated rows fare alike; with nothing learnt all rows go.
    """
    names = ("_stage_lang", "_stage_score", "_stage_rejected")
    found = identify(docs, fit(docs, F.coalesce(id_bucket("doc_id", 4) != 2, F.lit(False))), names=names)
    return found.where(~F.col(names[2])).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of five-word shingle sets with a similarity of 0.8 or more.

    Rows count one by one, whatever their ids: exact copies go but for one, and null ids are no tie. Texts
    without words, null or empty, are no copies of each other.
    """
    rows, row = numbered(docs)
    dropped = settled(lambda: ngram_groups(rows, size=5, percent=80, id_col=row).where("not kept").select(row), "dropped")
    return only(rows, dropped, row, "left_anti").select(*docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a benchmark passage; other rows with their ids stay, and so do texts without words."""
    rows, row = numbered(docs)
    hit = settled(lambda: overlaps(rows, table(spark, sf_dir, "benchmark"), id_col=row, unique=True).select(row).distinct(), "dropped")
    return only(rows, hit, row, "left_anti").select(*docs.columns)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out rows as the mix takes them.

    Rows are drawn one by one, whatever their ids; rows without words are drawn at their source's rate.
    """
    rows, row = numbered(docs)
    picked = settled(lambda: mix(rows, id_col=row).where("copies > 0").select(row, F.col("copies").alias("_copies")), "picked")
    both = rows.select(row, F.struct(*docs.columns).alias("_doc")).join(picked, row)
    return both.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what reading them back gives for each row.

    A null or empty text is the end id alone; rows are in the order of ids, nulls first, equal ids in that
    of their tokens. Other columns are not read.
    """
    return token_rows(docs)


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mixed), ("token files", token_files)]

#: Hash draws, compression and tokenization are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

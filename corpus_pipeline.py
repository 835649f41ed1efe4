"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.

Edge cases, alike in every stage: rows without doc_id take part and come after all others where an order
decides; repeated rows are judged, cut, mixed and packed like any other (near-duplicates keeps one);
extra columns of ``documents``, whatever their names, pass through to the last stage, which returns its own
columns only; an empty table gives no rows.  A null or blank text has no word, so the classifier drops it;
where a stage is given such a text all the same, line dedup and near-duplicates keep it, mixing never takes
it and packing packs its end id.  A text of any length is one document throughout.

A stage's scratch tables go when the next one starts, and a stage's result once the next one is written.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import owned, release, remove, shared_dir, table
from quillstone.llm.kneser_ney import accepted
from quillstone.llm.minhash_join import one_of_each
from quillstone.llm.mixing import mixed_documents
from quillstone.llm.packing import pack
from quillstone.llm.queries import pack_params, trusted_ids
from quillstone.llm.template_dedup import dedup_lines


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """The stage, which first deletes the scratch tables of the stage before it: that one's result is written."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with owned("pipeline"):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without any trusted document all with a word stay."""
    return accepted(docs, trusted_ids(spark, sf_dir))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go from all texts but their first (least doc_id, then text hash); documents stay."""
    return dedup_lines(docs, counts=False)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the least doc_id, null last, then the least text hash."""
    return one_of_each(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources (null is one) are taken to their targets: whole documents as often as they fit, then blocks of words."""
    return mixed_documents(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces and their places in sequences."""
    return pack(docs, pack_params())


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: The classifier, the template tree and the fitted patterns are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder.

    A stage that fails leaves nothing there: its own files, its predecessor's and its scratch tables go before the error is raised.
    """
    docs = table(spark, sf_dir, "documents")
    written: list[str] = []
    try:
        for _, work in STAGES:
            path = f"{shared_dir(spark)}/quillstone-stage-{uuid.uuid4().hex}"
            written.append(path)
            work(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            for before in written[:-1]:
                remove(spark, before)
            written = [path]
    except BaseException:
        for path in written:
            remove(spark, path)
        raise
    finally:
        release(spark, "pipeline")
    return docs

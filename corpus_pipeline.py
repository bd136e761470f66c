"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.

Rows are told apart by their place in the files of ``docs``, so null and
repeated ids, repeated rows and columns of any name are no matter; a null text
counts as empty. A stage drops the intermediate tables of the stage before it,
whose result has been written by then.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatspark.llm.common import drop_tables, materialize, numbered, read_documents, tables_of
from chatspark.llm.exact_dedup import radix_dedup
from chatspark.llm.mixing import pareto_mix
from chatspark.llm.near_dup import near_duplicates
from chatspark.llm.packing import decompose, digests
from chatspark.llm.quality import quality_verdicts

_TABLES: list[str] = []


def _stage(function):
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _TABLES)
        with tables_of(_TABLES):
            return function(spark, docs, sf_dir)

    return run_stage


def _rows(docs: DataFrame) -> DataFrame:
    """row_key and the whole row as one column."""
    return numbered(docs, row=F.struct(*[docs[c] for c in docs.columns]))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose number is in ``dropped``."""
    return _rows(docs).join(dropped.select("row_key"), "row_key", "left_anti").select("row.*")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and blank texts go;
    repeated rows share their verdict; an empty table stays empty."""
    marked = numbered(docs, text=F.col("text"), lang=F.col("lang"))
    dropped = quality_verdicts(marked, carry=["row_key"]).filter(~F.col("kept")).select("row_key")
    return _without(docs, materialize(dropped, "pipeline-rejected"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one
    with the smallest id (nulls last); of rows that repeat both, one. All
    texts without words are equal."""
    found = radix_dedup(docs)
    return _without(docs, materialize(found.filter(~F.col("kept")).select("row_key"), "pipeline-copies"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the
    smallest id (nulls last); of rows that repeat it, one."""
    found = near_duplicates(docs)
    return _without(docs, materialize(found.filter(~F.col("kept")).select("row_key"), "pipeline-near"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times), as rows
    of their own. Texts without words are never taken; a null source is a
    source; ties are cut by the row's place."""
    taken = materialize(pareto_mix(docs, weights=[5, 2, 1], share=1.5, limit=2.0)
                        .filter("copies > 0").select("row_key", "copies"), "pipeline-taken")
    return _rows(docs).join(taken, "row_key") \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths; a null text is the end token alone."""
    import public_tokenizers
    return digests(decompose(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing),
          ("packing", packing)]

#: the near duplicates and the tokenizer have no SQL form; tests hold the
#: stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs

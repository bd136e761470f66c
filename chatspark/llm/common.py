"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffles_dropped

#: a word: a run of characters other than space and U+0009 to U+000D
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: a key is hot when it holds at least 1/HOT_SHARE of all rows, so at most
#: HOT_SHARE keys are hot: the bound of every broadcast of hot keys
HOT_SHARE = 1000

#: bits of the filter that ``likely`` broadcasts: its bound at every size
FILTER_BITS = 1 << 25


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, survives lost executors and is stored compressed. The shuffle
    files of the job go once the table is written."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def tables_of(paths: list[str]):
    """Note the tables that :func:`materialize` writes inside, so that the
    caller can drop them once what was read from them has been written."""
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that :func:`materialize` has written."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def _file_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table scan under projections and filters only."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return "Relation" in plan.nodeName() and plan.children().size() == 0


def numbered(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` of ``docs`` and row_key, a number of each row that every
    read gives again.

    Of a Parquet scan (projections and filters allowed) it is the file's place
    among the sorted paths and the row's place in the file, so it depends
    neither on how files are split into tasks nor on the executors there are;
    the paths, which the driver lists for any scan, are broadcast. Any other
    input is written once with its numbers. Columns named like row_key are no
    matter, since only ``columns`` are taken."""
    spark = docs.sparkSession
    if _file_scan(docs):
        meta = docs.metadataColumn("_metadata")
        scan = docs.select(meta["file_path"].alias("__path"), meta["row_index"].alias("__row"),
                           *[c.alias(k) for k, c in columns.items()])
        try:
            scan.schema
        except AnalysisException:  # a format without row numbers
            scan = None
        if scan is not None:
            paths = sorted(r[0] for r in scan.select("__path").distinct().collect())
            places = spark.createDataFrame(list(enumerate(paths)), "__file long, __path string")
            return scan.join(F.broadcast(places), "__path").select(
                (F.shiftleft("__file", 36) + F.col("__row")).alias("row_key"), *columns)
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_key"),
                                   *[c.alias(k) for k, c in columns.items()]), "numbered")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Send whole texts to Python tasks in batches of at most ``rows`` rows.
    Holds for the jobs run inside, so materialize there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scalar_row(df: DataFrame):
    """The single row of a one-row aggregate."""
    return df.first()


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body(column)``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likely(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``rows`` whose column ``name`` is, by a bit of its hash, among
    the values of ``keys``: all that are and few others, so that a shuffle join
    that follows moves little else. The bits are broadcast in words of 64, at
    most FILTER_BITS in all. Pass a written table as ``keys``; a null is no value."""
    bit = f"pmod(xxhash64({name}), {FILTER_BITS}L)"
    word, mask = F.expr(f"shiftright({bit}, 6)"), F.expr(f"shiftleft(1L, cast({bit} & 63 as int))")
    words = keys.filter(F.col(name).isNotNull()).groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(words), "_word")
    return found.filter(F.col(name).isNotNull() & (F.col("_bits").bitwiseAND(mask) != 0)).select(*rows.columns)


def attach_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """Left-join one fact row per group onto ``rows`` without a hot task.

    ``facts`` has the columns ``keys``, ``n_col`` (rows of the group) and
    others. Groups with at least ``total / HOT_SHARE`` rows, of which there
    are at most HOT_SHARE, are broadcast; all others go through a shuffle join
    in which no key has more rows than that. Keys must not be null; both
    inputs are read twice, so pass written tables."""
    hot = facts.filter(F.col(n_col) * HOT_SHARE >= total)
    cold = facts.filter(F.col(n_col) * HOT_SHARE < total)
    hit = rows.join(F.broadcast(hot), keys, "inner")
    miss = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return hit.unionByName(miss)

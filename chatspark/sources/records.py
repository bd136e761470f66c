"""CSV records whose quoted fields may hold line ends, read by many tasks.

A file is read as lines, in splits. Where a record ends depends on whether a
line begins inside a quoted field, which depends on all lines before it; but a
line is only a map from "began inside?" to "ends inside?", and maps compose. So
each split is summed up as one such map, the maps of a file are applied in
order, and then every split cuts its own lines into records. What a split
begins or ends in the middle of is put together at the end: at most two
fragments a split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def ends_inside(line: str, inside: bool, sep: str, quote: str = '"') -> bool:
    """Whether a line that begins inside a quoted field or not ends so. Only
    a quote at the start of a field opens it; doubled quotes stay inside."""
    if quote not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """record, file and place (rises with the order in a file; the least one
    of a file is its first record, the header where there is one).

    Lines end with LF or CRLF, the latter only between records. Empty records
    are left out. The lines are written once to the checkpoint folder, since
    splits may be cut elsewhere by a second scan; the maps of the splits, of
    which the driver plans as many, go through it."""
    lines = cut_lineage(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))

    def runs(batches):
        """(file, start, lines) in order; a split may come in several runs."""
        for b in batches:
            file, start, value = (b.column(i).to_pylist() for i in range(3))
            lo = 0
            for i in range(1, len(file) + 1):
                if i == len(file) or start[i] != start[lo] or file[i] != file[lo]:
                    yield file[lo], start[lo], value[lo:i]
                    lo = i

    def summed(batches):
        name, ends = None, (False, True)
        for file, start, value in runs(batches):
            if (file, start) != name:
                if name:
                    yield pa.RecordBatch.from_pylist([dict(file=name[0], start=name[1], out=ends[0], inside=ends[1])])
                name, ends = (file, start), (False, True)
            for line in value:
                if '"' in line:
                    maps = ends_inside(line, False, sep), ends_inside(line, True, sep)
                    ends = maps[ends[0]], maps[ends[1]]
        if name:
            yield pa.RecordBatch.from_pylist([dict(file=name[0], start=name[1], out=ends[0], inside=ends[1])])

    maps = lines.mapInArrow(summed, "file string, start long, out boolean, inside boolean").collect()
    begins, state, last = [], False, None
    for m in sorted(maps, key=lambda m: (m["file"], m["start"])):
        state = False if m["file"] != last else state
        begins.append((m["file"], m["start"], state))
        state, last = (m["inside"] if state else m["out"]), m["file"]
    known = F.broadcast(spark.createDataFrame(begins, "file string, start long, inside boolean"))
    schema = pa.schema([("record", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()),
                        ("opens", pa.bool_()), ("closes", pa.bool_())])

    def cut(batches):
        """Records; fragments have opens or closes false."""
        name, held, inside, opens, nth, out = None, [], False, True, 0, []

        def put(closes):
            nonlocal nth
            if held:
                out.append(("\n".join(held), *name, nth, opens, closes))
                nth += 1

        def ready():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return batch

        for b in batches:
            begin = b.column(3).to_pylist()
            at = 0
            for file, start, value in runs([b.select([0, 1, 2])]):
                if (file, start) != name:
                    put(False)
                    inside = begin[at]
                    name, held, opens, nth = (file, start), [], not inside, 0
                for line in value:
                    held.append(line)
                    inside = ends_inside(line, inside, sep)
                    if not inside:
                        put(True)
                        held, opens = [], True
                at += len(value)
            if out:
                yield ready()
        put(False)
        if out:
            yield ready()

    pieces = cut_lineage(lines.join(known, ["file", "start"]).select("file", "start", "value", "inside").mapInArrow(
        cut, "record string, file string, start long, nth long, opens boolean, closes boolean"))
    whole = pieces.filter("opens and closes").select("record", "file", "start", "nth")
    return _tidy(whole.unionByName(_joined(pieces.filter("not (opens and closes)"))))


def _joined(parts: DataFrame) -> DataFrame:
    """Records put together from their fragments in consecutive splits."""
    order = Window.partitionBy("file").orderBy("start", "nth")
    return parts.withColumn("chain", F.count_if("opens").over(order)).groupBy("file", "chain").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "nth", "record"))), lambda p: p["record"]), "\n")
        .alias("record"), F.min(F.struct("start", "nth")).alias("first")) \
        .select("record", "file", "first.start", "first.nth")


def _tidy(records: DataFrame) -> DataFrame:
    text = F.regexp_replace("record", r"\r\z", "")
    first = (F.col("start") == 0) & (F.col("nth") == 0)
    text = F.when(first & text.startswith("\ufeff"), F.substring(text, 2, 2147483647)).otherwise(text)
    return records.select(text.alias("record"), "file", F.struct("start", "nth").alias("place")).filter("record != ''")


def without_headers(records: DataFrame) -> DataFrame:
    """The records besides the first of each file."""
    heads = records.groupBy("file").agg(F.min("place").alias("head"))
    return records.join(F.broadcast(heads), "file").filter(F.col("place") != F.col("head")).drop("head")

"""Ranked lexical search by Block-Max MaxScore over sharded posting lists.

Every task indexes its documents in shards of bounded size. A shard's posting
list of a term is cut into blocks of 128 postings; a block keeps the first and
last document, the largest term frequency and the shortest document, and its
postings as variable-length bytes. The index is a Parquet table.

For an item, a shard's lists are sorted by their bounds. Those whose bounds
together stay below the item's tenth best score so far are not essential:
a document found in none of the others cannot enter. Documents of the essential
lists are scored, then looked up in the other lists from the largest bound
down; one whose score and remaining bounds stay below the tenth best goes, and
so does one for which the bound of the block it would be in is too low, before
that block is decompressed. A task carries its heaps from shard to shard;
the heaps of all tasks are merged at the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: terms of lower-cased UTF-8: letters and digits of ASCII and all bytes above
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK = 128
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
INDEX = ("shard long, term string, block int, first int, last int, n int, max_tf long, min_length long, payload binary, "
         "ids array<long>, lengths array<long>")
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("block", pa.int32()), ("first", pa.int32()),
                    ("last", pa.int32()), ("n", pa.int32()), ("max_tf", pa.int64()), ("min_length", pa.int64()),
                    ("payload", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, low ones first, the last of a value below
    128; and the number of bytes of each value."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= (1 << bits)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    part = (np.repeat(values, size) >> (7 * nth)) & 127
    return (part | np.where(nth + 1 < np.repeat(size, size), 128, 0)).astype(np.uint8), size


def decoded(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], part[:-1] < 128]))
    nth = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
    return np.add.reduceat((part & 127) << (7 * nth), begin)


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self):
        self.terms, self.term, self.tf, self.sizes, self.ids, self.lengths = {}, [], [], [], [], []

    def add(self, doc_id, text: str | None) -> None:
        counts = Counter(terms_of(text))
        if counts:
            place = self.terms
            self.term += [place.setdefault(t, len(place)) for t in counts]
            self.tf += counts.values()
            self.sizes.append(len(counts))
            self.ids.append(doc_id)
            self.lengths.append(sum(counts.values()))

    def full(self) -> bool:
        return len(self.term) >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def rows(self, shard: int):
        """The shard as index rows: one for the documents (term empty), one
        for each block."""
        term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int64)
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        nth = np.arange(len(term)) - np.repeat(begin, np.diff(np.append(begin, len(term))))
        start = np.flatnonzero(nth % BLOCK == 0)
        gap = np.diff(doc, prepend=0)
        gap[start] = 0
        raw, size = encoded(np.stack([gap, tf - 1], axis=1).ravel())
        ends = np.append(np.concatenate([[0], np.cumsum(size)])[2 * start], len(raw))
        stop = np.append(start[1:], len(term))
        n = len(start)
        names = pa.array([t.decode("utf-8", "surrogatepass") for t in self.terms], pa.string())
        payload = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, shard)), names.take(pa.array(term[start])), pa.array((nth[start] // BLOCK).astype(np.int32)),
            pa.array(doc[start].astype(np.int32)), pa.array(doc[stop - 1].astype(np.int32)),
            pa.array((stop - start).astype(np.int32)), pa.array(np.maximum.reduceat(tf, start)),
            pa.array(np.minimum.reduceat(np.array(self.lengths, np.int64)[doc], start)), payload,
            pa.nulls(n, _ARROW.field("ids").type), pa.nulls(n, _ARROW.field("lengths").type)], schema=_ARROW)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "term": "", "block": -1, "ids": self.ids, "lengths": self.lengths}],
                                         _ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of ``docs`` with a term, written as Parquet: one
    row for each block of a term's postings in a shard, and one with the ids
    and lengths of a shard's documents (term empty). Whole texts are indexed;
    null and empty texts have no terms; null ids and repeated rows are
    documents of their own; ids must be integers; other columns are ignored."""

    def build(batches):
        task, k, shard = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                shard.add(doc_id.as_py(), text.as_py())
                if shard.full():
                    yield from shard.rows((task << 32) + k)
                    k, shard = k + 1, _Shard()
        if shard.ids:
            yield from shard.rows((task << 32) + k)

    with small_batches(docs.sparkSession):
        return materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                           .mapInArrow(build, INDEX), "search-index")


class Searcher:
    """The best documents of each item (lists of places in ``weights``) over
    the shards it is given. ``decompressed`` and ``blocks`` count work."""

    def __init__(self, items: list[list[int]], weights: list[int], docs: int, words: int, k: int):
        self.items, self.weights, self.docs, self.words, self.k = items, weights, docs, words, k
        self.best = [[] for _ in items]  # (-score, id is null, id), best first
        self.blocks = self.decompressed = 0

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 10 + (90 * length * self.docs) // self.words
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def search(self, ids: list, lengths: np.ndarray, lists: dict) -> None:
        """``lists``: of a term's place, the columns first, last, max_tf,
        min_length and payload of its blocks in order."""
        bounds = {t: self.weights[t] * self.impact(b["max_tf"], b["min_length"]) for t, b in lists.items()}
        self.blocks += sum(len(b) for b in bounds.values())
        ready = {}

        def postings(t: int, block: int):
            """Documents of a block and what they score."""
            if (t, block) not in ready:
                pair = decoded(lists[t]["payload"][block]).reshape(-1, 2)
                doc = lists[t]["first"][block] + np.cumsum(pair[:, 0])
                ready[t, block] = doc, self.weights[t] * self.impact(pair[:, 1] + 1, lengths[doc])
                self.decompressed += 1
            return ready[t, block]

        for item, terms in enumerate(self.items):
            have = sorted((int(bounds[t].max()), t) for t in terms if t in lists and self.weights[t] > 0)
            best = self.best[item]
            least = max(1, -best[-1][0]) if len(best) == self.k else 1
            below = np.cumsum([0] + [b for b, _ in have])  # below[i]: bounds of the i lists with the smallest
            split = int(np.searchsorted(below[1:], least, "left"))  # lists before it are not essential
            if split == len(have):
                continue
            score = np.zeros(len(ids), np.int64)
            for _, t in have[split:]:
                for block in range(len(bounds[t])):
                    doc, part = postings(t, block)
                    score[doc] += part
            alive = np.flatnonzero(score)
            for i in range(split - 1, -1, -1):
                alive = alive[score[alive] + below[i + 1] >= least]
                t = have[i][1]
                at = np.searchsorted(lists[t]["last"], alive)
                inside = at < len(bounds[t])
                inside[inside] = lists[t]["first"][at[inside]] <= alive[inside]
                bound = np.where(inside, bounds[t][np.where(inside, at, 0)], 0)
                keep = score[alive] + bound + below[i] >= least
                alive, at, inside = alive[keep], at[keep], inside[keep]
                for block in np.unique(at[inside]).tolist():
                    doc, part = postings(t, block)
                    there = np.isin(doc, alive[inside & (at == block)], assume_unique=True)
                    score[doc[there]] += part[there]
            alive = alive[score[alive] >= least]
            if len(alive) > self.k:  # all that tie with the last stay for the order by id
                alive = alive[score[alive] >= np.partition(score[alive], -self.k)[-self.k]]
            found = [(-int(score[d]), ids[d] is None, ids[d] or 0) for d in alive.tolist()]
            self.best[item] = sorted(best + found)[:self.k]


def _lists_of(shard_rows, place: dict[str, int]) -> tuple[list, np.ndarray, dict]:
    """A shard's documents and its lists by term."""
    ids, lengths, of = None, None, {}
    for r in shard_rows:
        if r["term"] == "":
            ids, lengths = r["ids"], np.array(r["lengths"], np.int64)
        else:
            of.setdefault(place[r["term"]], []).append(r)
    lists = {}
    for t, rows in of.items():
        rows.sort(key=lambda r: r["block"])
        lists[t] = {c: np.array([r[c] for r in rows], np.int64) for c in ("first", "last", "max_tf", "min_length")}
        lists[t]["payload"] = [r["payload"] for r in rows]
    return ids, lengths, lists


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text",
           batch: int = 1000) -> DataFrame:
    """The ``k`` highest-scoring documents of each item with a score above 0:
    item_id, rank, doc_id, score; equal scores by ascending id, nulls last.

    Items are taken ``batch`` at a time, whose terms are broadcast. A null or
    empty item and one without known terms has no rows; repeated items are
    items of their own; other columns of ``items`` are ignored."""
    stated = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    total = index.filter("term = ''").agg(
        F.sum(F.size("ids")).alias("docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    out, part = [], []
    for row in stated.toLocalIterator():
        part.append((row["item_id"], row["text"]))
        if len(part) == batch:
            out.append(_search_batch(index, part, total, k, stated.schema["item_id"].dataType))
            part = []
    if part or not out:
        out.append(_search_batch(index, part, total, k, stated.schema["item_id"].dataType))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search_batch(index: DataFrame, stated: list, total, k: int, id_type) -> DataFrame:
    spark = index.sparkSession
    sets = [sorted({t.decode("utf-8", "surrogatepass") for t in terms_of(text)}) for _, text in stated]
    words = sorted({t for s in sets for t in s})
    terms = F.broadcast(spark.createDataFrame([(t,) for t in ["", *words]], "term string"))
    wanted = index.join(terms, "term")
    df = dict(wanted.filter("term != ''").groupBy("term").agg(F.sum("n")).collect())  # at most the batch's terms
    docs, length = total["docs"] or 0, total["words"] or 0
    known = [t for t in words if t in df]
    place = {t: i for i, t in enumerate(known)}
    weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) for t in known]
    numbers = [[place[t] for t in s if t in place] for s in sets]
    columns = ["shard", "term", "block", "first", "last", "max_tf", "min_length", "payload", "ids", "lengths"]

    def run(batches):
        searcher = Searcher(numbers, weights, docs, length, k)
        shard, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    if held:
                        searcher.search(*_lists_of(held, place))
                    shard, held = r["shard"], []
                if r["term"] == "" or r["term"] in place:
                    held.append(r)
        if held:
            searcher.search(*_lists_of(held, place))
        task = TaskContext.get().partitionId()
        rows = [(i, task, -s, None if null else d) for i, best in enumerate(searcher.best) for s, null, d in best]
        columns_out = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_out, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                         names=["item", "task", "score", "doc_id"])

    heaps = wanted.select(*columns).repartition("shard").sortWithinPartitions("shard") \
        .mapInArrow(run, "item int, task int, score long, doc_id long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # heaps of 64 tasks first, so that no task ranks those of all
    some = heaps.withColumn("some", F.floor(F.col("task") / 64)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(stated)],
                                  f"item int, item_id {id_type.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")

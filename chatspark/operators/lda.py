"""Batch LDA by variational inference over (document, term, count) rows.

Every iteration reads all documents. A row's topic shares come from its
document's topic weights and its term's topic weights; summed by document and
by term they are the next weights of either. Both updates take the same shares,
so the bound on the likelihood never falls. Documents are dealt into blocks of
about BLOCK rows once, terms into as many shards. In an iteration a block gets from
each shard the weights of its terms there, works on its documents until their weights
stand still (or ``e_steps`` times) and sends the shard one sum a term and topic back.
Both ways these are one row for a block and shard, their numbers as bytes. The topic
matrix lies in the shards, the vocabulary is never on the driver; only numbers per topic
and block are collected. The tables of an iteration are dropped after the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .ordered import top_k_per_group
from .topics import topic_info

#: (document, term, count) rows in a block, about
BLOCK = 3_000_000
#: rows worked on at a time in a block
PIECE = 100_000
#: a document's weights stand still if they change by less on average (as published)
STILL = 1e-3


def digamma(x: Column | np.ndarray) -> Column | np.ndarray:
    """The derivative of ln Gamma for x > 0: six steps up, then the asymptotic
    series."""
    y = x + 6
    steps = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    square = 1 / (y * y)
    return (np.log(y) if isinstance(y, np.ndarray) else F.ln(y)) - 1 / (2 * y) - square * (1 / 12 - square * (
        1 / 120 - square * (1 / 252 - square * (1 / 240 - square * (5 / 660))))) - steps


@dataclass
class BatchLda:
    """topics: term, df and topic weights w0, w1, ... (Dirichlet parameters);
    docs: key, total and weights g0, g1, ...; bounds: one an iteration."""

    k: int
    key: str
    topics: DataFrame
    docs: DataFrame
    bounds: list[float] = field(default_factory=list)

    def distributions(self) -> DataFrame:
        """key and topic_distribution (array that sums to 1)."""
        return self.docs.select(self.key, F.array(*[F.col(f"g{j}") / F.col("total") for j in range(self.k)])
                                .alias("topic_distribution"))

    def _sums(self) -> list[float]:
        return list(self.topics.agg(*[F.sum(f"w{j}") for j in range(self.k)]).first())

    def top_terms(self, n: int = 10, mixed: dict[int, dict[int, float]] | None = None) -> DataFrame:
        """(topic, rank, term, weight): the likeliest terms of each topic, or of
        the mixtures of topics in ``mixed`` (number -> topic -> share)."""
        sums = self._sums()
        mixed = mixed or {j: {j: 1.0} for j in range(self.k)}

        def best(topic: int) -> DataFrame:
            weight = reduce(Column.__add__, [F.col(f"w{j}") / F.lit(sums[j]) * F.lit(x) for j, x in mixed[topic].items()])
            # the first n of each task: no task sorts the vocabulary
            return self.topics.select(F.lit(topic).alias("topic"), "term", weight.alias("weight")) \
                .orderBy(F.desc("weight"), F.asc("term")).limit(n)

        long = reduce(DataFrame.unionByName, [best(topic) for topic in mixed])
        return top_k_per_group(long, ["topic"], [F.desc("weight"), F.asc("term")], n, rank_col="rank", salt_buckets=8) \
            .select("topic", (F.col("rank") - 1).cast("int").alias("rank"), "term", "weight")

    def topic_vectors(self) -> DataFrame:
        """(topic, vector): k numbers a topic, with the inner products of the
        topics' term distributions, whose vocabulary stays where it is."""
        sums, k = self._sums(), self.k
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        found = self.topics.agg(*[F.sum(F.col(f"w{i}") / F.lit(sums[i]) * (F.col(f"w{j}") / F.lit(sums[j]))) for i, j in pairs]).first()
        products = np.zeros((k, k))
        for (i, j), x in zip(pairs, found):
            products[i, j] = products[j, i] = x
        size, way = np.linalg.eigh(products)
        vectors = way * np.sqrt(np.maximum(size, 0.0))
        return self.topics.sparkSession.createDataFrame([(j, vectors[j].tolist()) for j in range(k)], "topic int, vector array<double>")


def first_weight(term: Column, topic: int, seed: int) -> Column:
    """Between 1 and 2 by hash: topics start apart, reruns alike."""
    return 1 + F.pmod(F.xxhash64(term, F.lit(topic), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)


#: a row from a shard to a block or back (ids: the terms' places in the shard, m: a
#: number for each of them and topic); with a null shard, a block's own weights
_ROWS = "block int, shard int, ids binary, m binary, total binary, fit double"


def lda_batch(counts: DataFrame, k: int = 10, iterations: int = 10, key: str = "msg_id", alpha: float | None = None,
              eta: float | None = None, seed: int = 69, tolerance: float = 0.0, bounds: bool = True,
              e_steps: int = 1, still: float = STILL) -> BatchLda:
    """Fit LDA to ``counts`` (key, term, tf > 0). ``alpha`` and ``eta`` are the
    priors of documents and topics (1 / k by default). An iteration updates a
    document's weights up to ``e_steps`` times, until they change by less than ``still``
    on average; with more than one, those returned are of the fitted topics. Stops after ``iterations`` or once
    the bound rises by less than ``tolerance`` of itself. Documents without terms or
    key have no row; an empty table gives empty tables."""
    alpha, eta = alpha or 1 / k, eta or 1 / k
    spark = counts.sparkSession
    scratch = Scratch(spark, "lda")
    key_type = counts.schema[key].dataType.simpleString()
    counts, counts_path = scratch.write(counts.filter(F.col(key).isNotNull() & F.col("term").isNotNull()).select(
        key, "term", F.col("tf").cast("double").alias("tf")))
    weights = ", ".join(f"w{j} double" for j in range(k))
    docs_schema = f"{key} {key_type}, total double, " + ", ".join(f"g{j} double" for j in range(k))
    entries = counts.count()
    if not entries:
        return BatchLda(k, key, spark.createDataFrame([], f"term string, df long, {weights}"), spark.createDataFrame([], docs_schema))
    n = max(spark.sparkContext.defaultParallelism, entries // BLOCK)
    numbers = F.array(*[F.lit(x) for x in _numbers(spark, n)])

    def dealt(column: str) -> Column:
        return F.element_at(numbers, (F.pmod(F.xxhash64(column), F.lit(n)) + 1).cast("int"))

    def grouped(df: DataFrame, by: str):
        return df.repartition(n, by).groupBy(by)

    built, built_path = scratch.write(grouped(counts.withColumns({"block": dealt(key), "shard": dealt("term")}), "block").applyInArrow(
        _block_of(key), f"block int, keys array<{key_type}>, ends binary, at binary, tf binary, shard int, terms array<string>, df array<long>"))
    scratch.drop(counts_path)
    blocks = built.filter("shard is null").select("block", "keys", "ends", "at", "tf")
    parts = built.filter("shard is not null").select("block", "shard", "terms", "df")
    vocabulary = parts.select("shard", F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("shard", "t.terms").agg(
        F.sum("t.df").alias("df")).select("shard", F.col("terms").alias("term"), "df",
                                          *[first_weight(F.col("terms"), j, seed).alias(f"w{j}") for j in range(k)])
    first, first_path = scratch.write(grouped(parts, "shard").cogroup(grouped(vocabulary, "shard")).applyInArrow(
        _first(k, eta, bounds or tolerance > 0), f"{_ROWS}, terms array<string>, df array<long>"))
    shards = first.filter("block is null")
    known = shards.select(F.size("terms"), "total").collect()
    words, sums = sum(r[0] for r in known), sum(np.frombuffer(r[1]) for r in known)
    out = BatchLda(k, key, None, None)
    come, path = first.filter("block is not null").drop("terms", "df"), None
    state = come.filter("shard is null")

    def stepped(last: bool) -> tuple[DataFrame, str]:
        return scratch.write(grouped(blocks.select("block", "ends", "at", "tf"), "block").cogroup(grouped(come, "block")).applyInArrow(
            _expect(k, alpha, sums, (e_steps, still), last, bounds or tolerance > 0), _ROWS))

    maximised = _maximise(k, eta, bounds or tolerance > 0)
    for _ in range(iterations):
        step, step_path = stepped(False)
        if path:
            scratch.drop(path)
        path = step_path
        told = step.filter("shard is null").select("total", "fit").collect()
        if bounds or tolerance:
            out.bounds.append(sum(r["fit"] for r in told) + float(sum(
                math.lgamma(words * eta) - words * math.lgamma(eta) - math.lgamma(s) - digamma(np.array([s]))[0] * (words * eta - s)
                for s in sums)))
        sums = words * eta + sum(np.frombuffer(r["total"]) for r in told)
        state = step.filter("shard is null")
        come = grouped(step.filter("shard is not null"), "shard").applyInArrow(maximised, _ROWS).unionByName(state)
        if tolerance and len(out.bounds) > 1 and out.bounds[-1] - out.bounds[-2] < tolerance * abs(out.bounds[-1]):
            break
    last = step.filter("shard is not null") if path else first.filter("block is not null").drop("terms", "df")
    out.topics, _ = scratch.write(grouped(shards.select("shard", "terms", "df", "m"), "shard").cogroup(grouped(last, "shard")).applyInArrow(
        _topics_of(k, eta, path is not None), f"term string, df long, {weights}"))
    if path and e_steps > 1:
        state, fitted_path = stepped(True)
        scratch.drop(path)
        path = fitted_path
    out.docs, _ = scratch.write(grouped(blocks.select("block", "keys", "ends", "at", "tf"), "block").cogroup(
        grouped(state, "block")).applyInArrow(_documents_of(k, alpha, key), docs_schema))
    scratch.drop(built_path, first_path, *([path] if path else []))
    return out


def _numbers(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a repartition into n by their hash sends one to each."""
    found: dict[int, int] = {}
    while len(found) < n:
        top = 16 * n * (1 + len(found))
        for part, x in spark.range(top).select(F.col("id").cast("int").alias("x")).groupBy(
                F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x")).collect():
            found[part] = x
    return [found[p] for p in sorted(found)]


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _table(rows: list[dict], names: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r.get(c) for r in rows], t) for c, t in names], names=[c for c, _ in names])


_ROW_TYPES = [("block", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("m", pa.binary()), ("total", pa.binary()),
              ("fit", pa.float64())]
_TERM_TYPES = [("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int64()))]


def _one(table: pa.Table, column: str, kind, row: int = 0) -> np.ndarray:
    return np.frombuffer(table.column(column)[row].as_buffer(), kind)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def _block_of(key: str):
    """A row with the entries of a block in the order of its documents, and one for
    each shard with the terms it has there; ``at`` counts these from shard to shard."""
    def build(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        docs, terms = (_whole(t.column(c)).dictionary_encode() for c in (key, "term"))
        row, at = docs.indices.to_numpy(), terms.indices.to_numpy()
        shard = np.empty(len(terms.dictionary), np.int32)
        shard[at] = t.column("shard").to_numpy()
        place = np.argsort(shard, kind="stable")
        rank = np.empty(len(place), np.int32)
        rank[place] = np.arange(len(place), dtype=np.int32)
        order = np.argsort(row, kind="stable")
        at, df = rank[at], np.bincount(rank[at], minlength=len(place))
        ends = np.cumsum(np.bincount(row, minlength=len(docs.dictionary)))
        names, ordered = terms.dictionary.take(pa.array(place)), shard[place]
        cuts = np.flatnonzero(np.diff(ordered, prepend=ordered[0] - 1))
        keys = pa.ListArray.from_arrays(pa.array([0, len(docs.dictionary)], pa.int32()), docs.dictionary)
        of_block = pa.table([pa.array([block], pa.int32()), keys, *[pa.array([_bytes(v)], pa.binary()) for v in (
            ends.astype(np.int64), at[order], t.column("tf").to_numpy()[order])]], names=["block", "keys", "ends", "at", "tf"])
        offsets = pa.array(np.append(cuts, len(place)), pa.int32())
        of_shards = pa.table([pa.array(np.full(len(cuts), block, np.int32)), pa.array(ordered[cuts]),
                              pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(df))],
                             names=["block", "shard", "terms", "df"])
        columns = ["block", "keys", "ends", "at", "tf", "shard", "terms", "df"]
        return pa.concat_tables([of_block, of_shards], promote_options="default").select(columns)
    return build


def _bound_of(w: np.ndarray, eta: float) -> float:
    """A shard's part of the bound, but for the topics' sums."""
    return float(((eta - w) * digamma(w)).sum() + _log_gamma(w).sum())


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.lgamma, 1, 1)(x).astype(float)


def _first(k: int, eta: float, bound: bool):
    """The first weights, to each block those of its terms; and the shard's terms."""
    def run(parts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        terms = _whole(vocabulary.column("term"))
        w = np.stack([vocabulary.column(f"w{j}").to_numpy() for j in range(k)], axis=1)
        b, shard = np.exp(digamma(w)), vocabulary.column("shard")[0].as_py()
        rows = []
        for i in np.argsort(parts.column("block").to_numpy()):
            ids = pc.index_in(parts.column("terms")[i].values, value_set=terms).to_numpy().astype(np.int32)
            rows.append({"block": parts.column("block")[i].as_py(), "shard": shard, "ids": _bytes(ids), "m": _bytes(b[ids]), "fit": 0.0})
        if bound:
            rows[0]["fit"] = _bound_of(w, eta)
        messages = _table(rows, _ROW_TYPES)
        own = _table([{"shard": shard, "m": _bytes(w), "total": _bytes(w.sum(axis=0))}], _ROW_TYPES)
        whole = pa.array([0, len(terms)], pa.int32())
        own = own.append_column("terms", pa.ListArray.from_arrays(whole, terms)) \
            .append_column("df", pa.ListArray.from_arrays(whole, _whole(vocabulary.column("df"))))
        return pa.concat_tables([messages, own], promote_options="default")
    return run


def _sums_by_term(rows: pa.Table, k: int) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """What the blocks sent added up by term, the rows in the order of blocks, and their terms."""
    order = np.argsort(rows.column("block").to_numpy()).tolist()
    ids = [_one(rows, "ids", np.int32, i) for i in order]
    total = np.zeros((max(int(v.max()) for v in ids) + 1, k))
    for i, at in zip(order, ids):
        total[at] += _one(rows, "m", float, i).reshape(-1, k)
    return total, order, ids


def _maximise(k: int, eta: float, bound: bool):
    """A shard's new weights, to each block those of its terms."""
    def run(rows: pa.Table) -> pa.Table:
        w, order, ids = _sums_by_term(rows, k)
        w += eta
        b = np.exp(digamma(w))
        out = [{"block": rows.column("block")[i].as_py(), "shard": rows.column("shard")[i].as_py(), "ids": _bytes(at),
                "m": _bytes(b[at]), "fit": 0.0} for i, at in zip(order, ids)]
        if bound:
            out[0]["fit"] = _bound_of(w, eta)
        return _table(out, _ROW_TYPES)
    return run


def _topics_of(k: int, eta: float, fitted: bool):
    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        w = _sums_by_term(rows, k)[0] + eta if fitted else _one(own, "m", float).reshape(-1, k)
        return pa.table([own.column("terms")[0].values, own.column("df")[0].values,
                         *[pa.array(np.ascontiguousarray(w[:, j])) for j in range(k)]], names=["term", "df", *[f"w{j}" for j in range(k)]])
    return run


def _own_weights(own: pa.Table, come: pa.Table, k: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights of a block's documents, their sums, sizes): a document's sum is always
    k * alpha + its words."""
    ends, tf = _one(own, "ends", np.int64), _one(own, "tf", float)
    sizes = np.diff(ends, prepend=0)
    words = np.add.reduceat(tf, ends - sizes)
    held = np.flatnonzero(np.array([s is None for s in come.column("shard").to_pylist()], bool))
    g = _one(come, "m", float, int(held[0])).reshape(-1, k).copy() if len(held) else np.repeat((alpha + words / k)[:, None], k, axis=1)
    return g, k * alpha + words, sizes


def _documents_of(k: int, alpha: float, key: str):
    def run(own: pa.Table, come: pa.Table) -> pa.Table:
        g, total, _ = _own_weights(own, come, k, alpha)
        return pa.table([own.column("keys")[0].values, pa.array(total), *[pa.array(np.ascontiguousarray(g[:, j])) for j in range(k)]],
                        names=[key, "total", *[f"g{j}" for j in range(k)]])
    return run


def _expect(k: int, alpha: float, sums: np.ndarray, until: tuple[int, float], last: bool, bound: bool):
    """An iteration over a block: a row with the new weights of its documents, what they
    add to the topics and its part of the bound; unless ``last``, a row to each shard with the
    sums of its terms in each topic."""
    scale = np.exp(-digamma(sums))

    def run(own: pa.Table, come: pa.Table) -> pa.Table:
        at, tf = _one(own, "at", np.int32), _one(own, "tf", float)
        g, total, sizes = _own_weights(own, come, k, alpha)
        place = {s: i for i, s in enumerate(come.column("shard").to_pylist()) if s is not None}
        shards = sorted(place)
        b = np.concatenate([_one(come, "m", float, place[s]).reshape(-1, k) for s in shards]) * scale
        t, share, used = np.empty_like(g), np.empty(len(at)), g.copy() if bound else g
        ends, fit = np.cumsum(sizes), sum(come.column("fit")[place[s]].as_py() for s in shards)
        lo = 0
        while lo < len(g):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            cut = slice(before, ends[hi - 1])
            fit += _settle(b, at[cut], tf[cut], sizes[lo:hi], g[lo:hi], total[lo:hi], t[lo:hi], share[cut], used[lo:hi], alpha, until, bound)
            lo = hi
        state = {"block": own.column("block")[0].as_py(), "m": _bytes(g), "fit": float(fit)}
        if last:
            return _table([state | {"total": _bytes(np.zeros(k))}], _ROW_TYPES)
        for j in range(k):
            b[:, j] *= np.bincount(at, share * np.repeat(t[:, j], sizes), len(b))
        if bound:
            state["fit"] += float(((alpha - used) * (digamma(used) - digamma(total)[:, None]) + _log_gamma(used)).sum()
                                  - _log_gamma(total).sum()) + len(g) * (math.lgamma(k * alpha) - k * math.lgamma(alpha))
        out, start = [state | {"total": _bytes(b.sum(axis=0))}], 0
        for s in shards:
            ids = come.column("ids")[place[s]].as_py()
            end = start + len(ids) // 4
            out.append({"block": state["block"], "shard": s, "ids": ids, "m": _bytes(b[start:end])})
            start = end
        return _table(out, _ROW_TYPES)
    return run


def _settle(b, at, tf, sizes, g, total, t, share, used, alpha, until, bound) -> float:
    """Update the weights ``g`` of some documents until they stand still; ``t`` and
    ``share`` are of the last update, ``used`` the weights before it. Returns the sum of
    the logs of their likelihoods. Documents that stand still drop out once they are many."""
    docs, rows, e, left = np.arange(len(g)), None, b[at], sizes
    fit, (e_steps, least) = 0.0, until
    for step in range(e_steps):
        starts = np.cumsum(left) - left
        now = np.exp(digamma(g[docs]) - digamma(total[docs])[:, None])
        z = np.einsum("ij,ij->i", e, np.repeat(now, left, axis=0))
        words = tf if rows is None else tf[rows]
        part = words / z
        new = alpha + now * np.add.reduceat(e * part[:, None], starts, axis=0)
        still = np.abs(new - g[docs]).mean(axis=1) < least
        end = step == e_steps - 1 or still.all()
        if not end and still.sum() * 4 < len(docs):
            g[docs] = new
            continue
        gone = np.ones(len(docs), bool) if end else still
        of_gone = np.repeat(gone, left)
        t[docs[gone]] = now[gone]
        share[np.flatnonzero(of_gone) if rows is None else rows[of_gone]] = part[of_gone]
        if bound:
            used[docs[gone]] = g[docs[gone]]
            fit += float((words * np.log(z))[of_gone].sum())
        g[docs] = new
        if end:
            break
        stays = ~of_gone
        rows = np.flatnonzero(stays) if rows is None else rows[stays]
        docs, e, left = docs[~gone], e[stays], left[~gone]
    return fit


def reduce_topics(topics: DataFrame, nr_topics: int, counts: DataFrame) -> DataFrame:
    """Merge topics until ``nr_topics`` are left. ``topics`` has (topic,
    vector array<double>), ``counts`` (topic, count); one row a topic, so both
    come to the driver. Each time the smallest topic (ties: the largest number)
    goes into the one with the nearest centroid by cosine (ties: the smallest
    number), whose centroid becomes the mean weighted by counts. Returns
    (topic, merged_into) for every topic; topic -1 (outliers) stays apart."""
    held = {r["topic"]: [r["count"], list(r["vector"])] for r in topics.join(counts, "topic").collect() if r["topic"] != -1}
    into = {t: t for t in held}

    def cosine(a: list[float], b: list[float]) -> float:
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    while len(held) > max(1, nr_topics):
        small = min(held, key=lambda t: (held[t][0], -t))
        n, vector = held.pop(small)
        near = max(held, key=lambda t: (cosine(vector, held[t][1]), -t))
        m, other = held[near]
        held[near] = [n + m, [(n * x + m * y) / (n + m) if n + m else y for x, y in zip(vector, other)]]
        into = {t: near if to == small else to for t, to in into.items()}
    rows = list(into.items()) + [(-1, -1)] * (counts.filter("topic = -1").count() > 0)
    return topics.sparkSession.createDataFrame(rows, "topic int, merged_into int")


def merged_info(model: BatchLda, assigned: DataFrame, nr_topics: int) -> DataFrame:
    """Rows per topic and names, after merging to ``nr_topics``. ``assigned``
    has the topic of each document. A merged topic's terms are weighted by the
    documents of its parts; topics without documents are left out."""
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    held = {r["topic"]: r["count"] for r in counts.collect()}
    into = reduce_topics(model.topic_vectors(), nr_topics, counts)
    mixed: dict[int, dict[int, float]] = {}
    for topic, to in into.collect():
        mixed.setdefault(to, {})[topic] = held[topic]
    mixed = {to: {j: x / sum(parts.values()) for j, x in parts.items()} for to, parts in mixed.items()}
    merged = assigned.join(F.broadcast(into), "topic").select(F.col("merged_into").alias("topic"))
    return topic_info(merged, model.top_terms(4, mixed) if mixed else None)

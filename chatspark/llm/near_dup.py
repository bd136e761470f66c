"""Near-duplicate detection with DartMinHash signatures.

A document is a weighted set: its shingles of five words with their counts.
Darts are thrown by hash into each element's strip of weight and rank; those
below the element's weight and the document's rank limit are hits. Each hit
falls on one coordinate of the signature, which keeps its earliest dart, so two
documents agree on a coordinate with the probability of their weighted Jaccard
similarity. Rows of coordinates form bands; documents that share a band meet,
are compared exactly, and links are closed into classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, attach_facts, materialize, numbered, small_batches

#: in a band of up to so many members those of different classes become pairs,
#: in a larger one they meet in blocks
PAIRED = 32

_MIX = np.uint64(0x9E3779B97F4A7C15)

def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(256, dtype=np.uint64))
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, np.uint64(0x2545F4914F6CDD1D | 1))]))
    return _POWERS[:n]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    if not len(edge):
        return np.zeros(0, np.uint64)
    begin, end = edge[0::2], edge[1::2]
    longest = int((end - begin).max())
    with np.errstate(over="ignore"):
        # a word's value is a polynomial of its bytes; places count from its end
        place = np.repeat(end, end - begin) - np.flatnonzero(~space) - 1
        value = np.add.reduceat(_BYTE[raw[~space]] * _powers(longest)[place],
                                np.concatenate([[0], np.cumsum(end - begin)[:-1]]))
        return _mix(value ^ (end - begin).astype(np.uint64))


def shingle_counts(text: str | None, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words, sorted, and their counts; a
    text with fewer words has one shingle, one without words none."""
    w = word_hashes(text or "")
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        n = max(len(w) - width + 1, 1)
        value = np.zeros(n, np.uint64)
        for k in range(min(width, len(w))):
            value = _mix(value ^ w[k:k + n])
    return np.unique(value, return_counts=True)


def occurrences(text: str | None, width: int = 5) -> np.ndarray:
    """The weighted set as a plain one: the k-th occurrence of a shingle is an
    element, so set Jaccard of these is weighted Jaccard of the counts."""
    h, n = shingle_counts(text, width)
    with np.errstate(over="ignore"):
        nth = np.arange(n.sum(), dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
        return _mix(np.repeat(h, n) + nth * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


#: Poisson(1) distribution: a unit cell's number of darts by a uniform number
_DARTS = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(20)])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Signature of ``k`` 64-bit values of a weighted set (weights above 0).

    The plane of weight and rank is cut into unit cells, each of which holds
    Poisson(1) darts fixed by element and cell. About k ln k + 2k darts hit,
    so that hardly a coordinate stays empty; else the limit is doubled."""
    strips = np.ceil(weights).astype(np.int64)
    level = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    with np.errstate(over="ignore"):
        strip = _mix(np.repeat(elements, strips) + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    room = np.repeat(weights, strips) - level
    partial = bool((room < 1).any())
    hits = k * np.log(k) + 2 * k
    while True:
        limit = hits / float(weights.sum())
        cells = np.arange(int(np.ceil(limit)))
        with np.errstate(over="ignore"):
            seed = _mix((strip[:, None] ^ _mix(cells.astype(np.uint64))[None, :]).ravel())
            n = np.searchsorted(_DARTS, _unit(seed), "right")
            total = int(n.sum())
            nth = np.arange(1, total + 1) - np.repeat(np.cumsum(n) - n, n)
            dart = _mix(np.repeat(seed, n) + nth.astype(np.uint64))
        rank = np.repeat(np.tile(cells, len(strip)), n) + _unit(_mix(dart ^ np.uint64(1)))
        hit = rank < limit
        if partial:
            hit &= _unit(_mix(dart ^ np.uint64(2))) < np.repeat(np.repeat(room, len(cells)), n)
        dart, rank = dart[hit], rank[hit]
        at = (_mix(dart ^ np.uint64(3)) % np.uint64(k)).astype(np.int64)
        earliest = np.full(k, np.inf)
        np.minimum.at(earliest, at, rank)
        if np.isfinite(earliest).all():
            return earliest.view(np.uint64)  # a rank of 53 random bits names its dart
        hits *= 2


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of consecutive coordinates."""
    rows = signature.reshape(bands, -1)
    with np.errstate(over="ignore"):
        key = _mix(np.arange(bands, dtype=np.uint64))
        for c in range(rows.shape[1]):
            key = _mix(key ^ rows[:, c])
    return key.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a 64-bit value."""
    bits = _mix(signature) & np.uint64(3)
    bits = np.concatenate([bits, np.zeros(-len(bits) % 32, np.uint64)]).reshape(-1, 32)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 2, dtype=np.uint64), axis=1).view(np.int64)


def _may_be_similar(a: Column, b: Column, k: int, threshold: float) -> Column:
    """Whether two sketches disagree on no more coordinates than a pair at the
    threshold does: the mean and four standard deviations."""
    p = (1 - threshold) * 3 / 4
    differ = F.lit(0)
    for i in range(-(-k // 32)):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ += F.bit_count(x.bitwiseAND(F.lit(0x5555555555555555)))
    return differ <= int(k * p + 4 * (k * p * (1 - p)) ** 0.5)


def _words_key(text: Column) -> Column:
    """Texts with the same words in order have the same key (128 bits)."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))))


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(row_key, words_key, keys, sketch) of a table with row_key, words_key,
    text."""
    nothing = np.zeros(0, np.int64)

    def sign(batches):
        for b in _slices(batches):
            keys, sketches = [], []
            for value in b.column(2):
                h, n = shingle_counts(value.as_py(), width)
                signature = dart_minhash(h, n.astype(np.float64), bands * rows) if len(h) else None
                keys.append(nothing if signature is None else band_keys(signature, bands))
                sketches.append(nothing if signature is None else sketch(signature))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(keys), _lists(sketches)],
                                             names=["row_key", "words_key", "keys", "sketch"])

    return docs.mapInArrow(sign, "row_key long, words_key binary, keys array<long>, sketch array<long>")


def _slices(batches):
    """Batches of few rows, so that a task holds the results of few texts."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            yield b.slice(lo, 64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0] + [len(x) for x in values])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(values)))


def _occurrence_table(docs: DataFrame, width: int) -> DataFrame:
    def expand(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([occurrences(v.as_py(), width) for v in b.column(1)])],
                                             names=["node", "items"])

    return docs.mapInArrow(expand, "node long, items array<long>")


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, total: int) -> DataFrame:
    """Of ``pairs`` (node, hub) those whose texts have a weighted Jaccard
    similarity of at least ``threshold``. A hub's shingles are sent once for
    every thousand of its partners, not once for each."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(HOT_SHARE)).cast("int"))
    share = F.greatest(F.lit(1), F.ceil(F.col("n") / 1000).cast("int"))
    counts = materialize(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", share), "near-hubs")
    salted = attach_facts(salted, counts, ["hub"], "n", total).withColumn("salt", F.col("salt") % F.col("salts"))
    wanted = pairs.select("node").union(counts.select("hub")).distinct()
    with small_batches(pairs.sparkSession):
        items = materialize(_occurrence_table(texts.join(wanted, "node").select("node", "text"), width), "near-items")
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")) \
        .join(items.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")), "hub")
    both = salted.join(items, "node").join(hubs, ["hub", "salt"])
    common = F.size(F.array_intersect("items", "hub_items"))
    return both.filter(common >= threshold * (F.size("items") + F.size("hub_items") - common)) \
        .select("node", "hub")


def close_classes(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, by
    rounds of hooking to the smallest neighbour's root and shortcutting. Only
    nodes with links appear."""
    edges = materialize(links.select(F.col("node").alias("a"), F.col("hub").alias("b"))
                        .union(links.select("hub", "node")).distinct(), "near-edges")
    root = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
                       .select(F.col("a").alias("node"), "root"), "near-root")
    while True:
        # the smallest root among a node's neighbours, then that root's own root
        seen = edges.join(root.select(F.col("node").alias("b"), F.col("root").alias("r")), "b") \
            .groupBy("a").agg(F.min("r").alias("near"))
        # a node's old root learns of the smaller root too
        hook = root.join(seen, root.node == seen.a).select("node", "root", F.least("root", "near").alias("new"))
        told = hook.groupBy("root").agg(F.min("new").alias("told"))
        step = hook.join(told, "root").select("node", "root", F.least("new", "told").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = materialize(step.join(jump, "new", "left").select(
            "node", F.least("new", F.coalesce("far", "new")).alias("root"),
            (F.least("new", F.coalesce("far", "new")) != F.col("root")).alias("moved")), "near-root")
        if after.filter("moved").isEmpty():
            return after.select("node", "root")
        root = after.select("node", "root")


def _attach_root(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _block_links(rest: DataFrame, texts: DataFrame, threshold: float, width: int, total: int) -> DataFrame:
    """Links (node, hub) between members of different classes of the same band,
    of the written rows (band, key, node, root): block by block, so that a
    member is sent once for each block and not once for each other member.
    Bands with the same members are compared once."""
    from .jaccard_join import compared, rest_blocks
    bands = materialize(rest.select(F.xxhash64("band", "key").alias("sign"), "node", "root").distinct(), "near-bands")
    alike = bands.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"),
                                      F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = materialize(alike.groupBy("n", "first", "x", "y").agg(F.min("sign").alias("sign")).select("sign", "n"), "near-groups")
    members = materialize(attach_facts(bands, once, ["sign"], "n", total)
                          .filter("n is not null").drop("n"), "near-members")
    with small_batches(rest.sparkSession):
        items = materialize(_occurrence_table(texts.join(members.select("node").distinct(), "node").select("node", "text"), width)
                            .withColumnRenamed("items", "tokens"), "near-items")
    sized = materialize(members.join(items.select("node", F.size("tokens").cast("long").alias("size")), "node"), "near-sized")
    blocks = rest_blocks(sized, total)
    if blocks is None:
        return members.select("node", F.col("node").alias("hub")).limit(0)
    return compared(blocks.join(items, "node"), ["sign", "a", "b"], threshold * 100)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    bands: int = 64, rows: int = 9, width: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the smallest row_key of its
    class), class_size, kept (one row of each class) and row_key (the row's
    number in the scan).

    Two documents are linked if the weighted Jaccard similarity of their
    shingle counts is at least ``threshold``; classes are the connected
    components. Texts with the same words in order are one document to the
    comparison, so copies meet no other copy; a null text is empty, texts
    without words form one class. A pair at the threshold shares no band with
    probability (1 - threshold**rows)**bands: 1e-4 by default (5e-8 at 0.85). The row with the
    smallest id stays, null ids last, of rows that repeat an id one. Other
    columns are ignored; an empty table gives no rows.

    In a band, members are not paired with one another but with one hub, the
    member that meets most others over all bands, and classes are closed. Where
    members of several classes remain, all pairs of different classes are
    compared: one by one in a band of at most PAIRED members, else block by
    block, the largest class against the rest, so a band of m members with r
    outside its largest class takes about m * r / BLOCK rows. Two documents of a
    pair whose whole signatures disagree by four standard deviations more than a
    pair at the threshold are not compared exactly (loses 3e-5 of the pairs
    there); in blocks all are."""
    scan = numbered(docs, id=F.col(id_col), words_key=_words_key(F.col(text_col)), text=F.col(text_col))
    with small_batches(docs.sparkSession):
        signed = materialize(signatures(scan.select("row_key", "words_key", "text"), bands, rows, width), "near-signed")
    named = materialize(scan.select("row_key", "id", "words_key"), "near-rows")
    total = named.count()
    # equal texts are one node, named by its first row
    same = materialize(named.groupBy("words_key").agg(F.min("row_key").alias("node"), F.count(F.lit(1)).alias("n")),
                       "near-same")
    nodes = signed.join(same.select(F.col("node").alias("row_key")), "row_key")
    # bands with at least two members; a hub order by the number of meetings
    entries = nodes.select(F.col("row_key").alias("node"), F.posexplode("keys").alias("band", "key"))
    crowded = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = materialize(crowded, "near-crowded")
    members = materialize(attach_facts(entries, crowded, ["band", "key"], "n", total)
                          .filter("n is not null"), "near-members")
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    members = materialize(members.join(meets, "node"), "near-met")
    sketches = signed.select(F.col("row_key").alias("node"), "sketch")
    texts = scan.select(F.col("row_key").alias("node"), "text")
    # first the members of a band meet its hub
    now = materialize(members.join(sketches, "node"), "near-sketched")
    best = F.max(F.struct("meets", (-F.col("node")).alias("least"), "sketch")).alias("best")
    hubs = materialize(now.groupBy("band", "key").agg(best, F.max("n").alias("band_size")).select(
        "band", "key", "band_size", (-F.col("best.least")).alias("hub"), F.col("best.sketch").alias("hub_sketch")),
        "near-hubs-of-bands")
    met = attach_facts(now, hubs, ["band", "key"], "band_size", total).filter(F.col("node") != F.col("hub"))
    similar = _may_be_similar(F.col("sketch"), F.col("hub_sketch"), bands * rows, threshold)
    pairs = materialize(met.filter(similar).select("node", "hub").distinct(), "near-pairs")
    links = materialize(similar_pairs(pairs, texts, threshold, width, total), "near-links")
    roots = None if links.isEmpty() else close_classes(links)
    # then the members of different classes, where a band still holds several
    now = materialize(_attach_root(now, roots), "near-now")
    open_bands = now.groupBy("band", "key").agg(F.min("root").alias("a"), F.max("root").alias("b"),
                                                F.count(F.lit(1)).alias("open_size")).filter("a != b")
    open_bands = materialize(open_bands.select("band", "key", "open_size"), "near-open")
    if not open_bands.isEmpty():
        rest = materialize(attach_facts(now, open_bands, ["band", "key"], "open_size", total)
                           .filter("open_size is not null"), "near-rest")
        few = rest.filter(F.col("open_size") <= PAIRED)
        a, b = few.alias("a"), few.alias("b")
        both = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))
                      & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
                      & _may_be_similar(F.col("a.sketch"), F.col("b.sketch"), bands * rows, threshold))
        more = both.select(F.col("a.node").alias("node"), F.col("b.node").alias("hub")).distinct()
        done = pairs.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub"))
        more = materialize(more.join(done, ["node", "hub"], "left_anti"), "near-pairs")
        found = materialize(similar_pairs(more, texts, threshold, width, total), "near-links")
        links = links.unionByName(found).unionByName(
            _block_links(rest.filter(F.col("open_size") > PAIRED), texts, threshold, width, total))
        roots = None if links.isEmpty() else close_classes(links)
    classes = same.join(roots, "node", "left") if roots is not None else same.withColumn("root", F.col("node"))
    classes = materialize(classes.select("words_key", "n", F.coalesce("root", "node").alias("class_id")), "near-classes")
    tagged = materialize(attach_facts(named, classes, ["words_key"], "n", total)
                         .select("row_key", "id", "class_id"), "near-tagged")
    best = materialize(tagged.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("id").isNull().alias("z"), "id", "row_key")).alias("best"))
        .select("class_id", "class_size", F.col("best.row_key").alias("best_key")), "near-best")
    return attach_facts(tagged, best, ["class_id"], "class_size", total).select(
        F.col("id").alias(id_col), "class_id", "class_size", (F.col("row_key") == F.col("best_key")).alias("kept"), "row_key")

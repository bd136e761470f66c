"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct shingles (tokens). All tokens have one
order: tokens that hardly occur come first, by hash, frequent ones last, the
most frequent at the very end. Two sets that overlap enough share tokens among
the first few of either (its prefix). A rare token in common is taken as a
signature by itself. Of frequent ones, two (very frequent: three) in common are
asked for: the prefix is longer by one (two) for that, and its signatures are
all combinations of as many of them. Documents with a common signature are
candidates and are compared exactly, so the classes of tokens and their order
decide the work but not the result.

Few documents with a common signature become pairs; a pair's number of common
signatures bounds its overlap, so most go before a set is looked at. Where many
share a signature they meet in blocks of bounded size, in which all overlaps
come from one product of incidence matrices; only links that join two classes
leave a block.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_facts, likely, materialize, numbered, small_batches
from .near_dup import _attach_root, _lists, _mix, _slices, close_classes, shingle_counts

#: sets up to SMALL tokens and over LARGE have single tokens only: in the
#: former too few tokens are left over, in the latter combinations are too many
SMALL, LARGE = 10, 64
#: at most so many tokens are ordered by frequency: the bound of the broadcast
FREQUENT = 131_072
#: a token is so ordered, frequent and very frequent from these shares of the
#: documents on
KNOWN_SHARE, PAIR_SHARE, TRIPLE_SHARE = 5e-5, 1e-3, 1e-2
#: up to so many documents with a signature become pairs, more if they are long
PAIRED = 32
#: documents and tokens of a block
BLOCK, BLOCK_TOKENS = 1024, 1 << 21
COUNTED = 1 << 22


def tokens_of(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles, A-Z lower-cased; a text
    with fewer words has one, a text without words none."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return shingle_counts(low, width)[0]


class Order:
    """The tokens ordered by frequency, sorted, with rank (1: least frequent)
    and the number of them that make a signature."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, docs: int):
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, counts))] = np.arange(1, len(tokens) + 1)
        by_token = np.argsort(tokens)
        self.tokens, self.rank = tokens[by_token], rank[by_token]
        self.wants = np.where(counts >= TRIPLE_SHARE * docs, 3, np.where(counts >= PAIR_SHARE * docs, 2, 1))[by_token]

    def signatures(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Signatures of a set (sorted tokens) for a join at ``percent``."""
        n = len(tokens)
        if not n:
            return np.zeros(0, np.uint64)
        rest = n - -(-percent * n // 100) + 1
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        known = self.tokens[at] == tokens if len(self.tokens) else np.zeros(n, bool)
        rare = tokens[~known]
        if len(rare) >= rest + 3:
            return rare[:rest]
        frequent, where = tokens[known], at[known]
        by_rank = np.argsort(self.rank[where])
        ordered = np.concatenate([rare, frequent[by_rank]])
        found = []
        if n <= SMALL * 100 // percent + 1 or n > LARGE:
            found.append(ordered[:rest])
        if SMALL < n <= LARGE * 100 // percent + 1:
            wants = self.wants[where][by_rank]
            more = 0
            while True:
                inside = wants[:max(0, rest + more - len(rare))]
                need = min(1, int((inside == 2).sum())) + min(2, int((inside == 3).sum()))
                if need <= more:
                    break
                more = need
            found.append(rare[:rest + more])
            part = frequent[by_rank][:len(inside)]
            found.append(part[inside == 1])
            for k in (2, 3):
                group = np.sort(part[inside == k])
                found.append(np.array([_joined(c) for c in combinations(group, k)], np.uint64))
        return np.unique(np.concatenate(found))


def _joined(tokens) -> np.uint64:
    value = np.uint64(len(tokens))
    with np.errstate(over="ignore"):
        for t in tokens:
            value = _mix(np.asarray(value ^ t, np.uint64))[()]
    return value


def frequent_tokens(texts: DataFrame, width: int) -> Order:
    """Tokens that repeat. Each task counts tokens over runs of about four
    million of them and passes on those that occur in two documents of a run;
    Spark adds these up. At most FREQUENT come to the driver."""

    def repeated(batches):
        kept, size = [], 0

        def flush():
            t, n = np.unique(np.concatenate(kept), return_counts=True)
            t, n = t[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

        for b in batches:
            for value in b.column(0):
                kept.append(tokens_of(value.as_py(), width))
                size += len(kept[-1])
                if size >= COUNTED:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    docs = texts.count()
    with small_batches(texts.sparkSession):
        counts = texts.select("text").mapInArrow(repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        top = counts.filter(F.col("n") >= F.lit(KNOWN_SHARE * docs)).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    return Order(top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), docs)


def similar(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets with 100 * overlap >= percent * union; with
    ``side`` only those of different sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    # whole numbers: exact below 2 ** 24
    common = np.zeros((len(sets), len(sets)), np.float32 if sizes.max() < 1 << 24 else np.float64)
    width = 1 << 13
    in_slices = np.argsort(column // width, kind="stable")
    row, column = row[in_slices], column[in_slices]
    ends = np.searchsorted(column // width, np.arange(int(shared.sum()) // width + 2))
    for k in range(len(ends) - 1):
        part = slice(ends[k], ends[k + 1])
        if ends[k] < ends[k + 1]:
            m = np.zeros((len(sets), width), np.float32)
            m[row[part], column[part] - k * width] = 1
            common += m @ m.T
    found = []
    for i in range(len(sets)):
        both = common[i, i + 1:].astype(np.int64)
        link = 100 * both >= percent * (sizes[i] + sizes[i + 1:] - both)
        if side is not None:
            link &= side[i + 1:] != side[i]
        found += [(i, j) for j in (np.flatnonzero(link) + i + 1).tolist()]
    return found


def _spanning(pairs, nodes, roots):
    """Links of ``pairs`` that join classes not joined yet."""
    above = {}

    def top(x):
        while x in above:
            x = above[x]
        return x

    for i, j in pairs:
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            above[a] = b
            yield nodes[i], nodes[j]


def compared(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (node, hub) within each block of ``rows``: the keys, node, root,
    side (rows of side -1 meet all, others only another side) and tokens."""
    schema = pa.schema([("node", pa.int64()), ("hub", pa.int64())])

    def run(batches):
        block, held = None, []

        def links():
            sets, nodes, roots, sides = [h[3] for h in held], [h[0] for h in held], [h[1] for h in held], np.array([h[2] for h in held])
            if len(set(roots)) < 2:
                return pa.RecordBatch.from_pylist([], schema)
            found = _spanning(similar(sets, percent, sides if (sides >= 0).any() else None), nodes, roots)
            return pa.RecordBatch.from_pylist([{"node": a, "hub": b} for a, b in found], schema)

        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(keys)))))
            node, root, side = (b.column(len(keys) + i).to_pylist() for i in range(3))
            tokens = b.column(len(keys) + 3)
            flat, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            for r, name in enumerate(names):
                if name != block:
                    if len(held) > 1:
                        yield links()
                    block, held = name, []
                held.append((node[r], root[r], side[r], flat[ends[r]:ends[r + 1]].copy()))
        if len(held) > 1:
            yield links()

    with small_batches(rows.sparkSession):
        dealt = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "root", "side", "tokens")
        return materialize(dealt.mapInArrow(run, "node long, hub long"), "jaccard-links")


def _blocks(n: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("int")


def _block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def rest_blocks(large: DataFrame, total: int) -> DataFrame | None:
    """Blocks (sign, a, b, node, root, side) in which all members of different
    classes of a group meet, of the written rows (sign, node, size, root), of
    which there are ``total`` or fewer: a group's largest class meets the rest,
    but not itself. None if every group is one class."""
    classes = materialize(large.groupBy("sign", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")),
                          "jaccard-classes")
    main = classes.groupBy("sign").agg(
        F.max(F.struct("n", "root", "weight")).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    main = materialize(main.filter("n > main.n").select(
        "sign", F.col("main.root").alias("main"), "n",
        _blocks(F.col("n") - F.col("main.n"), F.col("weight") - F.col("main.weight")).alias("rest_blocks"),
        _blocks(F.col("main.n"), F.col("main.weight")).alias("main_blocks")), "jaccard-open")
    if main.isEmpty():
        return None
    # the rest meets itself and the main class, block by block
    open_ = attach_facts(large, main, ["sign"], "n", total).filter("main is not null")
    is_main = F.col("root") == F.col("main")
    own = F.when(is_main, F.col("rest_blocks") + _block_of(F.col("main_blocks"))).otherwise(_block_of(F.col("rest_blocks")))
    others = F.when(is_main, F.sequence(F.lit(0), F.col("rest_blocks") - 1)) \
        .otherwise(F.sequence(F.lit(0), F.col("rest_blocks") + F.col("main_blocks") - 1))
    return open_.withColumns({"own": own, "other": F.explode(others)}).select(
        "sign", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "root",
        F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, node) of the rows (sign, node, size) that may be linked.
    Where all signatures of both are single tokens, their number bounds the
    overlap: beyond its prefix a set has one token less than it must share."""
    def must(n: Column) -> Column:
        return F.ceil(n * percent / 100)

    def single(n: Column) -> Column:
        return (n <= SMALL) | (n > LARGE * 100 // percent + 1)

    a, b = F.col("a.size"), F.col("b.size")
    both = met.alias("a").join(met.alias("b"), (F.col("a.sign") == F.col("b.sign")) & (F.col("a.node") < F.col("b.node"))
                               & (100 * F.least(a, b) >= percent * F.greatest(a, b)))
    counted = both.groupBy(F.col("a.node").alias("hub"), F.col("b.node").alias("node"), a.alias("a"), b.alias("b")) \
        .agg(F.count(F.lit(1)).alias("common"))
    a, b = F.col("a"), F.col("b")
    most = F.least(a, b, F.col("common") + F.greatest(must(a), must(b)) - 1)
    return counted.filter(~single(a) | ~single(b) | (100 * most >= percent * (a + b - most))).select("hub", "node")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90,
                       width: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the
    smallest id reachable by links (100 * overlap >= ``percent`` * union of
    the sets of distinct ``width``-word shingles, A-Z lower-cased).

    Rows with equal sets are one document to the join. A null or empty text
    has no shingles and is linked with nothing, not even its like; a text
    with fewer words has one shingle. Null ids take part and have the smallest
    other id of their component, null if there is none; rows that repeat an id
    are rows of their own; an empty table gives no rows; other columns are
    ignored. Texts are processed whole; equality of shingles is equality of
    64-bit hashes, of sets that of 128-bit digests.

    A group of sets that share signatures and are not yet one class is
    compared block by block: its largest class meets the others, but not
    itself. A group of m sets none of which are linked takes about m * m / BLOCK
    rows; its rows are those of different sets, not of copies."""
    scan = numbered(docs, id=F.col(id_col), text=F.col(text_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    order = docs.sparkSession.sparkContext.broadcast(frequent_tokens(scan, width))

    def sign(batches):
        for b in _slices(batches):
            sizes, keys, signs = [], [], []
            for value in b.column(2):
                t = tokens_of(value.as_py(), width)
                sizes.append(len(t))
                keys.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest())
                signs.append(order.value.signatures(t, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(signs)],
                names=["row_key", "id", "size", "set_key", "signs"])

    with small_batches(docs.sparkSession):
        rows = materialize(scan.select("row_key", "id", "text").mapInArrow(
            sign, f"row_key long, id {id_type}, size long, set_key binary, signs array<long>"), "jaccard-sets")
    total = rows.count()
    # equal sets are one node, named by its first row
    same = materialize(rows.filter("size > 0").groupBy("set_key").agg(
        F.min("row_key").alias("node"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")), "jaccard-same")
    # neither side has a bound, so these joins are shuffles at every size
    nodes = rows.join(same.select(F.col("node").alias("row_key")).hint("merge"), "row_key")
    entries = materialize(nodes.select(F.col("row_key").alias("node"), "size", F.explode("signs").alias("sign")), "jaccard-entries")
    shared = materialize(entries.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
                         .filter("n > 1"), "jaccard-shared")
    n_entries = entries.count()
    met = materialize(attach_facts(likely(entries, shared, "sign"), shared, ["sign"], "n", n_entries).filter("n is not null"), "jaccard-met")
    # pairs of 24 bytes cost less than the sets of a block (8 bytes a token) if the documents are long
    few = (F.col("n") <= PAIRED) | (3 * F.col("n") <= 2 * F.col("mean"))
    pairs = materialize(_pairs(met.filter(few), percent), "jaccard-pairs")
    # groups, and of those with the same nodes one
    many = met.filter(~few).drop("n", "mean")
    groups = many.groupBy("sign").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("node").alias("first"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    groups = materialize(groups.groupBy("n", "weight", "first", "x", "y").agg(F.min("sign").alias("sign"))
                         .withColumn("blocks", _blocks(F.col("n"), F.col("weight"))).drop("x", "y"), "jaccard-groups")
    members = materialize(attach_facts(many, groups, ["sign"], "n", n_entries).filter("n is not null"), "jaccard-members")
    wanted = materialize(members.select("node").union(pairs.select("hub")).union(pairs.select("node")).distinct(), "jaccard-wanted")

    def expand(batches):
        for b in _slices(batches):
            sets = [tokens_of(v.as_py(), width).view(np.int64) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets)], names=["node", "tokens"])

    with small_batches(docs.sparkSession):
        texts = likely(scan.select(F.col("row_key").alias("node"), "text"), wanted, "node")
        items = materialize(texts.join(wanted.hint("merge"), "node").mapInArrow(expand, "node long, tokens array<long>"), "jaccard-items")
    # all members of a block meet, and of a group in several blocks its first node
    dealt = members.select("sign", _block_of(F.col("blocks")).alias("block"), "node")
    first = groups.filter("blocks > 1").select(
        "sign", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("first").alias("node"))
    once = dealt.unionByName(first).distinct().withColumns({"root": F.col("node"), "side": F.lit(-1)})
    # of pairs, the hub meets the others
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    parts = pairs.join(parts, "hub").withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    partners = parts.select(F.col("hub").alias("sign"), "block", "node", F.lit(1).alias("side"))
    hubs = parts.select(F.col("hub").alias("sign"), "block", F.col("hub").alias("node"), F.lit(0).alias("side")).distinct()
    paired = partners.unionByName(hubs).withColumn("root", F.col("node"))
    links = compared(once.join(items, "node"), ["sign", "block"], percent) \
        .unionByName(compared(paired.join(items, "node"), ["sign", "block"], percent))
    roots = _roots(links)
    large = materialize(_attach_root(members.filter("blocks > 1").select("sign", "node", "size"), roots), "jaccard-large")
    pairs = rest_blocks(large, n_entries)
    if pairs is not None:
        more = compared(pairs.join(items, "node"), ["sign", "a", "b"], percent)
        roots = _roots(links.unionByName(more))
    least = materialize(_attach_root(same.select("set_key", "node", "n", "least_id"), roots), "jaccard-roots")
    lowest = least.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    lowest = materialize(lowest, "jaccard-lowest")
    named = materialize(attach_facts(least, lowest, ["root"], "nodes", total).select("set_key", "n", "component_id"), "jaccard-named")
    done = attach_facts(rows.filter("size > 0").select("set_key", "id", "size"), named, ["set_key"], "n", total)
    alone = rows.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return done.select("id", "size", "component_id").unionByName(alone).select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def _roots(links: DataFrame) -> DataFrame | None:
    return None if links.isEmpty() else close_classes(links)

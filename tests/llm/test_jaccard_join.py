"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, row_key string, node long, tokens string, root int, id string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def components(rows, percent=90):
    """Multiset of (doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                above[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def table(seed=1, copies=60):
    """Near copies around the threshold, shared passages, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for n in (3, 4, 7, 9, 10, 11, 12, 13, 20, 40, 80, 159, 161, 170, 200, 400):
        base = rng.choices(vocabulary, k=n)
        for _ in range(copies // 4):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w[rng.choice([0, 0, 1]):]))
    long = rng.choices(vocabulary, k=90)
    for _ in range(copies * 4):
        w = list(long)
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=k)) for k in (0, 1, 2, 3, 5, 8, 20, 60)]
    texts += [passage.upper(), "a b", "A  B", "a\tb", "b a", "one", "", " \n", None, "É a b c", "é a b c", passage, passage]
    texts += ["tick tock " * 20_000, "tick tock " * 20_001 + "end", "y" * 400_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, passage), (None, "never seen before here"), (5, "a b"), (5, "a b")]


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "r", 1, "t", 2, "i") for d, t in rows], SCHEMA)


@pytest.mark.parametrize("block,paired,share", [(128, 32, (1e-3, 1e-2)), (8, 4, (2e-3, 5e-2)), (3, 1, (0.5, 0.6))])
def test_against_all_pairs(spark, monkeypatch, block, paired, share):
    from chatspark.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "PAIR_SHARE", share[0])
    monkeypatch.setattr(jaccard_join, "TRIPLE_SHARE", share[1])
    rows = table(block)
    assert result(jaccard_join.ngram_jaccard_join(frame(spark, rows))) == components(rows)


def test_only_candidates_reach_the_shuffles(spark, monkeypatch):
    from chatspark.llm import jaccard_join
    passed, kept = [], jaccard_join.likely

    def likely(rows, keys, name):
        passed.append((kept(rows, keys, name).count(), rows.count()))
        return kept(rows, keys, name)

    monkeypatch.setattr(jaccard_join, "likely", likely)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(200)] + [(900, "a b c d e"), (901, "a b c d E f"), (902, "a b c d e f")]
    assert result(jaccard_join.ngram_jaccard_join(frame(spark, rows))) == components(rows)
    assert [few < 30 < all_ for few, all_ in passed] == [True, True]


def test_empty_table(spark):
    from chatspark.llm.jaccard_join import ngram_jaccard_join
    assert ngram_jaccard_join(frame(spark, [])).count() == 0


def test_signatures_never_miss_a_link():
    """Any classes of tokens: sets that overlap enough share a signature."""
    from chatspark.llm.jaccard_join import Order
    rng = np.random.default_rng(3)
    for _ in range(400):
        universe = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
        known = rng.choice(universe, rng.integers(0, 300), replace=False)
        order = Order(known, rng.integers(1, 40, len(known)), int(rng.choice([100, 1000, 4000])))
        n = int(rng.integers(1, 220))
        a = rng.choice(universe, n, replace=False)
        lost = rng.integers(0, max(1, n // 10) + 1)
        b = np.union1d(a[lost:], rng.choice(universe, rng.integers(0, max(1, n // 20) + 1), replace=False))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert len(np.intersect1d(order.signatures(a, 90), order.signatures(b, 90)))


def test_blocks_compare_exactly():
    from chatspark.llm.jaccard_join import similar
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 62, 70_000)
    sets = [np.unique(base[rng.random(len(base)) < p]) for p in (1, 0.95, 0.9, 0.89, 0.94, 0.5)] + [base[:3], base[:3]]
    want = [(i, j) for i in range(8) for j in range(i + 1, 8)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    assert similar(sets, 90) == want


def test_query_against_its_sql(spark):
    import duckdb

    from chatspark.llm.queries import ORACLES, QUERIES
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_token_combination_join"](spark, sf).orderBy("doc_id").collect()
    duckdb.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
    want = duckdb.sql(ORACLES["op13_token_combination_join"]).order("doc_id").limit(10 ** 9).fetchall()
    assert [tuple(r) for r in got] == want
    assert spark.read.parquet(f"{sf}/documents.parquet").agg(F.count_distinct("doc_id")).first()[0] == len(want)

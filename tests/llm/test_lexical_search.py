"""Block-Max MaxScore against the stated sums over all documents."""

import math
import random
import re

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, shard long, term string, ids string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best(docs, items, k=10):
    """Multiset of (item_id, rank, doc_id, score) by scoring everything."""
    found = [(d, terms(t)) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    n, words = len(found), sum(len(w) for _, w in found)
    out = []
    for item, text in items:
        scores = []
        for t in set(terms(text)):
            df = sum(t in w for _, w in found)
            if df:
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                scores.append([weight * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 8 * (10 + (90 * len(w) * n) // words)))
                               for _, w in found])
        total = [sum(s) for s in zip(*scores)]
        top = sorted(((-s, d is None, d or 0) for s, (d, _) in zip(total, found) if s > 0))[:k]
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(top)]
    return sorted(out, key=str)


def table(seed=2, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.5))}" for _ in range(500)] + ["Café", "ÀÇ", "中文", "x9"]
    docs = [(i, rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocabulary, k=int(rng.paretovariate(0.8)) % 400)))
            for i in range(n)]
    docs += [(None, "w1 w2 café"), (None, None), (7, docs[7][1]), (7, docs[7][1]), (n, ""), (n + 1, "...!"), (n + 2, "w3 " * 200_000),
             (n + 3, "q" * 1_000_000), (n + 4, "tie tie"), (n + 6, "tie tie"), (n + 5, "tie tie"), (-4, "TIE tie")]
    docs += [(1000 + i, "same words here") for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 20)))) for i in range(25)]
    items += [(None, "café w2"), (3, "tie"), (3, "tie"), (90, None), (91, ""), (92, "unknown"), (93, "same Words HERE 中文"), (94, "q" * 1_000_000)]
    return docs, items


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block,postings,batch", [(128, 1 << 20, 1000), (4, 300, 7)])
def test_against_all_scores(spark, monkeypatch, block, postings, batch):
    from chatspark.llm import lexical_search
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", postings)
    docs, items = table()
    frame = spark.createDataFrame([(d, t, 1, "t", "i", 2) for d, t in docs], SCHEMA)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert result(lexical_search.search(lexical_search.build_index(frame), asked, batch=batch)) == best(docs, items)


def test_empty_tables(spark):
    from chatspark.llm.lexical_search import build_index, search
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(build_index(spark.createDataFrame([], SCHEMA)), asked).count() == 0
    index = build_index(spark.createDataFrame([(1, "a b", 1, "", "", 1)], SCHEMA))
    assert search(index, asked.limit(0)).count() == 0


def test_bytes_round_trip():
    from chatspark.llm.lexical_search import decoded, encoded
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, (1 << 62) - 1, 5], np.int64)
    raw, size = encoded(values)
    assert decoded(raw.tobytes()).tolist() == values.tolist() and size.sum() == len(raw)


def test_bounds_spare_blocks():
    """Blocks that cannot matter stay compressed, and results are the same."""
    from chatspark.llm import lexical_search as S
    rng = random.Random(8)
    docs = [(i, " ".join(["the"] * rng.randint(1, 3) + rng.choices([f"v{j}" for j in range(3000)], k=rng.randint(5, 30)))) for i in range(4000)]
    docs += [(5000 + i, "the gold mine " + "gold " * (i % 3)) for i in range(30)]
    rng.shuffle(docs)
    shard = S._Shard()
    for d, t in docs:
        shard.add(d, t)
    blocks, ids = list(shard.rows(0))
    rows = blocks.to_pylist() + ids.to_pylist()
    asked = ["gold", "mine", "the"]
    count = {t: sum(t in terms(x) for _, x in docs) for t in asked}
    weights = [math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * count[t] + 1))) for t in asked]
    place = {t: i for i, t in enumerate(asked)}
    found, lengths, lists = S._lists_of([r for r in rows if r["term"] in ("", *asked)], place)
    searcher = S.Searcher([[0, 1, 2]], weights, len(docs), int(lengths.sum()), 10)
    searcher.search(found, lengths, lists)
    searcher.search([i + 10 ** 6 for i in found], lengths, lists)  # now a tenth best is known
    assert sorted((1, r + 1, d, -s) for r, (s, _, d) in enumerate(searcher.best[0]))[:1] == \
        [x for x in best(docs, [(1, "gold mine the")]) if x[1] == 1]
    assert searcher.decompressed < 0.75 * searcher.blocks


def test_query_against_its_sql(spark):
    import duckdb

    from chatspark.llm.queries import ORACLES, QUERIES
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as from '{sf}/{t}.parquet'")
    want = duckdb.sql(ORACLES["op11_block_max_search"]).limit(10 ** 9).fetchall()
    assert result(QUERIES["op11_block_max_search"](spark, sf)) == sorted(want, key=str)

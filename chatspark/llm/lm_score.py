"""Language-model scores by stupid backoff over bigram counts, relationally.

Every word counts as itself, under a 64-bit hash. Words that make up at least
``frequent`` of all words (at most 1 / frequent, a proven bound) are the head:
their counts are broadcast. The documents' bigrams are dealt out and counted by
hash: those of two head words by the bigram, those with a rare word by that
word, so that its count, the sum over its bigrams, is found in the same part;
a bigram of two rare words goes to both, and each part adds what it knows. The
logarithms are summed per document. Bigrams of the most frequent words, which
alone could be hot, are counted and looked up through a small broadcast table.
A document's own occurrences are left out of its bigrams' counts, so a passage
found nowhere else backs off to its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered
from .near_dup import _mix, word_hashes

#: id of the unknown word and of the start of a text
UNKNOWN, START = 0, 1
#: words with the lowest ids, the most frequent ones, whose pairs are broadcast
FREQUENT = 512
#: documents whose bigrams are counted at once (their numbers take 7 bits) and
#: the bits of a word's number there
CHUNK, BITS = 128, 28
#: rows dealt out: a document; a bigram of head words; one dealt by its rare
#: word; by its rare context, before a head word; before a rare word
DOCUMENT, HEADS, RARE_WORD, RARE_CONTEXT, RARE_BOTH = range(5)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): 64-bit hashes of words and how often they occur."""
    def count(batches):
        for b in batches:
            parts = [word_hashes((v.as_py() or "").lower()) for v in b.column(0)]
            h, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Sorted hashes of the head words, their ids by falling frequency, and the
    counts by id. Other words have their hash with the sign bit set for an id,
    or, in a closed vocabulary, are unknown."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, texts: int, closed: bool, backoff: float):
        by_count = np.lexsort((words, -counts))
        ids = np.empty(len(words), np.int64)
        ids[by_count] = np.arange(len(words)) + 2
        order = np.argsort(words)
        self.words, self.ids = words[order], ids[order]
        counts = np.concatenate([[max(total - int(counts.sum()), 1), max(texts, 1)], counts[by_count]])
        self.logs = np.log10(counts)
        self.closed = closed
        #: what the logarithm of a word's count is raised by when it is backed off to
        self.own = np.log10(backoff / max(total, 1))

    def encode(self, h: np.ndarray) -> np.ndarray:
        rare = np.full(len(h), UNKNOWN) if self.closed else (h | np.uint64(1 << 63)).view(np.int64)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.ids[at], rare)

    def occurrences(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, context and word of each word of at most CHUNK texts, the
        texts' lengths, and the ids of the rare words, which are numbered
        behind the head here. The first word's context is the start."""
        hashes = [word_hashes((t or "").lower()) for t in texts]
        lengths = np.array([len(h) for h in hashes], np.int64)
        word = self.encode(np.concatenate(hashes))
        rare = word < 0
        names, place = np.unique(word[rare], return_inverse=True)
        word[rare] = len(self.logs) + place
        if len(self.logs) + len(names) >= 1 << BITS:
            raise ValueError("too many words for one chunk of texts")
        context = np.concatenate([[START], word[:-1]])[:len(word)]
        context[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
        return np.repeat(np.arange(len(texts)), lengths), context, word, lengths, names

    def name(self, number: np.ndarray, names: np.ndarray) -> np.ndarray:
        out, rare = number.copy(), number >= len(self.logs)
        out[rare] = names[number[rare] - len(self.logs)]
        return out

    def log(self, ids: np.ndarray) -> np.ndarray:
        """Logarithm of the count of head words, 0 for others."""
        return np.where(ids >= 0, self.logs[np.maximum(ids, 0)], 0.0)


def _others(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each row's bigram occurs in the other rows."""
    kinds, place = np.unique(gram, return_inverse=True)
    return np.bincount(place, weights=n, minlength=len(kinds)).astype(np.int64)[place] - n


def _pair(dealt: np.ndarray, mate: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(dealt.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mix(mate.view(np.uint64)))


def _score(n, others, context, own):
    """n times the logarithm of the score, from the logarithms of the
    context's count and of the score backed off to."""
    return n * np.where(others > 0, np.log10(np.maximum(others, 1)) - context, own)


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: float = 0.0,
                   backoff: float = 0.4, frequent: float = 1e-6) -> DataFrame:
    """One row per row of ``docs``: id, n_words, log10_sum (over all words) and
    log10_mean (null without words).

    A word scores log10 of its bigram's count over its context's, or, where the
    bigram occurs in no other document, of ``backoff`` times its own count over
    all words. Words are runs of characters other than white space in lower
    case. A null or empty text has no words and sum 0; rows that repeat are
    documents of their own, so copies support one another; an empty table gives
    no rows; other columns are ignored.

    ``frequent`` has no part in the result: words of that share are broadcast.
    Only a caller who sets ``rarest`` above 0 has all words below that share
    counted as one unknown word; the others are broadcast then."""
    scan = numbered(docs, id=F.col(id_col), text=F.col(text_col))
    spark = docs.sparkSession
    counts = materialize(word_counts(scan), "lm-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    texts = scan.filter(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).count()
    # at most 1 / share rows: each holds that share of all words
    known = counts.filter(F.col("n") >= F.lit((rarest or frequent) * total)).toPandas()
    sent = spark.sparkContext.broadcast(Vocabulary(
        known["word"].to_numpy(np.int64).view(np.uint64), known["n"].to_numpy(np.int64), total, texts, rarest > 0,
        backoff))

    def count_frequent(batches):
        vocabulary = sent.value
        table = np.zeros(FREQUENT * FREQUENT, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                _, context, word, _, _ = vocabulary.occurrences(b.column(0).slice(lo, CHUNK).to_pylist())
                hot = (context < FREQUENT) & (word < FREQUENT)
                hot &= np.maximum(context, word) < len(vocabulary.logs)
                table += np.bincount(context[hot] * FREQUENT + word[hot], minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["place", "n"])

    # at most FREQUENT**2 rows
    pairs = scan.select("text").mapInArrow(count_frequent, "place long, n long") \
        .groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(FREQUENT * FREQUENT, np.int64)
    table[pairs["place"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    hot_counts = spark.sparkContext.broadcast(table)

    def explode(batches):
        # rows of bigrams, and one row per document: its words in n and the sum
        # over its most frequent bigrams in rest
        vocabulary, table = sent.value, hot_counts.value
        low = (1 << BITS) - 1
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                key = b.column(0).slice(lo, CHUNK).to_numpy()
                doc, context, word, lengths, names = vocabulary.occurrences(b.column(1).slice(lo, CHUNK).to_pylist())
                grams, n = np.unique((doc << 2 * BITS) | (context << BITS) | word, return_counts=True)
                doc, c, w = grams >> 2 * BITS, vocabulary.name((grams >> BITS) & low, names), \
                    vocabulary.name(grams & low, names)
                hot = (c >= 0) & (w >= 0) & (c < FREQUENT) & (w < FREQUENT)
                own = vocabulary.own + vocabulary.log(w[hot])
                others = table[c[hot] * FREQUENT + w[hot]] - n[hot]
                first = np.bincount(doc[hot], _score(n[hot], others, vocabulary.log(c[hot]), own), len(key))
                rows = [(DOCUMENT, key, key, np.zeros(len(key), np.int64), lengths, first)]
                for kind, at in ((HEADS, (c >= 0) & (w >= 0) & ~hot), (RARE_WORD, w < 0),
                                 (RARE_CONTEXT, (c < 0) & (w >= 0)), (RARE_BOTH, (c < 0) & (w < 0))):
                    at = np.flatnonzero(at)
                    deal, mate = {HEADS: ((c[at] << 32) | w[at], np.zeros(len(at), np.int64)),
                                  RARE_WORD: (w[at], c[at])}.get(kind, (c[at], w[at]))
                    rows.append((kind, key[doc[at]], deal, mate, n[at], np.zeros(len(at))))
                kinds = np.repeat(np.array([r[0] for r in rows], np.int8), [len(r[1]) for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds), *[pa.array(np.concatenate(x)) for x in list(zip(*rows))[1:]]],
                    names=["kind", "row_key", "deal", "mate", "n", "rest"])

    rows = scan.select("row_key", "text").mapInArrow(
        explode, "kind byte, row_key long, deal long, mate long, n long, rest double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "deal")

    def add_up(batches):
        # one part of the count tables: its bigrams' and rare words' counts,
        # joined to the rows of the same part
        vocabulary = sent.value
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if not got:
            return
        kind, key, deal, mate, n, rest = (np.concatenate(x) for x in zip(*got))
        del got
        value = np.zeros(len(kind))
        at = np.flatnonzero(kind == DOCUMENT)
        value[at] = rest[at]
        words = np.where(kind == DOCUMENT, n, 0)
        at = np.flatnonzero(kind == HEADS)
        g, m = deal[at], n[at]
        value[at] = _score(m, _others(g, m), vocabulary.log(g >> 32), vocabulary.own + vocabulary.log(g & 0xFFFFFFFF))
        # each occurrence of a rare word is in one row dealt by it as the word
        at = np.flatnonzero(kind == RARE_WORD)
        word, context, m = deal[at], mate[at], n[at]
        rare, place = np.unique(word, return_inverse=True)
        logs = np.log10(np.maximum(np.bincount(place, weights=m, minlength=len(rare)), 1))
        value[at] = _score(m, _others(_pair(word, context), m), vocabulary.log(context), vocabulary.own + logs[place])
        # a rare context is a word elsewhere in its text, so it is among them;
        # before a rare word the rest is in the row dealt by that word
        at = np.flatnonzero(kind >= RARE_CONTEXT)
        context, word, m = deal[at], mate[at], n[at]
        if len(at):
            others, log = _others(_pair(context, word), m), logs[np.searchsorted(rare, context)]
            value[at] = np.where(word >= 0, _score(m, others, log, vocabulary.own + vocabulary.log(word)),
                                 np.where(others > 0, -m * log, 0.0))
        for lo in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + 100_000]) for x in (key, value, words)],
                                             names=["row_key", "part", "words"])

    summed = dealt.mapInArrow(add_up, "row_key long, part double, words long") \
        .groupBy("row_key").agg(F.sum("part").alias("log10_sum"), F.sum("words").alias("n_words"))
    return scan.select("row_key", "id").join(summed, "row_key").select(
        F.col("id").alias(id_col), "n_words", "log10_sum",
        F.try_divide(F.col("log10_sum"), F.col("n_words")).alias("log10_mean"))

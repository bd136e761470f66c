"""Toxicity by a subsequence string kernel and Nystroem landmarks.

The gap-weighted subsequence kernel of two strings counts their common
subsequences of ``n`` characters, each weighed by ``decay`` to the length it
spans in both, so it still sees an insult with characters put in or letters
spread out. A sentence is mapped to its largest normalised kernel value with
each of a fixed number of landmark words taken from labelled sentences; a
linear support vector machine on the Nystroem features of that map scores it,
and a document's score is that of its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: letters of a unit that the kernel compares; longer words are cut into
#: overlapping units
UNIT = 14
#: kernel values below this count as none, so most words need no further work
FLOOR = 0.25
#: entries of each of the two generations of a worker's cache of words
REMEMBERED = 300_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_LETTERS = re.compile(r"[^\W\d_]+")


def bare(word: str) -> str:
    return "".join(_LETTERS.findall(word.lower()))


def cut(word: str) -> list[str]:
    if len(word) <= UNIT:
        return [word]
    return [word[i:i + UNIT] for i in range(0, len(word) - UNIT // 2, UNIT // 2)]


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence; three or more single letters in a row are
    one word."""
    out = []
    for s in _SENTENCE.split(text or ""):
        words = s.split()
        if sum(len(w) == 1 for w in words) > 2:
            joined, run = [], []
            for w in [*words, ""]:
                if len(w) == 1 and w.isalpha():
                    run.append(w)
                    continue
                joined += ["".join(run)] if len(run) > 2 else run
                run = []
                joined += [w] if w else []
            words = joined
        if words:
            out.append(words)
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, padded with zeros."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(len(words), width)


def _from_matches(same: np.ndarray, n: int, decay: float) -> np.ndarray:
    """The kernel's recursion for many pairs at once: ``same`` has the places
    of the two strings first and the pair last. ``ends`` holds the weight of
    the common subsequences that end at both places."""
    rows, cols = same.shape[:2]
    ends = same * np.float32(decay * decay)
    for _ in range(n - 1):
        down = np.zeros_like(ends)
        for i in range(1, rows):
            down[i] = (down[i - 1] + ends[i - 1]) * np.float32(decay)
        both = np.zeros_like(ends)
        for j in range(1, cols):
            both[:, j] = (both[:, j - 1] + down[:, j - 1]) * np.float32(decay)
        ends = same * both
    return ends.sum(axis=(0, 1))


def subsequence_kernel(a: list[str], b: list[str], n: int, decay: float) -> np.ndarray:
    """Kernel of every string of ``a`` with every one of ``b``."""
    x = np.ascontiguousarray(_codes(a, max(map(len, a))).T)
    y = np.ascontiguousarray(_codes(b, max(map(len, b))).T)
    same = (x[:, None, :, None] == y[None, :, None, :]) & (x != 0)[:, None, :, None]
    k = _from_matches(same.reshape(len(x), len(y), -1).astype(np.float32), n, decay)
    return k.reshape(len(a), len(b))


class Kernel(NamedTuple):
    n: int = 3
    decay: float = 0.6

    def own(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with itself."""
        x = np.ascontiguousarray(_codes(words, max(map(len, words))).T)
        same = (x[:, None] == x[None]) & (x != 0)[:, None]
        return _from_matches(same.astype(np.float32), self.n, self.decay)

    def to(self, words: list[str], landmarks: list[str], marks_own: np.ndarray) -> np.ndarray:
        """Normalised kernel of words with landmarks."""
        return Expansion(self, landmarks, marks_own).values(words)


class Expansion:
    """The kernel's explicit feature map, cut down to the landmarks' letters:
    a table of the weights that each subsequence of ``n`` letters has in each
    landmark. A word's kernel values are the sum over its own subsequences; as
    few of those occur in a landmark, this is much less work than the recursion
    over all pairs, with the same result."""

    def __init__(self, kernel: Kernel, landmarks: list[str], marks_own: np.ndarray):
        self.kernel, self.marks_own = kernel, marks_own
        self.letters = np.array(sorted({ord(c) for m in landmarks for c in m}), np.uint32)
        self.base = len(self.letters) + 1
        self.table = np.zeros((self.base ** kernel.n, len(landmarks)), np.float32)
        self._places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, m in enumerate(landmarks):
            if len(m) >= kernel.n:
                at, weight = self._subsequences(_codes([m], len(m)))
                np.add.at(self.table[:, k], at[0], weight)
        self.present = self.table.any(axis=1)

    def _subsequences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = codes.shape[1]
        if length not in self._places:
            places = np.array(list(combinations(range(length), self.kernel.n)))
            span = places[:, -1] - places[:, 0] + 1
            self._places[length] = places, (self.kernel.decay ** span).astype(np.float32)
        places, weight = self._places[length]
        near = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letter = np.where(self.letters[near] == codes, near + 1, 0)
        at = np.zeros((len(codes), len(places)), np.int64)
        for k in range(self.kernel.n):
            at = at * self.base + letter[:, places[:, k]]
        return at, weight

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.marks_own)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= self.kernel.n:
                by_length.setdefault(len(w), []).append(i)
        for length, all_of in by_length.items():
            for lo in range(0, len(all_of), 1024):
                some = all_of[lo:lo + 1024]
                at, weight = self._subsequences(_codes([words[i] for i in some], length))
                row, col = np.nonzero(self.present[at])
                if not len(row):
                    continue
                first = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
                sums = np.add.reduceat(self.table[at[row, col]] * weight[col][:, None], first)
                hit = [some[r] for r in row[first]]
                own = self.kernel.own([words[i] for i in hit])
                out[hit] = sums / np.sqrt(own[:, None] * self.marks_own[None, :])
        return out


class Model(NamedTuple):
    kernel: Kernel
    landmarks: list[str]
    marks_own: np.ndarray
    weights: np.ndarray  # of the kernel values: the Nystroem map is folded in
    offset: float
    slope: float
    shift: float


class Scorer:
    """Worst sentence's margin of a text; remembers words. Words whose kernel
    values all lie below the floor add nothing and get no vector."""

    def __init__(self, model: Model):
        self.model = model
        self.expansion = Expansion(model.kernel, model.landmarks, model.marks_own)
        self.known: dict[str, np.ndarray | None] = {}
        self.older: dict[str, np.ndarray | None] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = []
        for w in words.difference(self.known):
            if w in self.older:
                self.known[w] = self.older[w]
            else:
                new.append(w)
        cuts = [(w, u) for w in new for u in cut(bare(w)) if len(u) >= self.model.kernel.n]
        self.known.update(dict.fromkeys(new))
        if cuts:
            forms = sorted({u for _, u in cuts})
            place = {u: i for i, u in enumerate(forms)}
            values = self.expansion.values(forms)
            values[values < FLOOR] = 0
            some = values.any(axis=1)
            for w, u in cuts:
                i = place[u]
                if some[i]:
                    had = self.known[w]
                    self.known[w] = values[i].copy() if had is None else np.maximum(had, values[i])

    def vectors(self, text: str | None) -> np.ndarray:
        """One row per sentence with a word above the floor, and a row of
        zeros for all others."""
        sents = sentences(text)
        self.learn({w for s in sents for w in s})
        return self._rows(sents)

    def _rows(self, sents: list[list[str]]) -> np.ndarray:
        rows = [np.zeros(len(self.model.landmarks), np.float32)]
        known = self.known
        for s in sents:
            some = [v for v in map(known.__getitem__, s) if v is not None]
            if some:
                rows.append(np.max(some, axis=0) if len(some) > 1 else some[0])
        return np.stack(rows)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of texts; the words of some hundred texts are learned at once."""
        out = []
        for lo in range(0, len(texts), 200):
            split = [sentences(t) for t in texts[lo:lo + 200]]
            self.learn({w for sents in split for s in sents for w in s})
            for sents in split:
                margin = float((self._rows(sents) @ self.model.weights).max() + self.model.offset)
                z = self.model.slope * margin + self.model.shift
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def choose_landmarks(docs: list[tuple[str, int]], kernel: Kernel, telling: int, common: int) -> tuple[list[str], list[str]]:
    """Words by which the labelled sentences' classes differ most, no two much
    alike, and the most common other words as a contrast."""
    seen = {0: Counter(), 1: Counter()}
    size = Counter(label for _, label in docs)
    for text, label in docs:
        seen[label].update({u for s in sentences(text) for w in s for u in cut(bare(w)) if len(u) >= kernel.n})
    p = {w: (seen[1][w] + 0.5) / (size[1] + 1) for w in seen[1]}
    q = {w: (seen[0][w] + 0.5) / (size[0] + 1) for w in seen[1]}
    # signed share of the deviance: common in one class and rare in the other
    rank = sorted(p, key=lambda w: (-(p[w] * np.log(p[w] / q[w])), w))
    chosen: list[str] = []
    for w in rank[:30 * telling]:
        if len(chosen) == telling:
            break
        if p[w] <= q[w]:
            break
        if not chosen or kernel.to([w], chosen, kernel.own(chosen)).max() < 0.6:
            chosen.append(w)
    others = sorted((w for w in seen[0] if w not in chosen), key=lambda w: (-seen[0][w], w))
    return chosen, others[:common]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps
    on the rows inside the margin; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    inside = np.ones(len(x), bool)
    for _ in range(rounds):
        c = cost[inside][:, None]
        w = np.linalg.solve(np.diag(penalty) + x[inside].T @ (c * x[inside]), x[inside].T @ (c[:, 0] * y[inside]))
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def fit(docs: list[tuple[str, int]], kernel: Kernel = Kernel(), telling: int = 40, common: int = 8) -> Model | None:
    """Train on (text, label) pairs; None without both labels or any word."""
    if len({label for _, label in docs}) < 2:
        return None
    chosen, others = choose_landmarks(docs, kernel, telling, common)
    marks = chosen + others
    if not marks:
        return None
    own = kernel.own(marks)
    gram = kernel.to(marks, marks, own).astype(np.float64)
    val, vec = np.linalg.eigh((gram + gram.T) / 2)
    keep = val > 1e-6
    root = (vec[:, keep] / np.sqrt(val[keep])) @ vec[:, keep].T
    scorer = Scorer(Model(kernel, marks, own, np.zeros(len(marks)), 0.0, 1.0, 0.0))
    for lo in range(0, len(docs), 500):
        scorer.learn({w for t, _ in docs[lo:lo + 500] for s in sentences(t) for w in s})
    bags = [scorer.vectors(t) @ root for t, _ in docs]
    label = np.array([2 * y - 1 for _, y in docs], float)
    # the worst sentence stands for its document: first the one with the most
    # kernel mass on telling words, then the one the machine finds worst
    n_tell = len(chosen) or len(marks)
    pick = [int((b @ np.linalg.pinv(root))[:, :n_tell].max(axis=1).argmax()) for b in bags]
    cost = np.where(label > 0, len(label) / (2 * (label > 0).sum()), len(label) / (2 * (label < 0).sum()))
    w = np.zeros(len(marks) + 1)
    for _ in range(4):
        w = fit_svm(np.stack([b[i] for b, i in zip(bags, pick)]), label, cost)
        pick = [int((b @ w[:-1]).argmax()) for b in bags]
    margin = np.array([(b @ w[:-1]).max() + w[-1] for b in bags])
    # Platt's sigmoid by Newton steps, with his smoothed targets
    pos, neg = (label > 0).sum(), (label < 0).sum()
    t = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    z = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        step = np.linalg.solve(z.T @ ((p * (1 - p))[:, None] * z) + 1e-6 * np.eye(2), z.T @ (p - t))
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(kernel, marks, own, root @ w[:-1], float(w[-1]), float(ab[0]), float(ab[1]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, most_chars: int, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """At most ``most`` labelled documents of each class with at most
    ``most_chars`` characters, in the order of a hash of the id, as (text,
    label). Held-out ids (CRC-32 of the id as text is 1 modulo 3) and null ids
    take no part."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    marked = marked.filter(~held_out("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .filter(F.col("text").isNotNull() & (F.char_length("text") <= most_chars))
    size = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    # a little more than the sample by share of the hash, then cut in its order
    rate = F.lit(0.0)
    for k, n in sorted(size.items()):
        rate = F.when(F.col("label") == k, F.lit(min(1.0, 1.2 * most / n + 0.001))).otherwise(rate)
    picked = rows.join(marked.filter(share < rate), "id")
    out = []
    for k in sorted(size):
        got = picked.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id", F.md5("text")).limit(most)
        out += [(r["text"], k) for r in got.select("text").collect()]
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", most: int = 1200, most_chars: int = 20_000,
                    cut_at: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1) and predicted
    (1 from ``cut_at`` on).

    Trained on at most ``most`` labelled documents of each class of at most
    ``most_chars`` characters (see training_rows), on the driver; scoring reads
    every text whole, with no shuffle. The score follows from the text alone. A
    null or empty text, or one of words below the kernel's floor, gets the
    score of a sentence without any; without labels of both classes every score
    is 0. Rows that repeat are scored each; an empty table gives no rows; other
    columns are ignored."""
    model = fit(training_rows(docs, labels, most, most_chars, id_col, text_col, label_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        scorer = None if sent.value is None else _scorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([0.0] * b.num_rows if scorer is None else
                          [z for lo in range(0, b.num_rows, 200) for z in scorer.scores(b.column(2).slice(lo, 200).to_pylist())],
                          pa.float64())],
                names=["id", "held_out", "score"])

    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")) \
        .mapInArrow(score, f"id {id_type}, held_out boolean, score double") \
        .select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of this model; its cache outlives a task."""
    key = repr((model.landmarks, model.weights.tobytes()))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]

"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows are edited (Keep, Rerole to user or assistant, Delete,
Insert of an empty turn) until the roles read ``(s?(ua)+)?``. What has been
read so far is one of four states; a row turns a vector of four costs into the
next. Forward costs from the start and backward costs from the end meet at the
middle row; the crossing with the least cost, then the least audit, splits the
problem into two halves, so memory stays linear.

Audits are compared without being stored: inserts are written before the edit
of the row that follows them, so a row's letters form a prefix-free code, and
two audits compare as their first differing row does. The forward pass keeps
the order of the four states' audits beside their costs.

Rows are put into conversation order once, over range partitions with about
as many rows each; a conversation cut by their ends is solved in segments. A
segment is a 4 x 4 matrix of costs (and orders); a walk over the segments of a
conversation fixes the states at the cuts, and then each is solved by itself.
So a conversation with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_facts, materialize

#: states: nothing yet, after the system turn, after a user, after an assistant
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 50
#: the state after a user or an assistant turn from each state (None: not allowed)
AFTER_USER = (USER, USER, None, USER)
AFTER_ASSISTANT = (None, None, ASSISTANT, None)
RANGE_ROWS, RANGE_BYTES = 20_000, 16 << 20


def row_kind(initial: str, must_delete: bool, truncated: bool) -> int:
    """A row as the solver sees it: 0 to 15."""
    return ("sua".find(initial) + 1 if initial else 0) * 4 + 2 * must_delete + truncated


@lru_cache(maxsize=None)
def inserts(state: int) -> tuple[tuple[int, int], ...]:
    """(state, number) reached by inserting 0 to 2 turns; more never pay."""
    out = [(state, 0)]
    for n in (1, 2):
        s = out[-1][0]
        out.append((AFTER_USER[s] if AFTER_USER[s] is not None else AFTER_ASSISTANT[s], n))
    return tuple(out)


@lru_cache(maxsize=None)
def steps(kind: int) -> tuple[tuple[tuple[int, str], ...], ...]:
    """steps(kind)[p][q]: the cheapest, then least (cost, letters) with which
    a row leads from state p to state q."""
    initial, must_delete, truncated = kind // 4, kind // 2 % 2, kind % 2
    best = [[(INF, "")] * 4 for _ in range(4)]
    for p in range(4):
        for s, n in inserts(p):
            options = [(s, 2, "D")]
            if not must_delete:
                stay = 5 * truncated
                kept = (None, SYSTEM if s == START else None, AFTER_USER[s], AFTER_ASSISTANT[s])[initial]
                turned = AFTER_USER[s] if AFTER_USER[s] is not None else AFTER_ASSISTANT[s]
                options += [(kept, stay, "K"), (turned, stay + 1, "R")]
            for q, cost, letter in options:
                if q is not None:
                    best[p][q] = min(best[p][q], (cost + 5 * n, "I" * n + letter))
    return tuple(map(tuple, best))


def ending(state: int) -> int:
    """Turns to insert after the last row."""
    return {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]


ENDINGS = tuple(5 * ending(q) for q in range(4))


def forward(kinds, lo: int, hi: int, start: list[int], order: list[int]) -> tuple[list[int], list[int]]:
    """Costs of the four states after rows lo to hi - 1, and the order of
    their least audits, from those before."""
    for i in range(lo, hi):
        step = steps(kinds[i])
        found = []
        for q in range(4):
            found.append(min((start[p] + step[p][q][0], order[p], step[p][q][1]) for p in range(4)))
        start = [min(f[0], INF) for f in found]
        places = sorted((f[1], f[2]) for f in found)
        order = [places.index((f[1], f[2])) for f in found]
    return start, order


def backward(kinds, lo: int, hi: int, end: list[int]) -> list[int]:
    """Costs from the four states before row lo to the end, from those after
    row hi - 1."""
    for i in range(hi - 1, lo - 1, -1):
        step = steps(kinds[i])
        end = [min(INF, min(step[p][q][0] + end[q] for q in range(4))) for p in range(4)]
    return end


def at(state: int) -> list[int]:
    return [0 if s == state else INF for s in range(4)]


def hirschberg(kinds, enter: int, end: list[int]) -> tuple[list[str], int]:
    """The letters of each row on the cheapest, then least way from state
    ``enter``, with ``end`` the cost of each last state; and that state."""
    letters, last = [""] * len(kinds), enter
    todo = [(0, len(kinds), enter, end)]
    if not kinds:
        return letters, enter
    while todo:
        lo, hi, p, stop = todo.pop()
        middle = (lo + hi + 1) // 2 if hi - lo > 1 else hi
        ahead, order = forward(kinds, lo, middle, at(p), [0, 1, 2, 3])
        behind = backward(kinds, middle, hi, stop)
        q = min(range(4), key=lambda s: (ahead[s] + behind[s], order[s]))
        if hi - lo == 1:
            letters[lo] = steps(kinds[lo])[p][q][1]
            last = q if hi == len(kinds) else last
        else:
            todo += [(lo, middle, p, at(q)), (middle, hi, q, stop)]
    return letters, last


def matrix(kinds) -> tuple[list[int], list[int]]:
    """A segment's costs and orders from each state (16 values each)."""
    cost, order = [], []
    for p in range(4):
        c, o = forward(kinds, 0, len(kinds), at(p), [0, 1, 2, 3])
        cost += c
        order += o
    return cost, order


def crossings(costs, orders) -> list[int]:
    """The states at the cuts between segments (first START, last the end)."""
    behind = [list(ENDINGS)]
    for c in reversed(costs):
        behind.append([min(INF, min(c[4 * p + q] + behind[-1][q] for q in range(4))) for p in range(4)])
    behind.reverse()
    states = [START]
    for k, (c, o) in enumerate(zip(costs, orders)):
        p = states[-1]
        states.append(min(range(4), key=lambda q: (c[4 * p + q] + behind[k + 1][q], o[4 * p + q])))
    return states


def edited(letters, last: int, state: int, roles, texts):
    """Turns (row, place, edit, role, text) of the edited rows; deleted rows
    have a null role. Inserted turns have the row they precede; those after
    the last row have its number."""
    out = []

    def put(row, letter, role, text):
        out.append((row, len(out), letter, role, text))

    for i, code in enumerate(letters):
        for c in code:
            if c == "D":
                put(i, c, None, None)
                continue
            role = roles[i]
            if c == "K" and role[:1] == "s":
                state = SYSTEM
            elif AFTER_USER[state] is not None:
                state, role = USER, role if c == "K" else "user"
            else:
                state, role = ASSISTANT, role if c == "K" else "assistant"
            put(i, c, role, "" if c == "I" else texts[i])
    for _ in range(ending(state) if last else 0):
        new = USER if AFTER_USER[state] is not None else ASSISTANT
        put(len(letters) - 1, "I", "user" if new == USER else "assistant", "")
        state = new
    return out


def damage(turns: DataFrame) -> DataFrame:
    """The stated damage to rows (conv_id, turn, role, text), a null role or
    text read as one space: by crc32 of ``conv_id:turn`` (null: a space)
    modulo 20, 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3
    repeats it and 4 makes it the user's."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    rows = turns.withColumns({"role": said("role"), "text": said("text"), "__kind": kind}).filter("__kind != 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")) \
        .otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__copy", F.explode(copies)).drop("__kind", "__copy")


def _key() -> Column:
    """A conversation's name that is never null."""
    return F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in conversation order: key, conv_id, turn, role, text, seg (the
    range partition) and seq (rises with the order); written."""
    rows = materialize(rows.select(
        _key().alias("key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text")), "turns-read")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(size["n"] // RANGE_ROWS, (size["b"] or 0) // RANGE_BYTES) + 1
    # rows equal in all of these are cut anywhere
    order = ["key", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "tie") \
        .sortWithinPartitions(*order) \
        .withColumns({"seg": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}).drop("tie")
    return materialize(rows, "turns-ordered")


def faults(ordered: DataFrame) -> DataFrame:
    """``ordered`` with initial, fault (blank, duplicate, truncated or null:
    the first that holds) and kind."""
    body = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    marked = ordered.withColumns({
        "said": F.sha2(F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256),
        "blank": body == "", "cut": ~F.substring(body, -1, 1).isin(".", "!", "?")})
    small = materialize(marked.drop("text"), "turns-said")
    total = small.count()
    first = materialize(small.groupBy("key", "said").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1"), "turns-again")
    named = attach_facts(small.select("key", "said", "seq"), first, ["key", "said"], "n", total)
    again = materialize(named.filter("first_seq < seq").select("seq"), "turns-duplicate")
    duplicate = F.col("again").isNotNull()
    flags = small.drop("said").join(again.withColumn("again", F.lit(True)), "seq", "left").withColumn(
        "fault", F.when(F.col("blank"), "blank").when(duplicate, "duplicate").when(F.col("cut"), "truncated"))
    initial = F.substring("role", 1, 1)
    kind = F.lit(0)
    for place, letter in ((1, "s"), (2, "u"), (3, "a")):
        kind = kind + F.when(initial == letter, 4 * place).otherwise(0)
    kind += F.when(F.col("fault").isin("blank", "duplicate"), 2).otherwise(0)
    kind += F.when(F.col("fault") == "truncated", 1).otherwise(0)
    return flags.select("key", "conv_id", "turn", "seg", "seq", "role", initial.alias("initial"), "fault", kind.cast("int").alias("kind"))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Repair conversations; both results are written tables.

    ``turns`` is taken by conversation in the order of turn, nulls first; rows
    that share a turn come by role, the text's first 64 characters and a hash
    of the text. A null role or text is read as a
    space; rows with a null conversation form one conversation; repeated rows
    are duplicates; an empty table gives no rows; other columns are ignored.
    Faults: blank (no text besides white space), else duplicate (role and text
    of an earlier row), else truncated (last character not ``[.!?]``).

    Edits: Keep 0, Rerole 1, Delete 2 (required for blank and duplicate
    rows), Insert 5; a truncated row that stays costs 5 more. Of the cheapest
    edits that make the roles' initials ``(s?(ua)+)?`` those whose letters are
    least in ASCII order are chosen.

    First result, one row for each edit: key, seq, place (order within a
    segment), edit, role, text (null for a deleted row). Second, one for each
    conversation and segment of it: key, conv_id, seg, rows, cost, blank,
    duplicate, truncated, illegal (pairs within the segment), first_initial,
    last_initial.

    A task holds one range partition (20,000 rows or 16 MB of text, or one
    text that is longer)."""
    ordered = _ordered(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                                    F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    flags = materialize(faults(ordered), "turns-flags")
    # conversations that a range ends in: at most one for each range
    spread = flags.groupBy("key").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).filter("a != b").select("key")
    spread = materialize(spread, "turns-spread")

    def summarise(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("seq")
        cost, order = matrix(run["kind"].tolist())
        return pd.DataFrame({"key": run["key"].iloc[:1], "seg": run["seg"].iloc[:1], "cost": [cost], "order": [order]})

    def walk(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("seg")
        states = crossings(run["cost"].tolist(), run["order"].tolist())
        return pd.DataFrame({"key": run["key"], "seg": run["seg"], "enter": states[:-1], "leave": states[1:],
                             "is_last": [False] * (len(run) - 1) + [True]})

    parts = flags.join(F.broadcast(spread), "key", "left_semi").select("key", "seg", "seq", "kind") \
        .groupBy("key", "seg").applyInPandas(summarise, "key string, seg int, cost array<long>, order array<long>")
    cuts = materialize(parts.groupBy("key").applyInPandas(
        walk, "key string, seg int, enter int, leave int, is_last boolean"), "turns-cuts")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        """The runs of one range partition."""
        group = group.sort_values("seq")
        rows = []
        for key, run in group.groupby("key", sort=False):
            split = run["enter"].notna().iloc[0]
            enter = int(run["enter"].iloc[0]) if split else START
            last = bool(run["is_last"].iloc[0]) if split else True
            end = at(int(run["leave"].iloc[0])) if split else list(ENDINGS)
            letters, _ = hirschberg(run["kind"].tolist(), enter, end)
            seq = run["seq"].tolist()
            rows += [(key, seq[i], place, e, role, text) for i, place, e, role, text
                     in edited(letters, last, enter, run["role"].tolist(), run["text"].tolist())]
        return pd.DataFrame(rows, columns=["key", "seq", "place", "edit", "role", "text"])

    whole = flags.join(F.broadcast(cuts), ["key", "seg"], "left").select("key", "seg", "seq", "kind", "enter", "leave", "is_last") \
        .join(ordered.select("seq", "role", "text"), "seq")
    edits = materialize(whole.groupBy("seg").applyInPandas(
        solve, "key string, seq long, place int, edit string, role string, text string"), "turns-edits")
    in_run = Window.partitionBy("key", "seg").orderBy("seq")
    pair = F.concat(F.lag("initial").over(in_run), "initial")
    weight = F.when(F.col("edit") == "D", 2).when(F.col("edit") == "I", 5).when(F.col("edit") == "R", 1).otherwise(0)
    per_row = edits.groupBy("seq").agg(F.sum(weight).alias("paid"), F.max(F.col("edit").isin("K", "R")).alias("stays"))
    stays = F.when(F.col("stays") & (F.col("fault") == "truncated"), 5).otherwise(0)
    runs = flags.withColumn("pair", pair).join(per_row, "seq").groupBy("key", "seg").agg(
        F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("paid") + stays).alias("cost"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.min_by("initial", "seq").alias("first_initial"), F.max_by("initial", "seq").alias("last_initial"))
    return edits, materialize(runs, "turns-runs")


def conversation_report(turns: DataFrame, edits: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn; rows that
    were lost before the repair included) with its numbers, audit and digest
    of the repaired ``role:text`` lines.

    A digest is serial, so the edits of a conversation pass through one task
    in order, row by row; no more than a batch is held."""
    before = Window.partitionBy("key").orderBy("seg")
    border = F.concat(F.lag("last_initial").over(before), "first_initial")
    totals = runs.withColumn("border", border).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.count_if(F.col("border").isNotNull() & ~F.col("border").isin("su", "ua", "au")))
        .alias("illegal"))

    def digest(batches):
        key, audit, sha, first = None, [], None, True
        for b in batches:
            done = []
            for k, e, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if k != key:
                    if key is not None:
                        done.append((key, "".join(audit), sha.hexdigest()))
                    key, audit, sha, first = k, [], hashlib.sha256(), True
                audit.append(e)
                if e != "D":
                    sha.update((("" if first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    first = False
            yield _batch(done)
        if key is not None:
            yield _batch([(key, "".join(audit), sha.hexdigest())])

    lines = edits.repartition("key").sortWithinPartitions("key", "seq", "place").select("key", "edit", "role", "text")
    digests = lines.mapInArrow(digest, "key string, audit string, repaired_sha256 string")
    all_keys = turns.select("conv_id").distinct().select("conv_id", _key().alias("key"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("cost", "blank", "duplicate", "truncated", "illegal")}
    return all_keys.join(totals, "key", "left").join(digests, "key", "left").select(
        "key", "conv_id", *[v.alias(k) for k, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "audit", "repaired_sha256"])


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """The contract's query: damage ``turns`` (conv_id, turn, role, text),
    repair them and report on every conversation. gaps counts the missing
    turns between a conversation's first and last after the damage, nulls
    ignored."""
    given = turns.select("conv_id", "turn", "role", "text")
    hurt = damage(given)
    edits, runs = repair_conversations(hurt)
    report = conversation_report(given, edits, runs)
    gaps = hurt.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    gaps = gaps.select(_key().alias("key"), "gaps")
    return report.join(gaps, "key", "left").select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", "cost", "audit", "repaired_sha256")

"""Conversation repair against a dynamic programme that stores whole audits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, key string, seq long, kind int"
SPACE = " \t\n\x0b\x0c\r"


def best_edits(rows):
    """(cost, audit, turns) by the definition; rows are (role, text, fault)."""
    def place(state, letter):
        """s from the start only; u after anything but u; a after u."""
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, letter))

    behind = {q: (0, "", ()) if q in ("", "a") else (10 ** 9, "", ()) for q in ("", "s", "u", "a")}

    def with_inserts(now):
        for _ in range(3):
            for q in ("", "s", "u", "a"):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    t = place(q, letter)
                    if t:
                        c, a, turns = now[t]
                        now[q] = min(now[q], (c + 5, "I" + a, ((role, ""),) + turns))
        return now

    behind = with_inserts(behind)
    for role, text, fault in reversed(rows):
        now = {}
        for q in ("", "s", "u", "a"):
            c, a, turns = behind[q]
            options = [(c + 2, "D" + a, turns)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for cost, letter, name, initial in ((0, "K", role, role[:1]), (1, "R", "user", "u"), (1, "R", "assistant", "a")):
                    t = place(q, initial)
                    if t:
                        c, a, turns = behind[t]
                        options.append((c + cost + more, letter + a, ((name, text),) + turns))
            now[q] = min(options)
        behind = with_inserts(now)
    return behind[""]


def reported(rows):
    """The contract's row of each conversation from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        r = "user" if kind == 4 else r
        convs[c] += [(t, r, x)] * (2 if kind == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda a: (a[0] is not None, a[0] or 0, a[1], a[2]))
        seen, marked, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for t, r, x in turns:
            fault = "blank" if not x.strip(SPACE) else "duplicate" if (r, x) in seen else \
                "truncated" if x.rstrip(SPACE)[-1] not in ".!?" else None
            seen.add((r, x))
            marked.append((r, x, fault))
            if fault:
                counts[fault] += 1
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = best_edits(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def table(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            text = rng.choice(["a.", "b?", "c", "", " \n", "d!", "a.", f"x{rng.random()}."])
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), text))
    return rows + [(None, 1, "user", "hi."), (None, None, None, None), (None, None, "assistant", "yo."), (7, None, "user", "x."),
                   (convs, 0, "user", "long " * 300_000 + "."), (convs, 1, "assistant", "é" * 1_000_000), (convs + 1, 3, "user", "q."),
                   (convs + 1, 3, "user", "q."), (convs + 1, 3, "assistant", "q.")]


def as_dict(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def frame(spark, rows):
    """With columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("ranges", [20_000, 37])
def test_against_definition(spark, monkeypatch, ranges):
    from chatspark.llm import conversations
    monkeypatch.setattr(conversations, "RANGE_ROWS", ranges)
    rows = table(random.Random(ranges), 60, 12) + [(1000, t, random.Random(t).choice(["user", "assistant", "tool"]), f"{t % 90}.")
                                                   for t in range(400)]
    assert as_dict(conversations.damaged_and_repaired(frame(spark, rows))) == reported(rows)


def test_empty_table_and_lost_conversations(spark):
    from chatspark.llm.conversations import damaged_and_repaired
    assert damaged_and_repaired(frame(spark, [])).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = as_dict(damaged_and_repaired(frame(spark, [(lost, 0, "user", "a.")])))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_divide_and_conquer_equals_the_programme():
    from chatspark.llm.conversations import ENDINGS, START, edited, hirschberg, row_kind
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice([None, None, None, "blank", "truncated"]))
                for _ in range(rng.randint(0, 25))]
        kinds = [row_kind(r[:1], f == "blank", f == "truncated") for r, _, f in rows]
        letters, _ = hirschberg(kinds, START, list(ENDINGS))
        turns = edited(letters, True, START, [r for r, _, _ in rows], [x for _, x, _ in rows]) if rows else []
        _, audit, repaired = best_edits(rows)
        assert "".join(t[2] for t in turns) == audit
        assert tuple((t[3], t[4]) for t in turns if t[3] is not None) == repaired


def test_query_on_the_given_table(spark):
    from chatspark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op12_hirschberg_repair"](spark, sf)) == reported(rows)

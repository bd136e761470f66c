"""Secret scans over a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams that
every match must contain: an OR of sets of trigrams. One pass over the texts
writes postings for the trigrams of all queries; intersecting the postings
gives the candidates, and only their texts are matched with the expression.
Rules without mandatory trigrams are matched in that first pass over all texts.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as sre
from re import _parser as sre_parse
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered


class Rule(NamedTuple):
    """``group`` of a match must have ``least`` characters or the match is
    dropped; letters match in either case where ``any_case`` (ASCII only)."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


# fixed values: the base rules
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=8, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
]
# end of fixed values

#: spans that the method adds
MORE_RULES = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/=-]+", least=27),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]

#: strings that an expression is followed through at most, before it counts as
#: one without mandatory trigrams
MOST_STRINGS = 64


def mandatory_trigrams(pattern: str) -> list[frozenset[str]]:
    """An OR of sets of trigrams (lower case) of which every match contains
    one set whole; empty if there is no such query."""
    best: list[frozenset[str]] | None = None

    def offer(strings: set[str]) -> None:
        nonlocal best
        sets = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
        if sets and all(sets) and (best is None or min(map(len, sets)) > min(map(len, best))):
            best = sets

    def walk(node) -> set[str] | None:
        """The strings that the node can match, or None if there are too many."""
        run: set[str] | None = {""}
        exact = True
        for op, arg in node:
            part: set[str] | None = None
            if op is sre.LITERAL:
                part = {chr(arg).lower()}
            elif op is sre.SUBPATTERN:
                part = walk(arg[3])
            elif op is sre.BRANCH:
                options = [walk(b) for b in arg[1]]
                part = None if any(o is None for o in options) else set().union(*options)
            elif op is sre.MAX_REPEAT and arg[1] == 1:
                inner = optional(arg[2])
                part = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            if part is None or len(part) * len(run) > MOST_STRINGS:
                offer(run)
                run, exact = {""}, False
                if part is not None and len(part) <= MOST_STRINGS:
                    run = part
            else:
                run = {a + b for a in run for b in part}
        if exact:
            return run
        offer(run)
        return None

    def optional(node) -> set[str] | None:
        """As walk, but what an optional part contains is not mandatory."""
        nonlocal best
        kept = best
        found = walk(node)
        best = kept
        return found

    def top() -> None:
        whole = walk(sre_parse.parse(pattern))
        if whole is not None:
            offer(whole)

    top()
    return best or []


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def matches(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping spans in code points, failing ones dropped."""
    return [m.span() for m in expression.finditer(text) if len(m.group(rule.group)) >= rule.least]


def _faster(rule: Rule) -> Rule:
    """A whole match of one repeated class with a least length needs no look
    at shorter runs: the runs that are long enough are the same."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return rule._replace(pattern=f"{rule.pattern[:-1]}{{{rule.least},}}")
    return rule


SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _span_array(found: list[list[dict]]) -> pa.Array:
    return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])))


def find_secrets(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans (array of start, kind, stop in
    code points, end exclusive, by start, then kind, a rule's place in
    ``rules``) and row_key (the row's number in the scan).

    A null text is empty; null ids and rows that repeat are rows of their own;
    an empty table gives no rows; other columns are ignored.
    All texts are shuffled once to meet the candidates."""
    queries = {k: q for k, r in enumerate(rules) if (q := mandatory_trigrams(r.pattern))}
    grams = sorted({t for q in queries.values() for s in q for t in s})
    free = [k for k in range(len(rules)) if k not in queries]
    id_type = docs.schema[id_col].dataType.simpleString()
    scan = numbered(docs, id=F.col(id_col), text=F.col(text_col))

    def index(batches):
        scans = [(k, _faster(rules[k]), compiled(_faster(rules[k]))) for k in free]
        numbered = list(enumerate(grams))
        for b in batches:
            postings, spans = [], []
            for value in b.column(2):
                text = value.as_py() or ""
                low = text.lower()
                postings.append([n for n, g in numbered if g in low])
                spans.append(sorted(({"start": s, "kind": k, "stop": e} for k, r, x in scans for s, e in matches(r, x, text)),
                                    key=lambda d: (d["start"], d["kind"])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(postings, pa.list_(pa.int32())), _span_array(spans)],
                names=["row_key", "id", "grams", "spans"])

    indexed = materialize(scan.mapInArrow(index, f"row_key long, id {id_type}, grams array<int>, spans {SPANS}"),
                          "secrets-index")
    out = indexed.select("row_key", "id", "spans")
    if queries:
        # the Boolean queries as rows: a clause holds where all its trigrams do
        place = {g: n for n, g in enumerate(grams)}
        clauses = [(k, c, place[g], len(s)) for k, q in queries.items() for c, s in enumerate(q) for g in s]
        clause = docs.sparkSession.createDataFrame(clauses, "kind int, clause int, gram int, need int")
        postings = indexed.select("row_key", F.explode("grams").alias("gram"))
        held = (postings.join(F.broadcast(clause), "gram").groupBy("row_key", "kind", "clause")
                .agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need")).filter("have = need"))
        candidates = held.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))
        verified = candidates.join(scan.select("row_key", "text"), "row_key").select("row_key", "kinds", "text")

        def verify(batches):
            known = {k: (rules[k], compiled(rules[k])) for k in queries}
            for b in batches:
                spans = [[{"start": s, "kind": k, "stop": e} for k in kinds.as_py()
                          for s, e in matches(*known[k], text.as_py() or "")]
                         for kinds, text in zip(b.column(1), b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0), _span_array(spans)], names=["row_key", "more"])

        more = verified.mapInArrow(verify, f"row_key long, more {SPANS}").filter(F.size("more") > 0)
        out = out.join(more, "row_key", "left").withColumn(
            "spans", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(SPANS)))))
    return out.select(F.col("id").alias(id_col), "spans", "row_key")


def span_text(spans: str, kinds: list[str], base: int | None = None):
    """kind:start:stop, comma-joined; of the first ``base`` kinds only if given."""
    names = F.array(*[F.lit(k) for k in kinds])
    chosen = F.col(spans) if base is None else F.filter(spans, lambda s: s["kind"] < base)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def brute_force(text: str | None, rules: list[Rule]) -> list[tuple[int, int, int]]:
    """(start, kind, stop) by matching every rule: the measure for tests."""
    return sorted((s, k, e) for k, r in enumerate(rules) for s, e in matches(r, compiled(r), text or ""))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

"""Quality rules by distribution divergence.

Each document's histogram of character classes and of its language's most
common words is compared to that language's histogram over all documents by
the Jensen-Shannon distance (base 2, 0 to 1). A document that strays too far in
either, and is long enough to tell, is rejected, as is one that fails the base
rules. DataFrame functions only: one pass over the texts writes a narrow table
of counts, from which references and verdicts follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, materialize, scalar_row

# fixed values: the most common words of each language
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on with be as by this are at from".split(),
    "de": "der die und in den von zu das mit sich auf des für ist nicht im dem ein eine als".split(),
    "es": "de la que el en y los se del las por un no con su una es para al lo".split(),
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec".split(),
}
# end of fixed values
#: one slot for each common word and one for all other words
SLOTS = max(map(len, COMMON_WORDS.values())) + 1

#: character classes as the characters that do not belong to them; what is
#: left over (other letters, other signs) is the last class
CLASSES = {
    "lower": r"[^a-z]+", "upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "space": r"[^\x20\x09-\x0D]+",
    "point": r"""[^.,;:!?'"()-]+""", "symbol": r"[^#*$%&|<>@^~=+_{}\[\]\\/]+",
}
N_CLASSES = len(CLASSES) + 1

WINDOW = 8


def _count_left(text: Column, removed: str) -> Column:
    return F.char_length(F.regexp_replace(text, removed, ""))


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in
    the array, the first find included. Windows are compared by 64-bit hash."""
    def covered(hashes: Column) -> Column:
        last = F.size(hashes) - width + 1
        windows = F.transform(F.sequence(F.lit(1), last), lambda i:
                              F.struct(F.xxhash64(F.slice(hashes, i, width)).alias("h"), i.alias("i")))
        return let(F.array_sort(windows), lambda s: let(
            # sorted by hash, so that equal windows are neighbours
            F.array_sort(F.transform(
                F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                         | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"])),
            # each window adds its words up to the start of the next one
            lambda p: F.aggregate(
                F.transform(p, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - i, F.lit(width)))),
                F.lit(0), lambda a, b: a + b)))

    return F.when(F.size(words) >= width + 1, let(F.transform(words, lambda w: F.xxhash64(w)), covered)) \
        .otherwise(F.lit(0)).cast("long")


def _word_slots(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, one slot each, and of all other
    words; null for a language without a list."""
    table = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])

    def count(common: Column) -> Column:
        bare = F.transform(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")))
        return let(F.filter(bare, lambda w: F.array_contains(common, w)), lambda found:
                   F.concat(F.transform(common, lambda c: (F.size(found) - F.size(F.array_remove(found, c))).cast("long")),
                            F.array((F.size(words) - F.size(found)).cast("long"))))

    return F.when(F.element_at(table, lang).isNotNull(), let(F.element_at(table, lang), count))


def measure(text_col: str) -> list[tuple[str, Column]]:
    """The counts of one document as named columns over its text; a null text
    is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    classes = F.array(*[_count_left(text, p).cast("long") for p in CLASSES.values()])
    return [
        ("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
        ("chars", F.char_length(text).cast("long")),
        ("classes", classes),
        ("n_symbols", F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")),
        ("n_dup_lines", let(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != ""),
                            lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    ]


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts (null if either is
    empty)."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def distance(t: Column) -> Column:
        both = F.zip_with(counts, reference, lambda a, b: F.struct(
            F.try_divide(a.cast("double"), t["a"]).alias("p"), F.try_divide(b.cast("double"), t["b"]).alias("q")))
        div = F.aggregate(both, F.lit(0.0), lambda s, x: s + (
            part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)) / 2)
        return F.sqrt(F.greatest(div, F.lit(0.0)))

    return let(F.struct(total(counts).alias("a"), total(reference).alias("b")),
               lambda t: F.when((t["a"] > 0) & (t["b"] > 0), distance(t)))


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] = (),
                     max_class_distance: float = 0.33, max_word_distance: float = 0.31,
                     min_words: int = 20, guard_words: int = 50, guard_word_slots: int = 100,
                     max_repeat_pct: int = 30, reference_words: int = 2000) -> DataFrame:
    """One row per row of ``docs``: the columns ``carry``, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance and kept.

    Base rules: at least ``min_words`` words and at most ``max_repeat_pct``
    percent of them in repeated windows. Guards: distances count from
    ``guard_words`` words on, the word distance, which has more slots to fill,
    from ``guard_word_slots`` words on. References are summed over all documents that
    pass the base rules, then once more over those of them whose characters lie
    within ``max_class_distance`` of that; a language with fewer than ``reference_words`` words
    there is held against the reference of all languages, one without a word
    list by its characters alone. A null or empty text has no words and fails;
    a null language is a language of its own; rows that repeat get the same
    verdict each; an empty table gives no rows."""
    cols = measure(text_col)
    base = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(carry)], F.col(lang_col).alias("lang"),
                       *[c.alias(n) for n, c in cols])
    base = base.select(
        *[f"k{i}" for i in range(len(carry))], "lang", F.size("words").cast("long").alias("n_words"),
        (F.col("chars") - F.element_at("classes", 4)).alias("word_chars"), "n_symbols", "n_dup_lines",
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        F.concat("classes", F.array(F.greatest(F.lit(0).cast("long"), F.col("chars") - reduce(
            lambda a, b: a + b, [F.element_at("classes", i + 1) for i in range(len(CLASSES))])))).alias("classes"),
        _word_slots(F.col("words"), F.col("lang")).alias("slots"))
    base = materialize(base.withColumn("base_failed", (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))), "quality-counts")

    def sums(col: str, n: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(F.col(col), F.lit(i))), F.lit(0)).cast("long") for i in range(n)])

    def held_against(good: DataFrame) -> DataFrame:
        everyone = scalar_row(good.agg(sums("classes", N_CLASSES).alias("c")))
        ref = materialize(good.groupBy("lang").agg(
            F.sum("n_words").alias("w"), sums("classes", N_CLASSES).alias("ref_classes"),
            sums("slots", SLOTS).alias("ref_slots")).filter(F.col("w") >= reference_words), "quality-references")
        anyone = F.array(*[F.lit(x).cast("long") for x in everyone.c])
        out = base.alias("b").join(ref.alias("r"), F.col("b.lang").eqNullSafe(F.col("r.lang")), "left").select(
            "b.*", F.coalesce("ref_classes", anyone).alias("ref_classes"), "ref_slots")
        return (out.withColumn("class_distance", F.when(F.col("n_words") >= guard_words,
                                                        js_distance(F.col("classes"), F.col("ref_classes"))))
                   .withColumn("word_distance", F.when(F.col("n_words") >= guard_word_slots,
                                                       js_distance(F.col("slots"), F.col("ref_slots")))))

    # once against all that pass the base rules, once against those near that
    good = base.filter(~F.col("base_failed"))
    near = held_against(good).filter(~F.col("base_failed") & (
        F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance))
    out = held_against(near.select(*base.columns))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) \
        | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(carry)], "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))

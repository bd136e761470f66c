"""Column -> Column text functions (all JVM-side, inside whole-stage codegen).

The message patterns keep the meaning of the published Python regexes.
Python's ``\\w``, ``\\s`` and ``\\d`` are Unicode-aware while Java's are
ASCII, so those classes are written out as Unicode classes below; every
other part of each pattern is unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes matching Python's str-pattern \w, \s (str.isspace) and \d.
WORD_CHAR = r"[\p{L}\p{N}_]"
_WS_BODY = r"\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CHAR = f"[{_WS_BODY}]"
NOT_SPACE_CHAR = f"[^{_WS_BODY}]"
DIGIT_CHAR = r"\p{Nd}"

# --- Fixed values: message patterns (published form in the comment) -------
# <(a)?:\w+:\d+>
CUSTOM_EMOJI = r"<(a)?:" + WORD_CHAR + r"+:" + DIGIT_CHAR + r"+>"
# https?://... URL pattern; ASCII only, identical in every engine
LINK = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
# <@\!?(\d+)>
MENTION = r"<@\!?(" + DIGIT_CHAR + r"+)>"
# emoji runs over four code-point blocks: faces, symbols, transport, flags
EMOJI_RUN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
# (\:\w+\:|\<[\/\\]?3|[\(\)\\\D|\*\$][\-\^]?[\:\;\=]|[\:\;\=B8][\-\^]?[3DOPp\@\$\*\\\)\(\/\|])(?=\s|[\!\.\?]|$)
EMOTICON = (
    r"(\:" + WORD_CHAR + r"+\:|\<[\/\\]?3|[\(\)\\\P{Nd}|\*\$][\-\^]?[\:\;\=]|[\:\;\=B8][\-\^]?[3DOPp\@\$\*\\\)\(\/\|])"
    r"(?=" + SPACE_CHAR + r"|[\!\.\?]|$)"
)
# ```[\s\S]*?```
CODE_BLOCK = r"```[\s\S]*?```"
# #[^\s]+
HASHTAG = r"#" + NOT_SPACE_CHAR + r"+"
# \b(?:[a-z]*[A-Z][a-z]*(?:[A-Z][a-z]*)?|[A-Z]+(?![a-z]))\b   (\b spelled as look-arounds)
ABBREVIATION = (
    r"(?<!" + WORD_CHAR + r")(?:[a-z]*[A-Z][a-z]*(?:[A-Z][a-z]*)?|[A-Z]+(?![a-z]))(?!" + WORD_CHAR + r")"
)
# \w[^.!?]*[.!?]  and  \w+
SENTENCE = WORD_CHAR + r"[^.!?]*[.!?]"
WORD_RUN = WORD_CHAR + r"+"
# chunk size for long texts handed to labelers
CHUNK_CHARS = 510
# --- end of fixed values ----------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def regex_count(col: Column | str, pattern: str) -> Column:
    """Number of non-overlapping matches (0 for NULL input)."""
    return F.coalesce(F.regexp_count(_c(col), F.lit(pattern)), F.lit(0))


def strip_pattern(col: Column | str, pattern: str) -> Column:
    return F.regexp_replace(_c(col), pattern, "")


def strip_custom_emoji(col: Column | str) -> Column:
    """X01."""
    return strip_pattern(col, CUSTOM_EMOJI)


def strip_urls(col: Column | str) -> Column:
    """X02."""
    return strip_pattern(col, LINK)


def strip_mentions(col: Column | str) -> Column:
    """X03."""
    return strip_pattern(col, MENTION)


def strip_patterns(col: Column | str, patterns: list[str]) -> Column:
    """Fold patterns over the text, in order."""
    return reduce(lambda acc, p: F.regexp_replace(acc, p, ""), patterns, _c(col))


def strip_code_blocks(col: Column | str) -> Column:
    """X22."""
    return strip_pattern(col, CODE_BLOCK)


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), f"^{SPACE_CHAR}+|{SPACE_CHAR}+$", "")


def tokens_ws(col: Column | str) -> Column:
    """Python ``str.split()`` -- whitespace split, no empty tokens."""
    return F.filter(F.split(_c(col), f"{SPACE_CHAR}+"), lambda t: t != F.lit(""))


def count_tokens_ws(col: Column | str) -> Column:
    """The size of :func:`tokens_ws`, without making the tokens."""
    return regex_count(col, NOT_SPACE_CHAR + "+")


def has_token(col: Column | str) -> Column:
    """Whether there is a token (NULL for a null text)."""
    return _c(col).rlike(NOT_SPACE_CHAR)


def count_emoji(col: Column | str) -> Column:
    """Emoji runs."""
    return regex_count(col, EMOJI_RUN)


def count_emoticon(col: Column | str) -> Column:
    """X07."""
    return regex_count(col, EMOTICON)


def count_punct(col: Column | str) -> Column:
    """Characters of the 32 ASCII punctuation marks."""
    c = _c(col)
    return F.coalesce(F.length(c) - F.length(F.regexp_replace(c, r"\p{Punct}", "")), F.lit(0))


def count_links(col: Column | str) -> Column:
    """X09."""
    return regex_count(col, LINK)


def count_code(col: Column | str) -> Column:
    """X10."""
    return regex_count(col, CODE_BLOCK)


def count_abbrev(col: Column | str) -> Column:
    """X11."""
    return regex_count(col, ABBREVIATION)


def count_hashtags(col: Column | str) -> Column:
    """X12."""
    return regex_count(col, HASHTAG)


def sentence_segments(col: Column | str) -> Column:
    """Per piece between terminators [.!?]: does it hold a word character?

    A match of ``\\w[^.!?]*[.!?]`` ends at every terminator whose piece
    (since the previous terminator) holds a word character, so counting
    pieces gives the same number as the regex in linear time; the regex
    itself rescans an unterminated tail from every word character."""
    return F.transform(F.split(_c(col), "[.!?]", -1), lambda s: s.rlike(WORD_CHAR))


def count_sentences(col: Column | str) -> Column:
    """Number of ``\\w[^.!?]*[.!?]`` matches within one text."""
    seg = sentence_segments(col)
    n = F.size(F.filter(seg, lambda b: b)) - F.when(F.element_at(seg, -1), 1).otherwise(0)
    return F.coalesce(n, F.lit(0))


def count_words(col: Column | str) -> Column:
    """Word runs."""
    return regex_count(col, WORD_RUN)


def topic_words(col: Column | str) -> Column:
    """X14 tokens: Unicode words, lower-cased, words of digits only removed."""
    words = F.regexp_extract_all(_c(col), F.lit(WORD_RUN), 0)
    return F.transform(
        F.filter(words, lambda w: ~w.rlike(f"^{DIGIT_CHAR}+$")), lambda w: F.lower(w)
    )


def attachment_length(col: Column | str) -> Column:
    """X16 (length form): character length of the attachments string."""
    return F.coalesce(F.length(_c(col)), F.lit(0))


def attachment_list_size(col: Column | str) -> Column:
    """X16 (list form): comma-list size, 0 when empty."""
    c = _c(col)
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.size(F.split(c, ",")))


def parse_iso_ts(col: Column | str) -> Column:
    """ISO timestamp text -> timestamp (NULL when unparsable)."""
    return F.try_to_timestamp(_c(col))


def split_uid(col: Column | str) -> Column:
    """``name#1234`` -> ``name``."""
    return F.split_part(_c(col), F.lit("#"), F.lit(1))


def truncate_words(col: Column | str, n: int) -> Column:
    """First n whitespace tokens joined by one space."""
    return F.concat_ws(" ", F.slice(tokens_ws(col), 1, n))


def chunks(col: Column | str, size: int = CHUNK_CHARS) -> Column:
    """X05 helper: the text cut into ``size``-character pieces (array)."""
    c = _c(col)
    n = F.greatest(F.length(c) - 1, F.lit(0)).cast("long") / F.lit(size)
    last = F.floor(n).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(c, i * size + 1, F.lit(size)))


def topic_terms(col: Column | str) -> Column:
    """Topic words without English stop words, words containing a
    deny-substring, and the exact word ``com``."""
    from .lexicons import DENY_EXACT, DENY_SUBSTRINGS, ENGLISH_STOP_WORDS

    def keep(w: Column) -> Column:
        cond = ~w.isin(*ENGLISH_STOP_WORDS) & ~w.isin(*DENY_EXACT)
        for s in DENY_SUBSTRINGS:
            cond = cond & ~w.contains(s)
        return cond

    return F.filter(topic_words(col), keep)

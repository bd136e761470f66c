"""DuckDB (RE2) spellings of the message patterns, for oracle texts.

RE2 has no look-around, so the emoticon and abbreviation counts are
rewritten (see the functions below); all other patterns are the same
meaning as the Spark ones, with Unicode classes written out."""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"
WS_BODY = r"\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_BODY}]"
NWS = f"[^{WS_BODY}]"
CUSTOM_EMOJI = r"<(a)?:" + W + r"+:\p{Nd}+>"
LINK = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
MENTION = r"<@\!?(\p{Nd}+)>"
EMOJI_RUN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
EMOTICON_CORE = (r"(?:\:" + W + r"+\:|<[/\\]?3|[()\\\P{Nd}|*$][-^]?[:;=]|[:;=B8][-^]?[3DOPp@$*\\)(/|])")
CODE_BLOCK = r"```[\s\S]*?```"
HASHTAG = "#" + NWS + "+"
ABBREV_WORD = r"[a-z]*[A-Z][a-z]*(?:[A-Z][a-z]*)?|[A-Z]+"
SENTENCE = W + r"[^.!?]*[.!?]"
WORD_RUN = W + "+"
PUNCT = r"[!-/:-@\[-`{-~]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {q(WS + '+')}), lambda t: t <> '')"


def n_tokens(expr: str) -> str:
    return f"len({tokens(expr)})"


def n_emoticons(expr: str) -> str:
    sep = f"[{WS_BODY}!.?]"
    doubled = f"regexp_replace({expr}, {q('(' + sep + ')')}, '\\1\\1', 'g')"
    return count(doubled, EMOTICON_CORE + f"(?:{sep}|$)")


def n_abbrev(expr: str) -> str:
    return (f"len(list_filter(regexp_extract_all({expr}, {q(WORD_RUN)}), "
            f"lambda w: regexp_full_match(w, {q(ABBREV_WORD)})))")


def n_punct(expr: str) -> str:
    return f"(length({expr}) - length(regexp_replace({expr}, {q(PUNCT)}, '', 'g')))"


def strip(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, '', 'g')"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"

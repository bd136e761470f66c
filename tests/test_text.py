"""Text functions against the published Python patterns (Python ``re``
semantics are the specification)."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from chatspark.functions import text as T

# The published message patterns in Python syntax (the spec).
PY_EMOJI = re.compile("[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E0-\U0001F1FF]+")
PY_EMOTICON = re.compile(r"(\:\w+\:|\<[\/\\]?3|[\(\)\\\D|\*\$][\-\^]?[\:\;\=]|[\:\;\=B8][\-\^]?[3DOPp\@\$\*\\\)\(\/\|])(?=\s|[\!\.\?]|$)")
PY_LINK = re.compile(r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+")
PY_CODE = re.compile(r"```[\s\S]*?```")
PY_HASHTAG = re.compile(r"#[^\s]+")
PY_ABBREV = re.compile(r"\b(?:[a-z]*[A-Z][a-z]*(?:[A-Z][a-z]*)?|[A-Z]+(?![a-z]))\b")
PY_CUSTOM = re.compile(r"<(a)?:\w+:\d+>")
PY_SENT = re.compile(r"\w[^.!?]*[.!?]")
PY_WORD = re.compile(r"\w+")

SAMPLES = [
    "Note: this is fine :) <3 and :smile: ok.", "😀😃 hi 🚀 🇫🇷", "see http://ex.org/p?q=1#frag ok", "```x = 1``` and ```y```",
    "#tag #другой tag", "I met McKay at NATO with ABc and aBC", "<a:wave:12345> <:x:9> text", "Él dijo: ¿qué? ¡Sí!",
    "no terminator here", "...", "", "a.b!c?d", "trailing words. more words", "x :-) y ;P z =D", "Straße façade naïve",
]


def _rand_text(rng):
    alphabet = string.ascii_letters + "    ..!?:;()<>3DPp#@*/\\|-^=B8éÉß😀🚀" + "\n"
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    data = SAMPLES + [_rand_text(rng) for _ in range(400)]
    return data, spark.createDataFrame([(i, s) for i, s in enumerate(data)], "i int, s string")


@pytest.mark.parametrize("fn,py", [
    (T.count_emoji, PY_EMOJI), (T.count_emoticon, PY_EMOTICON), (T.count_links, PY_LINK), (T.count_code, PY_CODE),
    (T.count_hashtags, PY_HASHTAG), (T.count_abbrev, PY_ABBREV), (T.count_sentences, PY_SENT), (T.count_words, PY_WORD),
])
def test_counts_match_python(texts, fn, py):
    data, df = texts
    got = dict(df.select("i", fn(F.col("s")).alias("n")).collect())
    for i, s in enumerate(data):
        assert got[i] == len(py.findall(s)), (s, got[i], len(py.findall(s)))


def test_punct_tokens_strip(texts):
    data, df = texts
    rows = df.select("i", T.count_punct("s").alias("p"), T.tokens_ws("s").alias("t"),
                     T.strip_custom_emoji("s").alias("c"), T.py_strip("s").alias("st")).collect()
    for r in rows:
        s = data[r["i"]]
        assert r["p"] == sum(ch in string.punctuation for ch in s)
        assert r["t"] == s.split()
        assert r["c"] == PY_CUSTOM.sub("", s)
        assert r["st"] == s.strip()


def test_known_quirks(spark):
    df = spark.createDataFrame([("Note: here",), ("😀😃",), ("I met McKay",)], "s string")
    got = [tuple(r) for r in df.select(T.count_emoticon("s"), T.count_emoji("s"), T.count_abbrev("s")).collect()]
    assert got[0][0] == 1          # ``e:`` + space counts: the class holds \D
    assert got[1][1] == 1          # one run of two emoji
    assert got[2][2] == 2          # I, McKay


def test_chunks_and_truncate(spark):
    s = "a" * 1100
    df = spark.createDataFrame([(s, "one two  three four")], "s string, w string")
    r = df.select(T.chunks("s").alias("c"), T.truncate_words("w", 2).alias("t")).first()
    assert [len(x) for x in r["c"]] == [510, 510, 80]
    assert r["t"] == "one two"

"""CSV records read in many splits equal one reader of the whole file."""

import random

import pytest

from chatspark.sources import readers as R
from chatspark.sources.records import ends_inside, read_records

SCHEMA = "uid string, content string, n int"


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_(size):
        for n in names:
            spark.conf.set(n, size)

    yield set_
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def whole(spark, path, schema=SCHEMA, sep="|"):
    """One task a file."""
    return spark.read.schema(schema).options(header="true", multiLine="true", quote='"', escape='"', sep=sep).csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(path, files):
    path.mkdir()
    for name, text in files.items():
        (path / name).write_bytes(text.encode())
    return str(path)


def field(rng):
    text = "".join(rng.choice(["a", "é", " ", "b,c", "|", "\n", "\n\n", '"', '""', "x" * 40]) for _ in range(rng.randint(0, 6)))
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '|\n"') or rng.random() < 0.3 else text


@pytest.mark.parametrize("size", [24, 100, 1 << 20])
def test_random_files_in_tiny_splits(spark, tmp_path, tiny_splits, size):
    rng = random.Random(size)
    files = {f"f{k}.csv": "uid|content|n\n" + "".join(f"{field(rng)}|{field(rng)}|{rng.randint(0, 9)}\n" for _ in range(rng.choice([0, 1, 40])))
             for k in range(4)} | {"last.csv": 'uid|content|n\nu|"open\nend"|1\nv|no line end|2'}
    path = write(tmp_path / "csv", files)
    want = rows(whole(spark, path))
    tiny_splits(size)
    assert rows(R.read_pipe(spark, path, SCHEMA)) == want and len(want) > 1


def test_one_file_many_tasks(spark, tmp_path, tiny_splits):
    rng = random.Random(1)
    body = "".join(f"u{i % 7}|{field(rng)}|{i}\n" for i in range(20_000))
    long = '"' + ("line\n" * 50_000) + '"'
    path = write(tmp_path / "big", {"one.csv": f"uid|content|n\n{body}w|{long}|7\n{body}"})
    want = rows(whole(spark, path))
    tiny_splits(1 << 15)
    records = read_records(spark, path, "|")
    assert records.rdd.getNumPartitions() >= 20
    assert rows(R.read_pipe(spark, path, SCHEMA)) == want and len(want) == 40_001


def test_crlf_bom_blank_lines_and_rejects(spark, tmp_path, tiny_splits):
    path = write(tmp_path / "odd", {"a.csv": '﻿uid,content,n\r\na,"x\ny",1\r\n\r\nb,two,2\r\nc,"q,""r""",x\r\nd,1\r\n', "b.csv": "uid,content,n\n"})
    tiny_splits(16)
    assert rows(R.read_skip_bad(spark, path, SCHEMA)) == [("a", "x\ny", 1), ("b", "two", 2)]
    assert sorted(r["record"] for r in R.read_rejects(spark, path, SCHEMA).collect()) == ['c,"q,""r""",x', "d,1"]
    assert rows(R.read_named_fields(spark, path, ["p", "q"], sep=",")) == [("a", "x\ny"), ("b", "two"), ("c", 'q,"r"'), ("d", "1")]


def test_lines_as_maps():
    assert not ends_inside('a|"b"|c', False, "|") and ends_inside('a|"b', False, "|")
    assert not ends_inside('a|5" disk|c', False, "|") and ends_inside('x""y', True, "|") and not ends_inside('x"|y', True, "|")
    assert ends_inside('x"|"y', True, "|") and not ends_inside("", False, "|") and ends_inside("", True, "|")
    assert ends_inside('"', False, "|") and not ends_inside('"', True, "|") and not ends_inside('a|""', False, "|")

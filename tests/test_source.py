"""Transcript files read in splits: lines, numbers and hashes against plain Python, for all sizes of splits."""

import hashlib

import pytest
import zstandard

from sessionloom.sources import transcripts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("lines")
    (d / "big").mkdir()
    (d / "big" / "subagents").mkdir()
    data = {
        "big.jsonl": b"".join(b'{"n": %d, "pad": "%s"}%s\n' % (k, b"x" * (k * 37 % 211), b"\r" if k % 5 == 0 else b"") for k in range(4000)),
        "open.jsonl": b'{"a": 1}\n\n\n{"b": "\xff\xfe"}\r\r\n{"c": "line\rinside \xe2\x80\xa8 too"}',
        "blank.jsonl": b"\n\n",
        "packed.jsonl.zst": b'{"z": 1}\r\n\n{"z": 2}\n',
        "big/subagents/agent-2.jsonl": b'{"side": 2}\n',
        "big/subagents/agent-1.jsonl": b'{"side": 1}\n',
        ".hidden.jsonl": b"{}\n",
        "other.txt": b"{}\n",
    }
    for name, b in data.items():
        (d / name).write_bytes(zstandard.compress(b) if name.endswith(".zst") else b)
    return str(d), data


def plain(b):
    """Split at line feeds only; a final one ends the last line; one carriage return goes."""
    lines = b.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    return [(x[:-1] if x.endswith(b"\r") else x).decode("utf-8", "replace") for x in lines]


@pytest.mark.parametrize("split", ["128m", "1000", "37k"])
def test_lines_of_splits_are_those_of_the_whole(spark, folder, split):
    path, data = folder
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        if split == "1000":
            assert transcripts.numbered_lines(spark, path).rdd.getNumPartitions() > 100
        rows = transcripts.raw_lines(spark, path).collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    names = [n for n in data if n.split("/")[-1][0] != "." and not n.endswith(".txt")]
    want = {(n, k, line, hashlib.sha256(data[n]).hexdigest()) for n in names for k, line in enumerate(plain(data[n]), 1)}
    got = {(r["path"].split("/lines", 1)[1].split("/", 1)[1], r["line_no"], r["raw"], r["sha256"]) for r in rows}
    assert got == want and len(rows) == len(want)
    places = {(r["session_key"].rsplit("/", 1)[1], r["path"].rsplit("/", 1)[1], r["path_ix"]) for r in rows}
    assert places == {("big", "big.jsonl", 0), ("big", "agent-1.jsonl", 1), ("big", "agent-2.jsonl", 2), ("open", "open.jsonl", 0), ("blank", "blank.jsonl", 0), ("packed", "packed.jsonl.zst", 0)}


def test_source_hash_is_the_hash_of_hashes(spark, folder):
    path, data = folder
    got = {r["session_key"].rsplit("/", 1)[1]: r["source_hash"] for r in transcripts.source_hash(transcripts.raw_lines(spark, path)).collect()}
    own = lambda *names: hashlib.sha256("".join(hashlib.sha256(data[n]).hexdigest() for n in names).encode()).hexdigest()
    assert got["big"] == own("big.jsonl", "big/subagents/agent-1.jsonl", "big/subagents/agent-2.jsonl") and got["packed"] == own("packed.jsonl.zst")

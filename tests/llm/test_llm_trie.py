"""The prefix trie against a plain version of the contract."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clausewright.llm import queries, trie

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """The nodes of rows of (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = kids.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) if below else 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(saved[k] for k in below)
    out = []
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(key))
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(kids.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, b"x", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, node binary, depth int, n int")


def test_query_is_the_plain_version(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    assert nodes(queries.op12_prefix_trie(spark, FOLDER)) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-120, 60), *range(195, 320), 10**12 + 7, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 8])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", None, ""]), rng.choice(["é\n", "hello", None, "", "b"])))
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), *[(5, 3, "user", "again")] * 3]
    assert nodes(trie.prefix_trie(turns_of(spark, rows))) == plain(rows)


def test_long_conversations_over_parts_and_blocks(spark, monkeypatch):
    """Depths beyond a block, many equal conversations, and pieces and hot pointers of small bounds."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "PIECE", 3)
    text = [f"turn {t}" for t in range(200)]
    rows = [(c, t, "user", text[t]) for c, n in ((100, 200), (300, 200), (301, 150), (702, 90)) for t in range(n)]
    rows += [(1000 + c, t, "user", "same") for c in range(60) for t in range(2)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # parts stay apart, so one conversation lies in several
    try:
        assert nodes(trie.prefix_trie(turns_of(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_pointers_by_broadcast_are_those_by_join(spark):
    state = spark.createDataFrame([(i, i % 4) for i in range(40)], "node int, ptr int")
    pointed = spark.createDataFrame([(0, 10, 10), (1, 11, 10), (2, 12, 10)], "ptr int, next int, n int")
    want = sorted((i, 10 + i % 4) for i in range(40) if i % 4 < 3)
    for bound in (0, 10):
        assert sorted(tuple(r) for r in trie._followed(state, pointed, bound).collect()) == want
    mixed = pointed.withColumn("n", F.when(F.col("ptr") == 1, 1).otherwise(F.col("n")))
    assert sorted(tuple(r) for r in trie._followed(state, mixed, 5).collect()) == want


def test_no_turns(spark):
    assert trie.prefix_trie(turns_of(spark, [])).count() == 0
    assert trie.prefix_trie(turns_of(spark, [(None, 1, "a", "b")])).count() == 0

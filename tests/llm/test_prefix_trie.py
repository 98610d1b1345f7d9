"""The trie of conversations against one that is built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rolesift.llm import prefix_trie
from rolesift.llm.prefix_trie import build_trie, digest_turns, shared_openings
from rolesift.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "ends_sha256", "n_children", "n_convs", "n_leaves", "parent_conv_id",
         "saved_tokens"]


def ordered(data):
    convs = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return made


def trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, having in members.items():
        if node:
            children[node[:-1]] += 1
    for node, having in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(having) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(having), len(node),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            children[node], len(having), leaves[node],
            min(members[node[:-1]]) if node else None, saved[node],
        )
        for node, having in members.items()
    )


def got_rows(df):
    assert sorted(df.columns) == NAMES
    return [tuple(r) for r in df.select(*NAMES).collect()]


def direct(spark, data):
    """Without rebuilding."""
    turns = digest_turns(spark.createDataFrame(data, SCHEMA))
    return build_trie(turns, turns.select("conv_id").distinct())


def by_key(found):
    return sorted(found, key=repr)


def test_the_test_table(spark):
    for sf in ("0.001", "0.01"):
        folder = f"/root/testdata/sf{sf}"
        data = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
            "conv_id", "turn", "role", "text").collect()]
        want = trie(rebuilt(ordered(data)))
        assert by_key(got_rows(op12_prefix_trie(spark, folder))) == by_key(want)


def random_table(seed, n=60):
    """Few texts, so that conversations share openings of all lengths, whole
    blocks and more; some are copies, some extend others."""
    rng = random.Random(seed)
    data, convs = [], []
    for c in range(n):
        turns = list(rng.choice(convs))[: rng.randrange(14)] if convs and rng.random() < 0.7 else []
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 9])):
            turns.append((rng.choice(["user", "assistant"]), rng.choice(["", "a", "é", "bb"])))
        convs.append(turns)
        ids = c * 3 if seed % 2 else c
        data += [(ids, k, role, text) for k, (role, text) in enumerate(turns)]
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(prefix_trie, "BLOCK", 1)
    data = random_table(seed)
    assert by_key(got_rows(direct(spark, data))) == by_key(trie(ordered(data)))
    table = spark.createDataFrame(data, SCHEMA)
    whole = build_trie(*shared_openings(digest_turns(table)))
    assert by_key(got_rows(whole)) == by_key(trie(rebuilt(ordered(data))))


def test_awkward_rows(spark):
    data = [
        (7, 1, "user", "x"), (7, None, "user", None), (7, 1, "user", "x"), (7, 1, None, "y"),
        (None, 0, "user", "lost"), (8, None, None, None), (9, 0, "user", "x" * 3_000_000),
        (-4, 0, "user", "hi"), (-4, 2, "assistant", "ho"), (-5, 0, "user", "hi"),
        (3, 0, "us", "er"), (4, 0, "u", "ser"),
    ]
    assert by_key(got_rows(direct(spark, data))) == by_key(trie(ordered(data)))
    table = spark.createDataFrame(data, SCHEMA)
    for column in ("a", "b", "depth", "first", "h"):
        table = table.withColumn(column, F.lit("x"))
    whole = build_trie(*shared_openings(digest_turns(table)))
    assert by_key(got_rows(whole)) == by_key(trie(rebuilt(ordered(data))))
    empty = build_trie(*shared_openings(digest_turns(table.limit(0))))
    assert empty.collect() == []


def test_conversations_without_turns(spark):
    """All that is left is the root, which is then a leaf."""
    turns = digest_turns(spark.createDataFrame([], SCHEMA))
    ids = spark.createDataFrame([(5,), (2,)], "conv_id long")
    assert got_rows(build_trie(turns, ids)) == [
        (2, 0, hashlib.sha256(b"2,5").hexdigest(), 0, 2, 1, None, 0)]


def test_hot_nodes_and_a_long_conversation(spark):
    """Half of all conversations are copies, and all begin alike."""
    data = [(c, t, "user", f"shared {t}") for c in range(300) for t in range(6)]
    data += [(c, 6, "user", f"own {c}") for c in range(300, 500) for t in [0]]
    data += [(c, t, "user", f"shared {t}") for c in range(300, 500) for t in range(6)]
    data += [(1000, t, "user", f"turn {t % 3}") for t in range(700)]
    assert by_key(got_rows(direct(spark, data))) == by_key(trie(ordered(data)))


def test_only_blocks_that_diverge_are_grouped_by_turn(spark):
    """A chain of blocks without siblings goes round the second grouping."""
    data = [(c, t, "user", f"turn {t}") for c in range(50) for t in range(40)]
    data += [(c, 40, "user", f"end {c % 2}") for c in range(50)]
    turns = digest_turns(spark.createDataFrame(data, SCHEMA))
    blocks = prefix_trie._blocks(turns, turns.select("conv_id").distinct())
    groups = prefix_trie._groups(blocks)
    n = {r.diverges: r.n for r in groups.groupBy("diverges").count().withColumnRenamed("count", "n").collect()}
    assert n == {False: 10, True: 2}
    assert rows(groups.selectExpr("sum(n_convs) AS n")) == [(50 * 11,)]

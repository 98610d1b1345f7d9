"""The lookup table: even shares, little movement, one lookup."""

from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from llm_rows import awkward  # noqa: F401

from rolesift.llm.queries import QUERIES, SHARDS
from rolesift.llm.sharding import SLOTS, lookup_table, place, shard_names


def filled_in_turns(shards, slots):
    """The same table by the plain definition: each shard's whole order."""
    from rolesift.llm import sharding

    orders = []
    for s in shards:
        at = sharding._number(s, "offset") % slots
        step = sharding._number(s, "step") % (slots - 1) + 1
        orders.append(iter([(at + k * step) % slots for k in range(slots)]))
    table = {}
    while len(table) < slots:
        for shard, order in enumerate(orders):
            if len(table) == slots:
                break
            slot = next(x for x in order if x not in table)
            table[slot] = shard
    return [table[k] for k in range(slots)]


@pytest.mark.parametrize("n, slots", [(1, 7), (3, 13), (5, 101), (13, 13)])
def test_table_against_its_definition(n, slots):
    names = shard_names(n)
    table = lookup_table(names, slots)
    assert table == filled_in_turns(names, slots)
    shares = Counter(table)
    assert set(shares) == set(range(n)) and max(shares.values()) - min(shares.values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = shard_names(20)
    before, after = lookup_table(names), lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.2 * SLOTS


def test_placement_against_the_table(spark):
    import hashlib

    names = shard_names(SHARDS)
    table = lookup_table(names)
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_shards"](spark, sf).collect()
    assert len(got) == 1000
    for r in got:
        slot = int(hashlib.md5(f"k{r.doc_id}".encode()).hexdigest()[:15], 16) % SLOTS
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    shares = Counter(r.shard for r in got)
    assert len(shares) == SHARDS and max(shares.values()) < 4 * 1000 / SHARDS


def test_nothing_is_shuffled(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    plan = place(df, shard_names(3))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward_rows(spark, awkward):
    got = place(awkward, shard_names(5), slots=101)
    assert got.select("_key", "__text_a", "size", "label").distinct().collect() == [("x",) * 4]
    assert got.columns == [*[c for c in awkward.columns if c not in ("slot", "shard")], "slot", "shard"]
    assert got.count() == awkward.count()
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 and None not in s for s in by_id.values())
    assert rows(got) == rows(place(awkward.repartition(3), shard_names(5), slots=101))
    assert place(awkward.limit(0), shard_names(5), slots=101).count() == 0


def test_unusable_arguments(spark):
    for shards, slots in (([], 7), (["a", "a"], 7), (shard_names(9), 7), (["a"], 12)):
        with pytest.raises(ValueError):
            lookup_table(shards, slots)

"""Prefix trie of conversations, by hashing blocks of several turns.

A node is a distinct sequence of first turns; its members are the conversations
that begin with it. Turns become 128-bit digests at once, so texts are shuffled
one time and never compared. The digest of a prefix is the exclusive or of the
digests of its turns, each taken together with its depth, so it is a running sum
that Spark can make, for a conversation of any length.

Conversations are not grouped turn by turn. First they are grouped by the digests
at the ends of successive blocks of ``BLOCK`` turns, and only one row of a group
goes on: a block that a third of all conversations share is one row for each task
before the shuffle. Where all members of a block's start go on in the same way,
the turns inside are a chain and need no grouping. Only where sibling blocks
diverge are their turns, one set for each sibling, grouped to find how deep they
still agree.

Sums over subtrees need no walk over the tree either. A node belongs to its
smallest member, which then owns all deeper nodes on its way as well. So of a
subtree's sums each member contributes what its own way adds, which is a running
sum from its end, and members are summed by block as above:

* leaves: one for each childless node, brought by its owner;
* saved tokens: (members - 1) times the bytes of the last text, that is the bytes
  of the turns that a member passes and does not own.

A conversation is put in order in one task, on disk if it is long. The numbers of
the conversations that end at a node are streamed through one task in order,
because their digest needs the number before."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.session import shared_dir

BLOCK = 4
NODE = ["depth", "a", "b"]
GROUP = ["block", "prev_a", "prev_b", "a", "b", "size"]
#: Of ``shared_openings``: conversations of a family, and bound of the opening.
FAMILY, OPENING = 5, 9


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = shared_dir(df.sparkSession, f"trie-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest_turns(conversations: DataFrame) -> DataFrame:
    """The turns of ``conversations`` (conv_id, turn, role, text) as (conv_id,
    position, a, b, bytes): the position from 0, a digest of role and text, and
    the bytes of the text in UTF-8.

    Turns are ordered by turn (null first), then by role and text; repeated rows
    are turns of their own; a null role or text is empty. Rows without a conv_id
    belong to no conversation and are left out. Other columns are not read."""
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)

    def number(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")

    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("position"),
        number(1).alias("a"),
        number(16).alias("b"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilds every conversation c of ``digest_turns``: the first h turns of the
    first conversation of its family, c - c mod 5 (all if it has fewer, none if it
    is absent), then its own turns after its first h; h is crc32(c as text) mod 9.
    Returns the rebuilt turns, and the numbers of all conversations (conv_id),
    some of which may have no turn now. The modulus of a negative number is not
    negative. An opening is at most eight turns for each of five conversations."""
    turns = _kept(turns, "turns")
    first = (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("first")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(OPENING)).cast("int").alias("h")
    ids = turns.select("conv_id").distinct()
    opening = (
        turns.filter((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("position") < OPENING - 1))
        .groupBy(F.col("conv_id").alias("first"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "a", "b", "bytes"))).alias("opening"))
    )
    heads = ids.select("conv_id", first, h).join(opening, "first", "left").select(
        "conv_id", F.slice(F.coalesce("opening", F.array()), F.lit(1), F.col("h")).alias("head")
    )
    # Own turns move up by as many as the opening lacks.
    moved = heads.select("conv_id", F.size("head").alias("taken"))
    own = turns.select("*", h).filter("position >= h").join(moved, "conv_id")
    own = own.select(
        "conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "a", "b", "bytes"
    )
    rebuilt = heads.select("conv_id", F.inline("head")).unionByName(own)
    return rebuilt.select("conv_id", "position", "a", "b", "bytes"), ids


def _blocks(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """For each conversation and block: the digests of the prefix before it, the
    nodes in it in order, and whether it is the last. The root, depth 0, is the
    first node of every conversation."""
    start = ids.select(
        "conv_id", F.lit(0).alias("depth"),
        *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "bytes")],
    )
    # The depth is part of a turn's digest: the same turn elsewhere is another.
    depth = F.col("position") + 1
    placed = turns.select(
        "conv_id",
        depth.alias("depth"),
        F.xxhash64(depth, "a", "b").alias("a"),
        F.xxhash64("b", "a", depth, F.lit(BLOCK)).alias("b"),
        "bytes",
    )
    blocks = (
        start.unionByName(placed)
        .groupBy("conv_id", F.floor(F.col("depth") / BLOCK).cast("int").alias("block"))
        .agg(
            F.sort_array(F.collect_list(F.struct("depth", "a", "b", "bytes"))).alias("turns"),
            F.bit_xor("a").alias("a"),
            F.bit_xor("b").alias("b"),
        )
    )
    order = Window.partitionBy("conv_id").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select(
        "conv_id",
        "block",
        "turns",
        *[F.bit_xor(c).over(so_far).bitwiseXOR(F.col(c)).alias(f"prev_{c}") for c in ("a", "b")],
        F.lead("block").over(order).isNull().alias("is_last"),
    )

    def upto(c: str):
        return lambda i: F.aggregate(
            F.slice("turns", F.lit(1), i + 1), F.col(f"prev_{c}"), lambda x, t: x.bitwiseXOR(t[c])
        )

    at = F.sequence(F.lit(0), F.size("turns") - 1)
    nodes = F.transform(
        at,
        lambda i: F.struct(
            F.get("turns", i)["depth"].alias("depth"),
            upto("a")(i).alias("a"),
            upto("b")(i).alias("b"),
            F.when(i > 0, upto("a")(i - 1)).otherwise(F.col("prev_a")).alias("up_a"),
            F.when(i > 0, upto("b")(i - 1)).otherwise(F.col("prev_b")).alias("up_b"),
            F.get("turns", i)["bytes"].alias("bytes"),
        ),
    )
    blocks = blocks.select("conv_id", "block", "prev_a", "prev_b", nodes.alias("nodes"), "is_last")
    end = F.element_at("nodes", -1)
    return blocks.select(
        "*", end["a"].alias("a"), end["b"].alias("b"), F.size("nodes").alias("size")
    )


def _groups(blocks: DataFrame) -> DataFrame:
    """One row for each distinct block after each distinct prefix, and whether it
    has siblings: other blocks after the same prefix."""
    groups = blocks.groupBy(*GROUP).agg(
        F.first("nodes").alias("nodes"),
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
    )
    # A prefix that very many blocks follow is split by adaptive execution.
    start = ["block", "prev_a", "prev_b"]
    siblings = groups.groupBy(*start).agg((F.count("*") > 1).alias("diverges"))
    return groups.join(siblings, start)


def _refined(groups: DataFrame, *sums: Column) -> DataFrame:
    """The nodes inside blocks, with sums over the groups that share them. Turns
    of blocks without siblings are nodes as they stand; those of siblings are
    grouped."""
    inside = groups.select("*", F.posexplode("nodes").alias("place", "node"))
    up = ["up_a", "up_b", "bytes"]
    cells = inside.select(
        "diverges", *[F.col(f"node.{c}").alias(c) for c in (*NODE, *up)], *sums
    )
    names = [c for c in cells.columns if c not in ("diverges", *NODE, *up)]
    joined = (
        cells.filter("diverges")
        .groupBy(*NODE)
        .agg(
            *[F.first(c).alias(c) for c in up],
            *[(F.min(c) if c == "conv_id" else F.sum(c)).alias(c) for c in names],
        )
    )
    return cells.filter("NOT diverges").drop("diverges").unionByName(joined)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the numbers of each node's conversations, which come in order."""
    now, digest = None, hashlib.sha256()

    def row(key: tuple) -> dict:
        return {**dict(zip(NODE, key, strict=True)), "ends_sha256": digest.hexdigest()}

    schema = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in NODE])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        numbers, done = batch.column("conv_id").to_pylist(), []
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key, joined = tuple(keys[:, low].tolist()), ",".join(map(str, numbers[low:high]))
            if key == now:
                digest.update(f",{joined}".encode())
                continue
            if now is not None:
                done.append(row(now))
            now, digest = key, hashlib.sha256(joined.encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([row(now)], schema=schema)


def build_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (as of ``digest_turns``) of the
    conversations ``ids`` (conv_id), those without turns included: conv_id, the
    smallest member; depth; parent_conv_id, the parent's, null for the root;
    n_convs, the members; n_children; n_leaves, the childless nodes of the
    subtree; saved_tokens, (members - 1) times the bytes of the last text, summed
    over the subtree; ends_sha256, of the numbers of the conversations that end
    here, ascending, divided by commas.

    The subtree of a node includes it. Without conversations there is no node."""
    blocks = _kept(_blocks(turns, ids), "blocks")
    groups = _kept(_groups(blocks), "groups")
    found = _refined(groups, F.col("n_convs"), F.col("conv_id"))
    nodes = _kept(found, "nodes")

    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")
    ).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").fillna(0, ["n_children"])
    nodes = _kept(nodes, "counted")

    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owns_from"),
        (F.max_by("n_children", "depth") == 0).cast("long").alias("is_leaf"),
    )
    later = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    later = later.rowsBetween(Window.unboundedPreceding, -1)

    def passed(from_place: int) -> Column:
        """Bytes of the block's turns, from a place on, that are not owned."""
        rest = F.filter(
            "nodes",
            lambda n: (n["depth"] % BLOCK >= from_place)
            & (F.col("owns_from").isNull() | (n["depth"] < F.col("owns_from"))),
        )
        return F.aggregate(rest, F.lit(0).cast("long"), lambda x, n: x + n["bytes"])

    parts = blocks.join(owners, "conv_id", "left").select(
        "conv_id", *GROUP, F.coalesce("is_leaf", F.lit(0)).alias("is_leaf"),
        *[passed(j).alias(f"passed_{j}") for j in range(BLOCK)],
    )
    after = F.coalesce(F.sum("passed_0").over(later), F.lit(0))
    parts = parts.withColumn("after", after)
    sums = parts.groupBy(*GROUP).agg(
        F.sum("is_leaf").alias("n_leaves"),
        F.array(*[F.sum(F.col(f"passed_{j}") + F.col("after")) for j in range(BLOCK)]).alias("saved"),
    )
    sums = _refined(
        groups.join(sums, GROUP),
        F.col("n_leaves"),
        F.get("saved", F.col("place")).alias("saved_tokens"),
    ).drop("up_a", "up_b", "bytes")

    # ``size`` nodes from the block's first depth on end at the last of them.
    ends = (
        blocks.filter("is_last")
        .select((F.col("block") * BLOCK + F.col("size") - 1).alias("depth"), "a", "b", "conv_id")
        .repartition(*NODE)
        .sortWithinPartitions(*NODE, "conv_id")
        .mapInArrow(_ends, "depth int, a bigint, b bigint, ends_sha256 string")
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    whole = reduce(
        lambda x, y: x.join(y, NODE, "left"), [nodes, sums, ends]
    ).join(parents, ["depth", "up_a", "up_b"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Documents with equal
sets are one member from the start. Every member gets ``TOKENS`` minwise tokens,
the smallest of its shingles under as many hash functions; two members agree on
a token with a chance equal to their Jaccard similarity.

*Trees.* Each independent tree starts with all members in one node. A node
chooses one token place, by a hash of the path that leads to it, and a second one
so often that at the threshold a pair meets again in one child on average;
members go to the child of their token there. Nodes of one member are dropped.
A node of at most ``MOST_ALIKE`` members (``MOST_MEMBERS`` members and
``MOST_SHINGLES`` shingles, where sets are compared) is a leaf: its members are
compared exhaustively. A larger one compares everybody
with one member, and branches again unless its members already hang together, so
a mass of near copies ends with that one comparison. Trees are repeated until a
pair at the threshold is missed by all with a chance below ``MISS`` where nodes
do not branch again. Each further level parts a pair with the same chance, so a
tree keeps fewer pairs the deeper it is: members of nodes that branched go through
more trees, by the depth reached, until such a pair is missed by all with a chance
below ``DEEP_MISS``. Nodes still large after ``MOST_LEVELS`` are compared whole,
in chunks: each two chunks of a node are a group as small as a leaf.

*Clusters.* In a first round tokens are compared, and what is needed is only which
members hang together; so a leaf gives a forest, fewer links than members, never
all pairs. The clusters that come out are some percent of the corpus. Their full
sets are gathered, each once, and compared exactly, in one task for a cluster as
small as a leaf. The members of larger clusters go through trees once more, whose
leaves and single comparisons are then exact.

What is grouped is bounded by the leaf's size; hot nodes are counted with partial
sums and joined, where adaptive execution splits them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import mix, text_groups, window_hashes, words_of
from rolesift.llm.blocks import grouped, pack, unpack
from rolesift.session import scratch, shared_dir

SHINGLE = 5
PERCENT = 80
TOKENS = 64
MISS = 1e-6
DEEP_MISS = 1e-3  # where nodes branch again
SURE = 4.2  # standard deviations by which a linked pair's tokens may fall short
MOST_ALIKE = 32768  # members of a leaf where tokens are compared
MOST_MEMBERS = 2048  # and where sets are
MOST_SHINGLES = 4 << 20
MOST_LEVELS = 64  # nodes that are large after so many are compared in chunks
MOST_BROADCAST_BYTES = 32 << 20
MULTIPLIERS = np.random.default_rng(64).integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


def least_matches(percent: int) -> int:
    """Equal tokens that a linked pair has with near certainty."""
    p = percent / 100
    return max(1, math.floor(TOKENS * p - SURE * math.sqrt(TOKENS * p * (1 - p))))


def meets(percent: int, levels: int) -> float:
    """The chance that a pair at the threshold shares a node of one tree so many
    levels below the root: in either of two children, the second of which a
    node has as often as makes the expected number one."""
    p = percent / 100
    chance = 1.0
    for _ in range(levels):
        chance = 1 - (1 - p * chance) * (1 - (1 / p - 1) * p * chance)
    return chance


def n_trees(percent: int, levels: int = 1) -> int:
    """Trees until a pair at the threshold is missed by all with a chance below
    MISS at the first level, and below DEEP_MISS at the given one."""
    first = max(4, math.ceil(math.log(MISS) / math.log(1 - percent / 100)) + 2)
    if levels == 1:
        return first
    return max(first, math.ceil(math.log(DEEP_MISS) / math.log(1 - meets(percent, levels))))


# Sets and tokens


def shingle_sets(texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text of a group, as 64-bit hashes."""
    words = words_of(texts, lower=True)
    windows = window_hashes(words.hashes, SHINGLE)
    for low, high in zip(words.bounds, words.bounds[1:], strict=False):
        if high - low >= SHINGLE:
            yield np.unique(windows[low : high - SHINGLE + 1])
        elif high > low:
            yield window_hashes(words.hashes[low:high], int(high - low))
        else:
            yield np.zeros(0, dtype=np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    least = np.full(TOKENS, 2**64 - 1, dtype=np.uint64)
    for low in range(0, len(shingles), 1024):
        part = shingles[low : low + 1024, None] * MULTIPLIERS
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> int:
    """A number that stands for the set. Two different sets of a corpus share
    one with a chance of about 2**-64 for each pair."""
    mixed = mix(shingles + np.uint64(0x9E3779B97F4A7C15))
    total = np.array([mixed.sum(), len(shingles)], dtype=np.uint64)
    return int(mix(total[:1] + mix(total[1:]))[0].astype(np.int64))


SKETCHES = "doc_id bigint, __text_a bigint, __text_b bigint, member bigint, n bigint, tokens binary"
KEY = ["__text_a", "__text_b"]


def text_key(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(7), text).alias(KEY[1])]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_groups(batch.column("text")):
            members, sizes, tokens = [], [], []
            for shingles in shingle_sets(texts):
                members.append(set_key(shingles))
                sizes.append(len(shingles))
                tokens.append(minwise(shingles).tobytes())
            rows = slice(texts.first, texts.first + len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(rows.start, len(texts)) for c in ("doc_id", *KEY)],
                    pa.array(members, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.binary()),
                ],
                names=["doc_id", *KEY, "member", "n", "tokens"],
            )


def _tokens(column: pa.Array) -> np.ndarray:
    rows = [np.frombuffer(x, np.uint32) for x in column.to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, TOKENS), np.uint32)


# Trees

NODES = "node bigint, member bigint, n bigint, alike bigint"


def _children(percent: int, trees: range | None):
    """Members of the children: of the roots of the trees, or of given nodes."""
    second = 100 / percent - 1

    def step(path: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.arange(len(tokens))
        one = mix(path + np.uint64(1)) % np.uint64(TOKENS)
        two = mix(path + np.uint64(2)) % np.uint64(TOKENS - 1)
        two = (one + two + np.uint64(1)) % np.uint64(TOKENS)
        both = (mix(path + np.uint64(3)) >> np.uint64(11)).astype(np.float64) / 2**53 < second
        for place, some in ((one, rows), (two, rows[both])):
            at = place[some]
            token = tokens[some, at.astype(np.int64)].astype(np.uint64)
            yield some, mix(mix(path[some] + np.uint64(4)) + (at << np.uint64(32)) + token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column("tokens"))
            if not len(tokens):
                continue
            member, n = (batch.column(c) for c in ("member", "n"))
            seen = mix(tokens.astype(np.uint64))
            alike = mix((seen * MULTIPLIERS).sum(axis=1)).view(np.int64)
            if trees is None:
                paths = [batch.column("node").to_numpy().view(np.uint64)]
            else:
                paths = [
                    np.full(len(tokens), mix(np.array([1000 + t], dtype=np.uint64))[0])
                    for t in trees
                ]
            for path in paths:
                for some, node in step(path, tokens):
                    take = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(node.view(np.int64)),
                            member.take(take),
                            n.take(take),
                            pa.array(alike[some]),
                        ],
                        names=["node", "member", "n", "alike"],
                    )

    return run


def _is_small(members: Column, shingles: Column, exact: bool) -> Column:
    if not exact:
        return members <= MOST_ALIKE
    return (members <= 2) | ((members <= MOST_MEMBERS) & (shingles <= MOST_SHINGLES))


def _n_chunks(members: Column, shingles: Column, exact: bool) -> Column:
    """Chunks of a node, two of which are no more than a leaf on average."""
    if not exact:
        return F.ceil(2 * members / MOST_ALIKE)
    return F.greatest(F.ceil(2 * members / MOST_MEMBERS), F.ceil(2 * shingles / MOST_SHINGLES))


def chunk_pairs(nodes: DataFrame) -> DataFrame:
    """(group, member): a group for each two chunks of a node (node, member,
    chunks), so that every two members of the node are in one group."""
    own = F.pmod(F.xxhash64("member", "node"), F.col("chunks"))
    return (
        nodes.select("node", "member", own.alias("own"), F.greatest("chunks", F.lit(2)).alias("n"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        .filter("own <> other")
        .select(
            F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("group"),
            "member",
        )
    )


LINKS = "a bigint, b bigint"


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
    )


def forest(size: int, near) -> list[tuple[int, int]]:
    """Links that connect what ``near`` connects: ``near(i, rest)`` tells which
    of the others i is linked to. Everybody is compared with everybody not yet
    reached, and fewer links than members come out."""
    links = []
    rest = np.arange(size)
    while len(rest):
        open_ = [int(rest[0])]
        rest = rest[1:]
        while open_ and len(rest):
            i = open_.pop()
            found = near(i, rest)
            reached = rest[found]
            links += [(i, int(j)) for j in reached]
            open_ += reached.tolist()
            rest = rest[~found]
    return links


def _compare_leaves(percent: int):
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "group"):
            sketch = np.stack([np.frombuffer(r["tokens"], np.uint32) for r in rows]).astype(np.uint8)
            n = np.array([r["n"] for r in rows])

            def near(i: int, rest: np.ndarray, sketch=sketch, n=n) -> np.ndarray:
                alike = (sketch[rest] == sketch[i]).sum(axis=1) >= least
                smaller, larger = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
                return alike & (100 * smaller >= percent * larger)

            links = forest(len(rows), near)
            if links:
                yield _link_batch([(rows[i]["member"], rows[j]["member"]) for i, j in links])

    return run


def _compare_with_one(percent: int):
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = _tokens(batch.column("tokens")), _tokens(batch.column("one_tokens"))
            alike = (mine == other).sum(axis=1) >= least
            a, b = (batch.column(c).to_numpy() for c in ("member", "one"))
            keep = alike & (a != b)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _nodes(children: DataFrame, exact: bool, path: str) -> DataFrame:
    """Nodes of two members or more, written: a row for each member, with the
    node's size and its smallest member."""
    sizes = children.groupBy("node").agg(
        F.count("*").alias("members"),
        F.sum("n").alias("shingles"),
        F.min("member").alias("one"),
        (F.min("alike") == F.max("alike")).alias("same"),
    )
    sizes = sizes.filter(F.col("members") > 1).withColumn(
        "small", _is_small(F.col("members"), F.col("shingles"), exact)
    ).withColumn("chunks", _n_chunks(F.col("members"), F.col("shingles"), exact))
    # A member is at most twice in a node; leaves take it once.
    children.select("node", "member").join(sizes.drop("shingles"), "node").write.parquet(path)
    return children.sparkSession.read.parquet(path)


# Connected components


def components(links: DataFrame, path: str) -> DataFrame:
    """(member, label) for each end of a link; a label is the smallest member
    that can be reached. Every round a member takes the smallest label around it,
    then the label's own, so the rounds are about the logarithm of the longest
    way. Labels are written every round; partial minima are taken before each
    shuffle, so a member with very many links is no burden."""
    spark = links.sparkSession
    both = links.filter("a <> b").select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("member"), F.col("b").alias("other")),
                F.struct(F.col("b").alias("member"), F.col("a").alias("other")),
            )
        ).alias("l")
    )
    both.select("l.member", "l.other").distinct().write.parquet(f"{path}/links")
    both = spark.read.parquet(f"{path}/links")
    labels = both.groupBy("member").agg(F.min("other").alias("o")).select(
        "member", F.least("member", "o").alias("label")
    )
    labels.write.parquet(f"{path}/labels-0")
    labels = spark.read.parquet(f"{path}/labels-0")
    turn = 0
    while True:
        turn += 1
        around = (
            both.join(labels.withColumnRenamed("member", "other"), "other")
            .groupBy("member")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(around, "member").select(
            "member", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        lower.write.parquet(f"{path}/lower-{turn}")
        lower = spark.read.parquet(f"{path}/lower-{turn}")
        jump = lower.select(F.col("member").alias("label"), F.col("label").alias("further"))
        after = lower.join(jump, "label", "left").select(
            "member",
            "was",
            F.least("label", F.coalesce("further", "label")).alias("label"),
        )
        after.write.parquet(f"{path}/labels-{turn}")
        after = spark.read.parquet(f"{path}/labels-{turn}")
        labels = after.select("member", "label")
        if after.filter("was <> label").isEmpty():
            return labels


# Trees over tables

Compare = Callable[[DataFrame], DataFrame]


def grow(
    members: DataFrame, percent: int, leaves: Compare, with_one: Compare, exact: bool, path: str
) -> DataFrame:
    """Links (a, b) between members (member, n, tokens) found in all trees.
    ``leaves`` links the members of small nodes (group, member); ``with_one``
    those of a row (member, one). ``exact`` tells that they read full sets.

    The first trees hold all members. If nodes branched, those of their members
    go through as many more as the depth asks for."""
    spark = members.sparkSession
    tokens = members.select("member", "n", "tokens")
    links: list[DataFrame] = []

    def written(found: DataFrame, name: str) -> DataFrame:
        found.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    trees, deepest, among, turn = range(n_trees(percent)), 1, tokens, 0
    while len(trees):
        children = among.mapInArrow(_children(percent, trees), NODES)
        for level in range(1, MOST_LEVELS + 1):
            name = f"{turn}-{level}"
            nodes = _nodes(children, exact, f"{path}/nodes-{name}")
            small = nodes.filter("small").select(F.col("node").alias("group"), "member")
            links.append(written(leaves(small), f"leaves-{name}"))
            large = nodes.filter("not small")
            if large.isEmpty():
                break
            pairs = large.filter("member <> one").select("member", "one").distinct()
            links.append(written(with_one(pairs), f"stars-{name}"))
            every = reduce(DataFrame.unionByName, links)
            labels = components(every, f"{path}/together-{name}")
            apart = (
                large.filter("not same")
                .join(labels, "member", "left")
                .groupBy("node")
                .agg(
                    F.min(F.coalesce("label", "member")).alias("low"),
                    F.max(F.coalesce("label", "member")).alias("high"),
                )
                .filter("low <> high")
                .select("node")
            )
            open_ = written(
                large.select("node", "member", "chunks").join(apart, "node"), f"open-{name}"
            )
            if open_.isEmpty():
                break
            if level == MOST_LEVELS:
                links.append(written(leaves(chunk_pairs(open_)), f"rest-{name}"))
                break
            if level == 1:
                branched = open_.select("member").distinct()
            deepest = max(deepest, level + 1)
            children = (
                open_.select("node", "member")
                .join(tokens, "member")
                .mapInArrow(_children(percent, None), NODES)
            )
        trees = range(trees.stop, n_trees(percent, deepest))
        if len(trees):
            among = written(branched.join(tokens, "member").select(*tokens.columns), f"among-{turn}")
            turn += 1
    return reduce(DataFrame.unionByName, links)


def _grouped(groups: DataFrame, values: DataFrame) -> DataFrame:
    """The groups' members (group, member) with what is known of each, all rows
    of a group together. A member may be in a group twice."""
    return (
        groups.distinct()
        .join(values, "member")
        .repartition("group")
        .sortWithinPartitions("group", "member")
    )


def _paired(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    other = values.select(F.col("member").alias("one"), F.col(column).alias(f"one_{column}"))
    return pairs.join(values.select("member", column), "member").join(other, "one").select(
        "member", "one", column, f"one_{column}"
    )


# Exact comparison


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_groups(batch.column("text")):
            sets = [pack(s) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("member").slice(texts.first, len(texts)),
                    pa.array(sets, pa.binary()),
                ],
                names=["member", "shingles"],
            )


def exact_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    distinct, every = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(distinct), dtype=bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        n = sizes[i]
        fit = 100 * np.minimum(sizes[rest], n) >= percent * np.maximum(sizes[rest], n)
        out = np.zeros(len(rest), dtype=bool)
        some = rest[fit]
        if not len(some):
            return out
        own = every[bounds[i] : bounds[i + 1]]
        marked[own] = True
        shared = np.array([np.count_nonzero(marked[every[bounds[j] : bounds[j + 1]]]) for j in some])
        marked[own] = False
        out[fit] = 100 * shared >= percent * (sizes[some] + n - shared)
        return out

    return forest(len(sets), near)


def _link_groups(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "group"):
            links = exact_forest([unpack(r["shingles"]) for r in rows], percent)
            if links:
                yield _link_batch([(rows[i]["member"], rows[j]["member"]) for i, j in links])

    return run


def _link_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for i in range(batch.num_rows):
                pair = [unpack(batch.column(c)[i].as_py()) for c in ("shingles", "one_shingles")]
                if exact_forest(pair, percent):
                    links.append((batch.column("member")[i].as_py(), batch.column("one")[i].as_py()))
            if links:
                yield _link_batch(links)

    return run


def _small_or_not(df: DataFrame, bytes_each: int, limit: int = MOST_BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if df.count() * bytes_each <= limit else df


def link_members(
    docs: DataFrame, members: DataFrame, percent: int, path: str
) -> DataFrame:
    """Exact links (a, b) that connect all members with linked sets."""
    spark = members.sparkSession
    tokens = members.select("member", "n", "tokens")
    alike = grow(
        members,
        percent,
        lambda groups: _grouped(groups, tokens).mapInArrow(_compare_leaves(percent), LINKS),
        lambda pairs: _paired(pairs, tokens, "tokens").mapInArrow(_compare_with_one(percent), LINKS),
        False,
        f"{path}/trees",
    )
    clusters = components(alike, f"{path}/clusters").join(members, "member")
    sizes = clusters.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    clusters = clusters.join(
        sizes.select("label", _is_small(F.col("k"), F.col("shingles"), True).alias("small")), "label"
    )
    clusters.write.parquet(f"{path}/clustered")
    clusters = spark.read.parquet(f"{path}/clustered")
    # One text of each member of a cluster, for its full set.
    wanted = clusters.select(F.col("doc_id").alias("__id"), *KEY, "member")
    full = (
        docs.select("doc_id", "text", *text_key(F.col("text")))
        .join(_small_or_not(wanted, 32), KEY)
        .filter(F.col("doc_id").eqNullSafe(F.col("__id")))
        .select("member", "text")
        .mapInArrow(_sets, "member bigint, shingles binary")
        .dropDuplicates(["member"])
    )
    full.write.parquet(f"{path}/sets")
    full = spark.read.parquet(f"{path}/sets")

    def in_groups(groups: DataFrame) -> DataFrame:
        return _grouped(groups, full).mapInArrow(_link_groups(percent), LINKS)

    small = clusters.filter("small").select(F.col("label").alias("group"), "member")
    in_groups(small).write.parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")
    large = clusters.filter("not small")
    if large.isEmpty():
        return links
    exact = grow(
        large,
        percent,
        in_groups,
        lambda pairs: _paired(pairs, full, "shingles").mapInArrow(_link_pairs(percent), LINKS),
        True,
        f"{path}/large",
    )
    return links.unionByName(exact)


def find_near_duplicates(
    docs: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): (doc_id, the hash key of
    its text, n_shingles, component_id, kept). Texts are linked if 100 times the
    size of the intersection of their sets is at least ``percent`` times that of
    the union, A-Z counted as a-z; ``component_id`` is the smallest id that can
    be reached, and the row that has it is kept.

    A text of fewer than five words is one shingle; a null or empty one, or one
    without words, has none, is linked with nothing and kept. Repeated rows are
    linked; those that share the smallest id are all marked as kept. Null ids
    rank last: such a row is kept if nothing in its component has an id. Other
    columns are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    path = shared_dir(spark, "near-dups")
    docs.select("doc_id", "text", *text_key(F.col("text"))).mapInArrow(
        _sketches, SKETCHES
    ).write.parquet(f"{path}/sketches")
    sketches = spark.read.parquet(f"{path}/sketches")
    # Equal sets are one member; the row with the smallest id stands for it.
    first = F.min_by(F.struct("doc_id", *KEY), F.struct(F.col("doc_id").isNull(), "doc_id", *KEY))
    sketches.filter("n > 0").groupBy("member").agg(
        first.alias("first"), F.max("n").alias("n"), F.max("tokens").alias("tokens")
    ).select("member", "first.*", "n", "tokens").write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    links = link_members(docs, members, percent, path)
    labels = components(links, f"{path}/components")
    grouped_ = members.select("member", "doc_id").join(labels, "member", "left")
    grouped_ = grouped_.withColumn("label", F.coalesce("label", "member"))
    least = grouped_.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    grouped_.join(least, "label").select("member", "component_id").write.parquet(f"{path}/labels")
    found = spark.read.parquet(f"{path}/labels")
    # Rows without shingles match nothing, whatever number they have.
    own = F.when(F.col("n") > 0, F.col("member"))
    return (
        sketches.select("doc_id", *KEY, "n", own.alias("member"))
        .join(found, "member", "left")
        .select(
            "doc_id",
            *KEY,
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id"))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: one of each component,
    and each row without words. Of rows that repeat both id and text one stays."""
    path = shared_dir(docs.sparkSession, "kept")
    with scratch(docs.sparkSession):
        kept = find_near_duplicates(docs, percent).filter("kept")
        kept.select(F.col("doc_id").alias("__id"), *KEY).distinct().write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    # The rows travel as structs, so that none of their names is in the way.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *text_key(F.col("text")),
        F.col("doc_id").alias("__own"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id_key"),
    )
    return (
        rows.join(_small_or_not(kept, 32), KEY)
        .filter(F.col("__own").eqNullSafe(F.col("__id")))
        .dropDuplicates(["__id_key", *KEY])
        .select("row.*")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

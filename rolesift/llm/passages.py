"""Removing long passages that stand anywhere else, by prefix-free parsing.

Every byte inside a string of ``LENGTH`` bytes that starts at two places or more
of the corpus is removed. Rolling-hash triggers cut texts into phrases: a trigger
is the place of the smallest hash in some ``REACH`` neighbouring places, so equal
strings are cut alike, and no phrase is longer than ``REACH``. The strings that
start in one phrase differ only in how much they take of the phrases around a
trigger that all of them hold, their anchor. So the order of the corpus' long
suffixes follows from two things: the order of the parse, that is of the texts
around the anchors, and inside a phrase that of the dictionary's suffixes. Here
only equality up to ``LENGTH`` bytes is asked, so classes stand for ranks:

1. Parse. Each anchor asks with two keys: the text that all its strings hold,
   and the text that they cover together. A string can only be repeated if the
   first key is; all of an anchor's strings are repeated if the second is.
2. Dictionary. Where anchors share the first key and not all the second, at the
   edges of passages, the strings of the phrase are asked about one by one, once
   for each distinct second key.

Keys are 64-bit hashes. They are dealt out by hash, each once for a block of
documents, so a passage that a third of all documents hold is one key for each
block. Work is linear in the input whatever repeats. Texts are not shuffled while
the list of texts with repeats is small enough to broadcast, which is checked;
beyond that they are joined by key.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import BASE, BYTE_VALUE, INVERSE, PIECE_BYTES, mix, powers, text_groups
from rolesift.llm.blocks import ask, bucket_count, new_block, pack, unpack
from rolesift.session import shared_dir

LENGTH = 400
ROLL = 16  # bytes under the rolling hash
REACH = 128
BEFORE = REACH - 1  # from a string's start to where its anchor may be
SHARED = LENGTH - BEFORE - REACH + 1  # bytes after an anchor that all its strings hold
MARGIN = 2048
MOST_BROADCAST_BYTES = 32 << 20
#: What a block is told of an anchor.
ONCE, REPEATED, OPEN, EXAMPLE = 0, 1, 2, 3
KEY = ["__text_a", "__text_b"]


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(7), text).alias(KEY[1])]


class Hashes:
    """Hashes of spans of some bytes, by differences of running sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, self.n), out=self.sums[1:])
        self.back = powers(INVERSE, self.n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spans = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _triggers(hashes: Hashes) -> np.ndarray:
    """Places whose rolling hash is the smallest of some REACH in a row; of equal
    ones the last."""
    size = hashes.n - ROLL + 1
    if size < REACH:
        return np.zeros(0, dtype=np.int64)
    rolled = mix((hashes.sums[ROLL:] - hashes.sums[:-ROLL]) * hashes.back[:size])
    last = np.uint64(2**32 - 1)
    ranked = (rolled & ~last) | (last - np.arange(size, dtype=np.uint64))
    whole = -(-size // REACH) * REACH
    padded = np.full(whole, np.uint64(2**64 - 1))
    padded[:size] = ranked
    rows = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: size - REACH + 1], ahead[REACH - 1 : size])
    place = (last - (least & last)).astype(np.int64)
    return place[np.concatenate([[True], place[1:] != place[:-1]])]


def _segments(data: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(begin, end, offset, bytes): the data in parts that overlap by MARGIN."""
    step = PIECE_BYTES - 2 * MARGIN
    for begin in range(0, len(data), step):
        end = min(begin + step, len(data))
        low, high = max(0, begin - MARGIN), min(len(data), end + MARGIN)
        yield begin, end, low, data[low:high]


def anchors(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of a group of texts laid end to end: the first and last start
    of their strings, and the two keys. Texts below LENGTH have none."""
    found: list[tuple[np.ndarray, ...]] = []
    for begin, end, offset, part in _segments(data):
        hashes = Hashes(part)
        place = _triggers(hashes) + offset
        previous = np.concatenate([[-(1 << 62)], place[:-1]])
        mine = (place >= begin) & (place < end)
        place, previous = place[mine], previous[mine]
        text = np.searchsorted(bounds, place, "right") - 1
        low = np.maximum(previous + 1 - BEFORE, bounds[text])
        high = np.minimum(place - BEFORE, bounds[text + 1] - LENGTH)
        some = low <= high
        place, low, high = place[some], low[some], high[some]
        shared = hashes.of(place - BEFORE - offset, place + SHARED - offset)
        together = hashes.of(low - offset, high + LENGTH - offset)
        found.append((low, high, shared, together))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        found = [(none, none, none.astype(np.uint64), none.astype(np.uint64))]
    low, high, shared, together = (np.concatenate(x) for x in zip(*found, strict=True))
    return {"low": low, "high": high, "shared": shared, "together": together}


def string_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the strings that start at low..high of each anchor, in order."""
    out = []
    for begin, end, offset, part in _segments(data):
        mine = (low >= begin) & (low < end)
        if not mine.any():
            continue
        starts = _runs(low[mine], high[mine]) - offset
        out.append(Hashes(part).of(starts, starts + LENGTH))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sizes = high - low + 1
    ends = np.cumsum(sizes)
    return np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct tuples in order of the first key, where each row's is, and
    whether it occurs more than once."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    ordered = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in ordered], axis=0)
    number = np.cumsum(new) - 1
    place = np.empty(len(order), dtype=np.int64)
    place[order] = number
    return [k[new] for k in ordered], place, np.bincount(number, minlength=int(new.sum())) > 1


# Blocks

BLOCKS = (
    "block string, a binary, b binary, sizes binary, low binary, spread binary, asks binary, "
    "place binary, keys array<binary>, n_keys bigint"
)


def _block(a, b, sizes, low, spread, asks, place, keys) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([new_block()]),
            *[pa.array([pack(x)], pa.binary()) for x in (a, b, sizes, low, spread, asks)],
            pa.array([pack(place.astype(np.int32))], pa.binary()),
            pa.array([[pack(k) for k in keys]], pa.list_(pa.binary())),
            pa.array([len(keys[0])], pa.int64()),
        ],
        names=[x.split(" ")[0] for x in BLOCKS.split(", ")],
    )


def _keys(batch: pa.RecordBatch, first: int, n: int) -> list[np.ndarray]:
    return [batch.column(k).to_numpy()[first : first + n] for k in KEY]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_groups(batch.column("text")):
            found = anchors(texts.data, texts.bounds)
            if not len(found["low"]):
                continue
            text = np.searchsorted(texts.bounds, found["low"], "right") - 1
            sizes = np.bincount(text, minlength=len(texts))
            keys, place, twice = _distinct([found["shared"], found["together"]])
            a, b = _keys(batch, texts.first, len(texts))
            # Of the texts with a key, the one with the smallest number speaks for it.
            who = (mix(a.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)[text]
            speaker = np.full(len(twice), 2**32 - 1, dtype=np.uint32)
            np.minimum.at(speaker, place, who)
            yield _block(
                a,
                b,
                sizes,
                (found["low"] - texts.bounds[text]).astype(np.uint32),
                (found["high"] - found["low"]).astype(np.uint8),
                (who == speaker[place]).astype(np.uint8),
                place,
                [*keys, twice.astype(np.uint8), speaker],
            )


def _slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys: buckets are ranges of hashes."""
    edges = [min((b << 64) // buckets, 2**64 - 1) for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(edges, dtype=np.uint64)), len(keys))


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                keys = [unpack(k) for k in batch.column("keys")[i].as_py()]
                at = _slices(keys[0], buckets)
                full = [b for b in range(buckets) if at[b] < at[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(full), pa.string()),
                        pa.array(full, pa.int32()),
                        pa.array(
                            [[pack(k[at[b] : at[b + 1]]) for k in keys] for b in full],
                            pa.list_(pa.binary()),
                        ),
                    ],
                    names=["block", "bucket", "keys"],
                )

    return run


def _split(values: np.ndarray, rows: list[np.ndarray]) -> Iterator[bytes]:
    at = 0
    for r in rows:
        yield pack(values[at : at + len(r)])
        at += len(r)


def _judge_anchors(rows: list[dict]) -> Iterator[bytes]:
    """Tells each block of each of its anchors' keys what holds."""
    parts = [[unpack(k) for k in r["keys"]] for r in rows]
    shared, together, twice, speaker = (np.concatenate(x) for x in zip(*parts, strict=True))
    pairs, place, many = _distinct([shared, together])
    many |= np.bincount(place, twice, len(many)) > 0
    group = np.cumsum(np.concatenate([[True], pairs[0][1:] != pairs[0][:-1]])) - 1
    kinds = np.bincount(group)
    alone = np.bincount(group, ~many) > 0  # some second key of the group is there once
    state = np.where(
        (kinds[group] == 1) & ~many,
        ONCE,
        np.where(~alone[group], REPEATED, np.where(many, EXAMPLE, OPEN)),
    ).astype(np.uint8)
    told = state[place]
    # One text asks about the strings of a repeated second key, for all.
    least = np.full(len(many), 2**32 - 1, dtype=np.uint32)
    np.minimum.at(least, place, speaker)
    told[(told == EXAMPLE) & (speaker != least[place])] = REPEATED
    return _split(told, [p[0] for p in parts])


def _judge_strings(rows: list[dict]) -> Iterator[bytes]:
    parts = [[unpack(k) for k in r["keys"]] for r in rows]
    strings, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, place, many = _distinct([strings])
    many |= np.bincount(place, twice, len(many)) > 0
    return _split(many[place].astype(np.uint8), [p[0] for p in parts])


def _told(row: dict) -> np.ndarray:
    replies = [unpack(r) for r in row["replies"] or []]
    return np.concatenate(replies) if replies else np.zeros(0, dtype=np.uint8)


STATES = "__text_a bigint, __text_b bigint, low binary, spread binary, state binary"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text with anything repeated: its anchors that are not alone."""
    for batch in batches:
        for row in batch.to_pylist():
            told = _told(row)[unpack(row["place"])]
            told[(told == EXAMPLE) & (unpack(row["asks"]) == 0)] = REPEATED
            low, spread, sizes = (unpack(row[c]) for c in ("low", "spread", "sizes"))
            a, b = unpack(row["a"]), unpack(row["b"])
            ends = np.cumsum(sizes)
            out: list[list] = [[], [], [], [], []]
            for t in np.flatnonzero(np.bincount(np.repeat(np.arange(len(sizes)), sizes), told != ONCE)):
                span = slice(ends[t] - sizes[t], ends[t])
                some = told[span] != ONCE
                values = (low[span][some], spread[span][some], told[span][some])
                for column, value in zip(out, (int(a[t]), int(b[t]), *map(pack, values)), strict=True):
                    column.append(value)
            yield _with_names(out, STATES)


def _with_names(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that ask about single strings of anchors that are still open."""
    for batch in batches:
        lows, spreads, states = (batch.column(c) for c in ("low", "spread", "state"))
        for texts in text_groups(batch.column("text")):
            rows = range(texts.first, texts.first + len(texts))
            low, spread, sizes = [], [], []
            for start, r in zip(texts.bounds, rows, strict=False):
                asked = unpack(states[r].as_py()) >= OPEN
                low.append(unpack(lows[r].as_py())[asked] + start)
                spread.append(unpack(spreads[r].as_py())[asked])
                sizes.append(int(asked.sum()))
            at = np.concatenate(low).astype(np.int64)
            wide = np.concatenate(spread)
            if not len(at):
                continue
            keys, place, twice = _distinct([string_hashes(texts.data, at, at + wide)])
            yield _block(
                *_keys(batch, texts.first, len(texts)),
                np.array(sizes, dtype=np.int64),
                (at - np.repeat(texts.bounds[:-1], sizes)).astype(np.uint32),
                wide,
                np.zeros(0, dtype=np.uint8),
                place,
                [*keys, twice.astype(np.uint8)],
            )


SPANS = "__text_a bigint, __text_b bigint, starts binary"


def _found_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the starts of its repeated strings among those asked about."""
    for batch in batches:
        for row in batch.to_pylist():
            told = _told(row)[unpack(row["place"])] > 0
            low = unpack(row["low"]).astype(np.int64)
            spread, sizes = unpack(row["spread"]).astype(np.int64), unpack(row["sizes"])
            starts = _runs(low, low + spread)
            text = np.repeat(np.repeat(np.arange(len(sizes)), sizes), spread + 1)
            a, b = unpack(row["a"]), unpack(row["b"])
            out: list[list] = [[], [], []]
            for t in np.unique(text[told]):
                first, last = np.searchsorted(text, [t, t + 1])
                mine = starts[first:last][told[first:last]]
                for column, value in zip(out, (int(a[t]), int(b[t]), pack(mine)), strict=True):
                    column.append(value)
            yield _with_names(out, SPANS)


# Removing

RESULT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
    "spans array<struct<start: bigint, end: bigint>>"
)


def covered(n: int, low: np.ndarray, high: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) of bytes covered by strings that start at any of
    low..high, or at one of ``single``."""
    starts = np.concatenate([low, single])
    ends = np.concatenate([high, single]) + LENGTH
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return np.stack([starts[first], ends[np.append(first[1:], len(starts)) - 1]], axis=1)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        lows, spreads, states, singles = (
            batch.column(c) for c in ("low", "spread", "state", "starts")
        )
        for texts in text_groups(batch.column("text")):
            out: list[list] = [[] for _ in range(5)]
            for k, (begin, end) in enumerate(zip(texts.bounds, texts.bounds[1:], strict=False)):
                r = texts.first + k
                data = texts.data[begin:end]
                low = high = single = np.zeros(0, dtype=np.int64)
                if states[r].is_valid:
                    sure = unpack(states[r].as_py()) == REPEATED
                    sure |= unpack(states[r].as_py()) == EXAMPLE
                    low = unpack(lows[r].as_py())[sure].astype(np.int64)
                    high = low + unpack(spreads[r].as_py())[sure]
                if singles[r].is_valid:
                    single = unpack(singles[r].as_py())
                spans = np.zeros((0, 2), dtype=np.int64)
                digest = hashlib.sha256()
                at = 0
                if len(low) or len(single):
                    spans = covered(len(data), low, high, single)
                    for start, stop in spans:
                        digest.update(data[at:start])
                        at = stop
                digest.update(data[at:])
                values = (
                    len(data),
                    int((spans[:, 1] - spans[:, 0]).sum()),
                    len(spans),
                    digest.hexdigest(),
                    [{"start": int(s), "end": int(e)} for s, e in spans],
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(texts.first, len(texts)),
                    *[pa.array(c, kind) for c, kind in zip(out, [*kinds, span], strict=True)],
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )


def _small(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """``df`` with the hint to broadcast it if it is no larger than the limit."""
    held = df.agg(
        F.sum(F.lit(64) + sum((F.length(c) for c in columns), F.lit(0)))
    ).first()[0]
    return F.broadcast(df) if (held or 0) <= limit else df


def find_repeats(docs: DataFrame, most_broadcast_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text), taken as UTF-8: its bytes, those
    inside a string of LENGTH bytes that also starts anywhere else in the table
    (in this text, a copy of it or another), the maximal runs of them, and the
    SHA-256 of the rest put together. Strings are judged on the input and never
    cross texts. A null text is empty; texts below LENGTH lose nothing; ids may
    be null or repeated, and each row is a text of its own; other columns are
    not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    path = shared_dir(spark, "passages")
    texts = docs.select("text", *text_key(F.col("text"))).filter(
        F.octet_length("text") >= LENGTH
    )
    texts.mapInArrow(_parse, BLOCKS).write.parquet(f"{path}/parse")
    blocks = spark.read.parquet(f"{path}/parse")

    def answered(blocks: DataFrame, judge, bytes_each: int) -> DataFrame:
        n_keys = int(blocks.agg(F.sum("n_keys")).first()[0] or 0)
        requests = blocks.select("block", "keys").mapInArrow(
            _requests(bucket_count(bytes_each * n_keys)),
            "block string, bucket int, keys array<binary>",
        )
        return blocks.drop("keys", "n_keys").join(ask(requests, judge), "block")

    states = answered(blocks, _judge_anchors, 18).mapInArrow(_states, STATES)
    # All copies of a text are told the same.
    states.dropDuplicates(KEY).write.parquet(f"{path}/texts")
    per_text = spark.read.parquet(f"{path}/texts")
    hinted = _small(per_text, ["low", "spread", "state"], most_broadcast_bytes)
    texts.join(hinted, KEY).mapInArrow(_strings, BLOCKS).write.parquet(f"{path}/strings")
    strings = spark.read.parquet(f"{path}/strings")
    found = answered(strings, _judge_strings, 8).mapInArrow(_found_strings, SPANS)
    repeats = per_text.join(found.dropDuplicates(KEY), KEY, "left")
    repeats.write.parquet(f"{path}/repeats")
    repeats = _small(
        spark.read.parquet(f"{path}/repeats"),
        ["low", "spread", "state"],
        most_broadcast_bytes // 2,
    )
    return (
        docs.select("doc_id", "text", *text_key(F.col("text")))
        .join(repeats, KEY, "left")
        .select("doc_id", "text", "low", "spread", "state", "starts")
        .mapInArrow(_remove, RESULT)
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

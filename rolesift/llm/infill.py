"""Fill-in-the-middle: documents cut at two unit bounds and put in another order.

A unit is a run of ASCII letters or one other character. Everything is done on
whole Arrow columns, some megabytes of text at a time: texts are split into lists
of units, the lists are flattened with the numbers of their parents, each unit
gets its ordinal in its parent and by it a role, the units of a role are filtered
out and put into lists again, and the lists are joined to pieces and the pieces to
an output. No row is looked at by itself, and no text leaves its task.

To split without losing anything, a byte that no UTF-8 text contains is put after
each unit; the pattern of a unit is spelled in bytes."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = rb"([A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFE][\x80-\xBF]*)"
BREAK = b"\xff"
GROUP_BYTES = 4 << 20
FORMS = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
)


@dataclass(frozen=True)
class Marks:
    """Strings before the pieces. They may not overlap each other or themselves,
    so that each stands once in an output, whatever is around it."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        if len(set(every)) < 3 or not all(every):
            raise ValueError("three different strings are needed")
        if any(a[-n:] == b[:n] for a in every for b in every for n in range(1, min(len(a), len(b)))):
            raise ValueError("the end of a mark may not begin a mark")
        if any(a != b and a in b for a in every for b in every):
            raise ValueError("no mark may stand in another")


def _modulo(value: pa.Array, by) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, by), by))


def _offsets(counts: pa.Array) -> pa.Array:
    zero = pa.array([0], pa.int64())
    return pa.concat_arrays([zero, pc.cumulative_sum(counts)]) if len(counts) else zero


def _split(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The units of all texts, the number of each one's text, and the number of
    units of each text."""
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\1" + BREAK)
    lists = pc.split_pattern(marked, pattern=BREAK)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # What is after the last break is empty.
    there = pc.greater(pc.binary_length(units), 0)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    return units.filter(there), parents.filter(there), n


def _joined(units: pa.Array, there: pa.Array, counts: pa.Array) -> pa.Array:
    """The units that are there, so many for each text, as one string a text."""
    lists = pa.LargeListArray.from_arrays(_offsets(counts), units.filter(there))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def _formed(batch: pa.RecordBatch, marks: Marks, plain_from: int, spm_below: int) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
    h1, h2, h3, h4 = (batch.column(f"h{k}") for k in range(1, 5))
    units, parents, n = _split(texts)
    spots = pc.add(n, 1)
    low, high = _modulo(h1, spots), _modulo(h2, spots)
    low, high = pc.min_element_wise(low, high), pc.max_element_wise(low, high)
    first = _offsets(n).slice(0, len(n))
    ordinal = pc.subtract(pa.array(np.arange(len(units))), first.take(parents))
    in_prefix = pc.less(ordinal, low.take(parents))
    in_suffix = pc.greater_equal(ordinal, high.take(parents))
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    prefix = _joined(units, in_prefix, low)
    middle = _joined(units, in_middle, pc.subtract(high, low))
    suffix = _joined(units, in_suffix, pc.subtract(n, high))

    names = [m.encode() for m in (marks.prefix, marks.suffix, marks.middle)]
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h3, 100), plain_from))
    for mark in names:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    spm = pc.less(_modulo(h4, 100), spm_below)
    p, s, m, none = (pa.scalar(x, pa.large_binary()) for x in (*names, b""))
    output = pc.if_else(
        plain,
        texts,
        pc.if_else(
            spm,
            pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
            pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none),
        ),
    )
    nothing = pa.scalar(None, pa.int64())

    def chars(piece: pa.Array) -> pa.Array:
        length = pc.utf8_length(piece.cast(pa.large_string())).cast(pa.int64())
        return pc.if_else(plain, nothing, length)

    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), n, form, chars(prefix), chars(middle), output.cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some megabytes of text; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
    ends, low = np.cumsum(sizes.to_numpy()), 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def fill_in_middle(
    docs: DataFrame,
    marks: Marks = Marks(),
    plain_percent: int = 10,
    spm_percent: int = 20,
    seed: int = 1,
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): the number of units ``n``, the
    ``form`` (plain, psm: prefix, suffix, middle; spm: suffix, prefix, middle),
    the characters of prefix and middle (null if plain) and the ``output``.

    Where a text is cut, and its form, are drawn from a hash of seed and doc_id,
    so they do not depend on how rows are dealt out, and repeated rows come out
    alike. A null text is empty, and an empty text, or one that contains a mark,
    stays plain. A null doc_id is drawn for like an empty string. Other columns
    are not read."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    drawn = [
        F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
        for k in range(4)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch):
                yield _formed(group, marks, 100 - plain_percent, spm_percent)

    return docs.select(F.col("doc_id").cast("long"), "text", *drawn).mapInArrow(run, FORMS)


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output of a form was made from. As marks do not overlap,
    each is found where it was put."""

    def piece(text: Column, mark: str, number: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(number))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substr(piece(output, second, 1), F.lit(len(first) + 1))
        rest = piece(output, second, 2)
        return head, piece(rest, marks.middle, 1), piece(rest, marks.middle, 2)

    prefix, suffix, middle = parts(marks.prefix, marks.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(marks.suffix, marks.prefix)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

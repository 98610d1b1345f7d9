"""Quality rules on repetition inside a text.

Every text is judged by itself, so this is one pass over the texts and nothing
is shuffled. Words are hashed in numpy; hashes of several n-gram lengths are
rolled over them, and a stretch of words counts as repeated if it lies inside an
n-gram that the same text holds twice or more. The rules compare the characters
covered that way, for each length, and the characters of repeated lines, with
the characters of the text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rolesift.llm.arrays import BLANK, Texts, mix, text_groups, window_hashes, words_of

#: Most of a text's characters in repeated n-grams, by length of the n-gram.
MOST_REPEATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MOST_LINE_CHARS = 0.20
MOST_LINES = 0.30
LEAST_WORDS = 50
MOST_REPEAT_WORDS = 0.50  # of a text's words, in repeated windows of three
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[
            T.StructField(name, T.LongType())
            for name in (
                "n_words",
                "word_chars",
                "n_symbols",
                "n_lines",
                "n_dup_lines",
                "dup_line_chars",
                "n_repeat_words",
            )
        ],
        T.StructField("repeated_shares", T.ArrayType(T.DoubleType())),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] = same
    twice[:-1] |= same
    out = np.empty_like(twice)
    out[order] = twice
    return out


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its lines with a word, those equal to an earlier one, and
    the latter's characters."""
    out = np.zeros((3, len(texts)), dtype=np.int64)
    for row, (low, high) in enumerate(zip(texts.bounds, texts.bounds[1:], strict=False)):
        lines = [x for x in texts.data[low:high].tobytes().split(b"\n") if x.strip(b" \t\v\f\r")]
        out[0, row] = len(lines)
        if len(lines) > len(set(lines)):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    out[1, row] += 1
                    out[2, row] += len(line.decode("utf-8", "replace"))
                else:
                    seen.add(line)
    return out[0], out[1], out[2]


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The measures of a group of texts, one value for each text."""
    data = texts.data
    words = words_of(texts)
    points = (data & 0xC0) != 0x80
    size = len(words.hashes)
    n_words = np.diff(words.bounds)
    before = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(points, out=before[1:])
    chars = (before[words.ends] - before[words.starts]).astype(np.int64)
    word_chars = _sums(points & ~BLANK[data], texts.bounds)
    n_symbols = _sums(SYMBOL[data], texts.bounds)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    left = np.repeat(words.bounds[1:], n_words) - np.arange(size)  # words from here on
    salt = mix(text_of.astype(np.uint64) + np.uint64(1))

    def repeats(n: int, where: np.ndarray) -> np.ndarray:
        """Starts, among ``where``, of n-grams that their text holds again."""
        where = where[left[where] >= n]
        if not len(where):
            return where
        keys = window_hashes(words.hashes, n)[where] ^ salt[where]
        return where[_repeated(keys)]

    threes = repeats(3, np.arange(size))
    n_repeat = _sums(_covered(threes, 3, size), words.bounds)
    shares = np.zeros((len(texts), len(MOST_REPEATED)))
    # A repeated n-gram starts with a repeated window of three words.
    where = threes
    for k, n in enumerate(MOST_REPEATED):
        where = repeats(n, where)
        covered = _sums(_covered(where, n, size) * chars, words.bounds)
        shares[:, k] = covered / np.maximum(word_chars, 1)
    n_lines, n_dup, dup_chars = _lines(texts)
    failed = (n_words < LEAST_WORDS) | (n_repeat > MOST_REPEAT_WORDS * n_words)
    good = (
        (shares <= np.array(list(MOST_REPEATED.values()))).all(axis=1)
        & (n_dup <= MOST_LINES * n_lines)
        & (dup_chars <= MOST_LINE_CHARS * word_chars)
    )
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "dup_line_chars": dup_chars,
        "n_repeat_words": n_repeat,
        "repeated_shares": shares,
        "base_failed": failed,
        "kept": ~failed & good,
    }


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for texts in text_groups(batch.column("text")):
            made = measure(texts)
            shares = made.pop("repeated_shares")
            columns = {name: pa.array(values) for name, values in made.items()}
            columns["repeated_shares"] = pa.array(list(shares), type=pa.list_(pa.float64()))
            columns["doc_id"] = ids.slice(texts.first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] for f in SCHEMA.fields], names=SCHEMA.names
            )


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), with its measures, the
    shares of characters in repeated n-grams in the order of ``MOST_REPEATED``,
    and the verdict ``kept``. A null or empty text has no words and fails; ids
    may be null or repeated; other columns are not read."""
    return docs.select("doc_id", "text").mapInArrow(_judge, SCHEMA)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

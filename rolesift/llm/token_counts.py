"""Token counts of documents without making their tokens.

A tokenizer splits a text into pre-tokens and then works on each by itself, so
the number of tokens of a document is the sum over its pre-tokens of what each
comes to. Every block of documents keeps the frequencies of pre-tokens of each
document, as numbers into the block's sorted list of distinct pre-tokens. The
lists meet by hash, where every distinct pre-token of the corpus is cut into pieces once;
the counts go back to the blocks that asked and are summed up there. Ids are
never kept, and texts are read once and not shuffled.
"""

from __future__ import annotations

import os
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import span_hashes, text_groups
from rolesift.llm.blocks import (
    ask,
    bucket_count,
    new_block,
    pack,
    pack_strings,
    unpack,
    unpack_strings,
)
from rolesift.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
CHUNK = 1 << 20  # characters split at a time
BLOCKS = (
    "block string, doc_ids array<bigint>, n_bytes binary, specials binary, sizes binary, "
    "which binary, times binary, pieces binary, held bigint"
)
BLOCK_BYTES = 16 << 20
_cut = regex.compile(r"(?<=\S) (?=\S)")
_split = regex.compile(PATTERN)


def vocabulary_path(name: str) -> str:
    """A file name of the public tokenizers' folder, or a path of one's own."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _chunks(text: str) -> Iterator[str]:
    """A text in parts that split into the same pre-tokens as the whole: cut
    before a single space between two other characters, where one always starts."""
    at = 0
    while len(text) - at > CHUNK:
        found = _cut.search(text, at + CHUNK)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def pre_token_counts(text: str, special: str = SPECIAL) -> tuple[Counter, int]:
    """Frequencies of a text's pre-tokens, and of the special string."""
    parts = text.split(special)
    counts: Counter = Counter()
    for part in parts:
        for chunk in _chunks(part):
            counts.update(_split.findall(chunk))
    return counts, len(parts) - 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for texts in text_groups(batch.column("text"), BLOCK_BYTES):
            index: dict[str, int] = {}
            which: list[int] = []
            times: list[int] = []
            sizes, specials = [], []
            for low, high in zip(texts.bounds, texts.bounds[1:], strict=False):
                text = texts.data[low:high].tobytes().decode("utf-8", "replace")
                counts, special = pre_token_counts(text)
                which += [index.setdefault(p, len(index)) for p in counts]
                times += counts.values()
                sizes.append(len(counts))
                specials.append(special)
            names = sorted(index)
            rank = np.empty(len(index), dtype=np.int64)
            rank[[index[p] for p in names]] = np.arange(len(names))
            # Numbers in order within each document, and their differences.
            document = np.repeat(np.arange(len(texts)), sizes)
            keys = (document << 32) | rank[np.array(which, dtype=np.int64)]
            order = np.argsort(keys)
            numbers = keys[order] & 0xFFFFFFFF
            steps = np.diff(numbers, prepend=0)
            first = np.flatnonzero(np.diff(document, prepend=-1))
            steps[first] = numbers[first]
            pieces = pa.array(names, pa.large_string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([new_block()]),
                    pa.array([ids.slice(texts.first, len(texts)).to_pylist()], pa.list_(pa.int64())),
                    pa.array([pack(np.diff(texts.bounds))], pa.binary()),
                    pa.array([pack(np.array(specials, dtype=np.int64))], pa.binary()),
                    pa.array([pack(np.array(sizes, dtype=np.int64))], pa.binary()),
                    pa.array([pack(steps.astype(np.uint32))], pa.binary()),
                    pa.array([pack(np.array(times, dtype=np.int32)[order])], pa.binary()),
                    pa.array([pack_strings(pieces)], pa.binary()),
                    pa.array([pieces.nbytes], pa.int64()),
                ],
                names=[x.split(" ")[0] for x in BLOCKS.split(", ")],
            )


def _bucket_of(pieces: pa.Array, buckets: int) -> np.ndarray:
    flat = pieces.cast(pa.large_binary())
    _, at, body = flat.buffers()
    bounds = np.frombuffer(at, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(body or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    hashes = span_hashes(data, bounds[:-1], bounds[1:])
    return (hashes % np.uint64(buckets)).astype(np.int32)


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                pieces = unpack_strings(batch.column("pieces")[i].as_py())
                if not len(pieces):
                    continue
                bucket = _bucket_of(pieces, buckets)
                order = np.argsort(bucket, kind="stable")
                found, starts = np.unique(bucket[order], return_index=True)
                places = np.split(order, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(found), pa.string()),
                        pa.array(found, pa.int32()),
                        pa.array(
                            [pack(np.diff(x, prepend=0).astype(np.uint32)) for x in places],
                            pa.binary(),
                        ),
                        pa.array([pack_strings(pieces.take(pa.array(x))) for x in places], pa.binary()),
                    ],
                    names=["block", "bucket", "places", "pieces"],
                )

    return run


def _count_pieces(vocabulary: str):
    """Answers a bucket: each distinct pre-token is cut into pieces once."""

    def answer(rows: list[dict]) -> Iterator[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        parts = [unpack_strings(r["pieces"]) for r in rows]
        coded = pa.concat_arrays(parts).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        counts = np.empty(len(distinct), dtype=np.uint32)
        for low in range(0, len(distinct), 10_000):
            part = tokenizer.encode_batch_fast(distinct[low : low + 10_000], add_special_tokens=False)
            counts[low : low + len(part)] = [len(x.ids) for x in part]
        each = counts[coded.indices.to_numpy()]
        at = 0
        for r, part in zip(rows, parts, strict=True):
            yield pack(np.concatenate([unpack(r["places"]), each[at : at + len(part)]]))
            at += len(part)

    return answer


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            steps, times = unpack(row["which"].as_py()), unpack(row["times"].as_py())
            sizes = unpack(row["sizes"].as_py())
            ends = np.cumsum(sizes)
            along = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
            which = along[1:] - np.repeat(along[ends - sizes], sizes)
            counts = np.zeros(int(which.max(initial=-1)) + 1, dtype=np.int64)
            for reply in row["replies"].as_py() or []:
                places, values = np.split(unpack(reply), 2)
                counts[np.cumsum(places, dtype=np.int64)] = values
            sums = np.zeros(len(which) + 1, dtype=np.int64)
            np.cumsum(counts[which] * times, out=sums[1:])
            tokens = sums[ends] - sums[ends - sizes] + unpack(row["specials"].as_py())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"].as_py(), pa.int64()),
                    pa.array(unpack(row["n_bytes"].as_py()), pa.int64()),
                    pa.array(tokens, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text).
    ``vocabulary`` is a byte-level file of the tokenizers library, by name or by
    a path that all executors have. A null text is empty: no bytes, no tokens.
    Ids may be null or repeated; other columns are not read; an empty table
    gives an empty result. Its special string counts as one token."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-counts")
    docs.select("doc_id", "text").mapInArrow(_blocks, BLOCKS).write.parquet(path)
    blocks = spark.read.parquet(path)
    held = blocks.agg(F.sum("held")).first()[0]
    buckets = bucket_count(int(held or 0))
    requests = blocks.select("block", "pieces").mapInArrow(
        _requests(buckets), "block string, bucket int, places binary, pieces binary"
    )
    replies = ask(requests, _count_pieces(vocabulary))
    return blocks.drop("pieces", "held").join(replies, "block", "left").mapInArrow(
        _sum_up, "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

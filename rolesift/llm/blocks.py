"""Questions that blocks of documents put to a table keyed by hash.

A map over the documents turns every few megabytes of text into one block and
writes it down: what it knows of its documents, and the distinct keys it asks
about, each once however often it occurs there. ``ask`` deals the keys out by
hash, so that all blocks' questions about a key meet in one bucket, answers them
there, and hands every block its answers in its own order.

Because a block asks about a key once, a key that holds a third of all rows is
one entry for each block, and a bucket's size depends on the number of distinct
keys in a block alone. Blocks are written to the shared folder, so a lost
executor costs the work of its open tasks only.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 6 << 20


def new_block() -> str:
    return uuid.uuid4().hex


def pack(values: np.ndarray) -> bytes:
    """An array of numbers as bytes, compressed plane by plane; see ``unpack``."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    planes = values.view(np.uint8).reshape(-1, width).T.tobytes()
    head = f"{values.dtype.str}:{len(values)}:".encode().ljust(24)
    return head + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    kind, n, _ = bytes(blob[:24]).decode().split(":")
    dtype, n = np.dtype(kind), int(n)
    if not n:
        return np.zeros(0, dtype)
    planes = pa.Codec("zstd").decompress(
        blob[24:], decompressed_size=n * dtype.itemsize, asbytes=True
    )
    flat = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n)
    return np.ascontiguousarray(flat.T).reshape(-1).view(dtype)


def pack_strings(strings: pa.Array) -> bytes:
    """An array of strings as bytes; neighbours should be alike."""
    flat = strings.cast(pa.large_binary())
    _, at, body = flat.buffers()
    bounds = np.frombuffer(at, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(body or b"", np.uint8)[bounds[0] : bounds[-1]]
    sizes = pack(np.diff(bounds).astype(np.uint32))
    head = f"{len(sizes)}:{len(data)}:".encode().ljust(32)
    return head + sizes + pa.Codec("zstd", 3).compress(data.tobytes(), asbytes=True)


def unpack_strings(blob: bytes) -> pa.Array:
    n, size, _ = bytes(blob[:32]).decode().split(":")
    sizes = unpack(blob[32 : 32 + int(n)])
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    data = b""
    if int(size):
        data = pa.Codec("zstd").decompress(
            blob[32 + int(n) :], decompressed_size=int(size), asbytes=True
        )
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers)


def grouped(
    batches: Iterator[pa.RecordBatch], key: str
) -> Iterator[tuple[object, list[dict]]]:
    """Rows of neighbouring equal keys, as dictionaries."""
    now, rows = None, []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        columns = {name: batch.column(name) for name in batch.schema.names}
        for i, k in enumerate(keys):
            if rows and k != now:
                yield now, rows
                rows = []
            now = k
            rows.append({name: column[i].as_py() for name, column in columns.items()})
    if rows:
        yield now, rows


def bucket_count(total_bytes: int, least: int = 12) -> int:
    return max(least, -(-total_bytes // BUCKET_BYTES))


def ask(
    requests: DataFrame,
    answer: Callable[[list[dict]], Iterator[bytes]],
) -> DataFrame:
    """``requests`` has a row (bucket, block, ...) for each block's questions in
    a bucket. All rows of a bucket go to ``answer`` together, which gives one
    reply for each in order. Returns (block, replies): the replies of a block
    in the order of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches, "bucket"):
            replies = list(answer(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["block"] for r in rows], pa.string()),
                    pa.array([bucket] * len(rows), pa.int32()),
                    pa.array(replies, pa.binary()),
                ],
                names=["block", "bucket", "reply"],
            )

    replies = (
        requests.repartition("bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(run, "block string, bucket int, reply binary")
    )
    return replies.groupBy("block").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bucket", "reply"))), lambda x: x["reply"]
        ).alias("replies")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

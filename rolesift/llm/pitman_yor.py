"""A hierarchical Pitman-Yor language model of words, over a whole corpus.

A word is drawn in the restaurant of its context; contexts share one parent, the
restaurant of words without context, and that one draws from a base over the
known words and one outcome for all others. The context is the word before, by
its 64-bit hash (the start of a text has its own): every word has a restaurant,
and restaurants, customers, dishes and tables all grow with the corpus.

Seating is sampled by Gibbs: the customers of one dish in one restaurant leave
and are seated again one after another (in groups beyond ``ONE_BY_ONE`` of
them), given everyone else; each new table sends a customer to the parent, where
the dish's customers are seated in the same way. Probabilities are averaged over
``SAMPLES`` seatings after ``BURN_IN`` sweeps.

How it is spread out. Blocks of documents keep their tokens as numbers into the
block's distinct words, and ask about each distinct (context, word) pair once. All that
is asked about a word meets in one bucket: the counts of its pairs, so its
dishes in every restaurant and in the parent. Buckets number the contexts they
hold and ask for their restaurants' totals, which are summed in buckets of
contexts. Buckets are sampled side by side; the restaurants' totals are exact
before the first sweep and after each sample, and follow the bucket's own growth
in between. Probabilities go back to the blocks, pair by pair. A word that holds
a third of all tokens is one entry for each block and context, and as a context
one for each bucket of words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.arrays import Texts, text_groups, words_of
from rolesift.llm.blocks import ask, bucket_count, grouped, new_block, pack, unpack
from rolesift.session import shared_dir

CONTEXTS = 4096  # only sizes a Corpus made by hand; score_documents has no such bound
SAMPLES = 3
BURN_IN = 3
STRENGTH = 1.0
ONE_BY_ONE = 64
FEW = 2  # rows of a block or bucket in a task, on average
END = np.uint64(0x2545F4914F6CDD1D)  # stands for the end of a text, and as a context for its start
BLOCKS = (
    "block string, doc_ids array<bigint>, held binary, sizes binary, tokens binary, "
    "words binary, n_tokens bigint"
)


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def _pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    steps = unpack(blob)
    return np.cumsum(steps, dtype=steps.dtype)


# Blocks of documents


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's words and of its end, and how many it has."""
    found = words_of(texts, lower=True)
    sizes = np.diff(found.bounds) + 1
    ends = np.cumsum(sizes) - 1
    token = np.empty(ends[-1] + 1, dtype=np.uint64)
    is_end = np.zeros(len(token), dtype=bool)
    is_end[ends] = True
    token[is_end], token[~is_end] = END, found.hashes
    return token, sizes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks keep their tokens as numbers of their words. Their pairs follow from
    that, and are found again where they are needed rather than kept."""
    for batch in batches:
        ids = batch.column("doc_id")
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for texts in text_groups(batch.column("text")):
            rows = len(texts)
            out = held[texts.first : texts.first + rows]
            token, sizes = _tokens(texts)
            words, word = np.unique(token, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([new_block()]),
                    pa.array([ids.slice(texts.first, rows).to_pylist()], pa.list_(pa.int64())),
                    pa.array([pack(out.astype(np.uint8))], pa.binary()),
                    pa.array([pack(sizes.astype(np.int64))], pa.binary()),
                    pa.array([pack(word.astype(np.int32))], pa.binary()),
                    pa.array([_pack_sorted(words)], pa.binary()),
                    pa.array([len(word)], pa.int64()),
                ],
                names=[x.split(" ")[0] for x in BLOCKS.split(", ")],
            )


def _pairs(tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's tokens: the word and the context of each of its pairs, in
    order, and the pair of each token. Every word of a block is a token."""
    word = unpack(tokens).astype(np.int64)
    n = int(word.max()) + 1
    keys = np.roll(word, 1)  # before a text is the end of another
    keys += word * n
    pairs, place = np.unique(keys, return_inverse=True)
    return pairs // n, pairs % n, place


def _slices(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted words: buckets are ranges of hashes."""
    edges = [min((b << 64) // buckets, 2**64 - 1) for b in range(buckets)]
    return np.append(np.searchsorted(words, np.array(edges, dtype=np.uint64)), len(words))


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                words = _unpack_sorted(batch.column("words")[i].as_py())
                held, sizes = (unpack(batch.column(c)[i].as_py()) for c in ("held", "sizes"))
                word, contexts, place = _pairs(batch.column("tokens")[i].as_py())
                learns = np.repeat(held == 0, sizes)
                counts = np.bincount(place[learns], minlength=len(word)).astype(np.int32)
                spread = np.bincount(word).astype(np.int32)
                at = _slices(words, buckets)
                pair_at = np.concatenate([[0], np.cumsum(spread, dtype=np.int64)])
                made: list[list] = [[] for _ in range(5)]
                numbers = []
                for b in range(buckets):
                    if at[b] == at[b + 1]:
                        continue
                    w = slice(at[b], at[b + 1])
                    p = slice(pair_at[at[b]], pair_at[at[b + 1]])
                    numbers.append(b)
                    own, context = np.unique(contexts[p], return_inverse=True)
                    parts = (
                        _pack_sorted(words[w]),
                        pack(spread[w]),
                        _pack_sorted(words[own]),
                        pack(context.astype(np.int32)),
                        pack(counts[p]),
                    )
                    for column, part in zip(made, parts, strict=True):
                        column.append(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(numbers), pa.string()),
                        pa.array(numbers, pa.int32()),
                        *[pa.array(column, pa.binary()) for column in made],
                    ],
                    names=[x.split(" ")[0] for x in REQUESTS.split(", ")],
                )

    return run


REQUESTS = (
    "block string, bucket int, words binary, spread binary, heads binary, contexts binary, "
    "counts binary"
)


# Buckets of words


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All requests of a bucket as one table of pairs, and for each block the
    places of its pairs and words in it."""
    for bucket, rows in grouped(batches, "bucket"):
        words = [_unpack_sorted(r["words"]) for r in rows]
        every = np.unique(np.concatenate(words))
        own = [_unpack_sorted(r["heads"]) for r in rows]
        heads = np.unique(np.concatenate(own))
        keys, counts = [], []
        for r, w, h in zip(rows, words, own, strict=True):
            word = np.repeat(np.searchsorted(every, w), unpack(r["spread"]))
            context = np.searchsorted(heads, h)[unpack(r["contexts"])]
            keys.append(word * len(heads) + context)
            counts.append(unpack(r["counts"]))
        pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        word, context = pairs // len(heads), pairs % len(heads)
        per_word = np.bincount(word, total, len(every)).astype(np.int64)
        taught = total > 0
        customers = np.bincount(context, total, len(heads)).astype(np.int64)
        tables = np.bincount(context[taught], minlength=len(heads))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([bucket], pa.int32()),
                pa.array([pack(word.astype(np.int32))], pa.binary()),
                pa.array([pack(context.astype(np.int32))], pa.binary()),
                pa.array([pack(total)], pa.binary()),
                pa.array([[r["block"] for r in rows]], pa.list_(pa.string())),
                pa.array(
                    # A block's pairs are in the bucket's order, so places ascend.
                    [[_pack_sorted(place[a:b].astype(np.int32)) for a, b in zip(at, at[1:], strict=False)]],
                    pa.list_(pa.binary()),
                ),
                pa.array([_pack_sorted(heads)], pa.binary()),
                pa.array([[pack(customers), pack(tables)]], pa.list_(pa.binary())),
                pa.array([len(heads)], pa.int64()),
                pa.array([int(total.sum())], pa.int64()),
                pa.array([int(taught.sum())], pa.int64()),
                pa.array([int((per_word > 0).sum())], pa.int64()),
                pa.array([int((per_word == 1).sum())], pa.int64()),
                pa.array([int((total == 1).sum())], pa.int64()),
                pa.array([int((total == 2).sum())], pa.int64()),
            ],
            names=[x.split(" ")[0] for x in MERGED.split(", ")],
        )


MERGED = (
    "bucket int, word binary, context binary, counts binary, blocks array<string>, "
    "places array<binary>, heads binary, own array<binary>, n_heads bigint, n_tokens bigint, "
    "n_tables bigint, n_words bigint, once bigint, pairs_once bigint, pairs_twice bigint"
)


# Totals of restaurants


def _parts(contexts: int, numbered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                heads = _unpack_sorted(batch.column("heads")[i].as_py())
                own = np.stack([unpack(x) for x in batch.column("own")[i].as_py()])
                if numbered:
                    at = np.append(np.searchsorted(heads, np.arange(contexts) << 32), len(heads))
                else:
                    at = _slices(heads, contexts)
                parts = [(b, slice(at[b], at[b + 1])) for b in range(contexts) if at[b] < at[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(parts), pa.string()),
                        pa.array([b for b, _ in parts], pa.int32()),
                        pa.array([_pack_sorted(heads[p]) for _, p in parts], pa.binary()),
                        pa.array([pack(own[:, p].ravel()) for _, p in parts], pa.binary()),
                    ],
                    names=["block", "bucket", "heads", "own"],
                )

    return run


def _totals(numbered: bool):
    def answer(rows: list[dict]) -> Iterator[bytes]:
        heads = [_unpack_sorted(r["heads"]) for r in rows]
        own = [unpack(r["own"]).reshape(-1, len(h)) for r, h in zip(rows, heads, strict=True)]
        every, place = np.unique(np.concatenate(heads), return_inverse=True)
        sums = np.zeros((len(own[0]), len(every)), dtype=np.int64)
        for total, values in zip(sums, np.concatenate(own, axis=1), strict=True):
            np.add.at(total, place, values)
        at = 0
        for h in heads:
            mine = place[at : at + len(h)]
            numbers = [] if numbered else [np.diff(mine + (rows[0]["bucket"] << 32), prepend=0)]
            yield pack(np.concatenate([*numbers, sums[:, mine].ravel()]))
            at += len(h)

    return answer


def of_all_buckets(buckets: DataFrame, contexts: int, numbered: bool) -> DataFrame:
    """(bucket, totals) for rows (bucket, heads, own): the sums of ``own``, which
    are arrays over ``heads``, with those of all other buckets that hold the
    same contexts. Contexts meet in as many buckets as ``contexts`` tells. Heads
    are hashes, and each gets a number that goes before its sums; or if
    ``numbered``, those numbers."""
    parts = buckets.select(F.col("bucket").cast("string").alias("block"), "heads", "own").mapInArrow(
        _parts(contexts, numbered), "block string, bucket int, heads binary, own binary"
    )
    return ask(parts, _totals(numbered)).select(
        F.col("block").cast("int").alias("bucket"), F.col("replies").alias("totals")
    )


def _read_totals(replies: list[bytes], rows: int) -> list[np.ndarray]:
    return [unpack(x).reshape(rows, -1) for x in replies]


@dataclass
class Corpus:
    """What is known of the whole corpus before sampling, and of those of its
    restaurants that are at hand."""

    by_context: np.ndarray  # customers of each restaurant at hand
    tables: np.ndarray  # its tables, one for each dish at first
    n_words: int  # distinct training tokens
    unseen: float  # base mass of the outcome for all other words
    discount: float  # of the contexts' restaurants
    root_discount: float
    buckets: int
    n_tokens: int | None = None  # customers of all restaurants
    n_tables: int | None = None  # and their tables

    def __post_init__(self) -> None:
        if self.n_tokens is None:
            self.n_tokens = int(self.by_context.sum())
        if self.n_tables is None:
            self.n_tables = int(self.tables.sum())


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)


def seat(
    customers: np.ndarray, join: np.ndarray, discount: float, rng: np.random.Generator
) -> np.ndarray:
    """Tables of dishes after their customers have been seated one after another:
    a customer opens a table with weight ``join`` (strength and discounted
    tables of the restaurant times the parent's probability) against the seated
    customers less a discount for each table. Vectorised over dishes; beyond
    ``ONE_BY_ONE`` customers those of a sixteenth are seated together."""
    order = np.argsort(-customers, kind="stable")
    n, new = customers[order], join[order]
    tables = (n > 0).astype(np.int64)
    seated = 1
    while True:
        active = int(np.searchsorted(-n, -seated, "left"))  # more than are seated
        if not active:
            break
        some = max(1, seated // 16) if seated >= ONE_BY_ONE else 1
        old = seated - discount * tables[:active]
        p = new[:active] / (new[:active] + np.maximum(old, 1e-12))
        if some == 1:
            tables[:active] += rng.random(active) < p
        else:
            tables[:active] += rng.binomial(np.minimum(some, n[:active] - seated), p)
        seated += some
    out = np.empty_like(tables)
    out[order] = tables
    return out


def _sampled(corpus: Corpus, seed: int):
    """Gibbs sweeps over the dishes of a bucket. With ``totals`` (numbers,
    customers, tables) the restaurants at hand are the bucket's, otherwise the corpus has
    them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                word, context, counts = (
                    unpack(batch.column(c)[i].as_py()) for c in ("word", "context", "counts")
                )
                own, asks = corpus, "totals" in batch.schema.names
                if asks:
                    known = _read_totals(batch.column("totals")[i].as_py(), 3)
                    numbers = np.concatenate([np.cumsum(x[0]) for x in known])
                    customers, tables = np.concatenate([x[1:] for x in known], axis=1)
                    own = replace(corpus, by_context=customers, tables=tables)
                rng = np.random.default_rng([seed, bucket])
                size = int(word.max(initial=-1)) + 1
                taught = np.flatnonzero(counts > 0)
                w, u, c = word[taught], context[taught].astype(np.int64), counts[taught]
                base = (1 - corpus.unseen) / max(corpus.n_words, 1)
                t = np.ones(len(c), dtype=np.int64)
                root = np.bincount(w, t, size).astype(np.int64)
                root_t = np.minimum(root, 1)
                first = max(int(t.sum()), 1)
                samples = []
                for sweep in range(BURN_IN + SAMPLES):
                    growth = t.sum() / first
                    tables = own.tables * growth
                    root_all = max(corpus.n_tables * growth, 1.0)
                    root_tables = float(root_t.sum()) * corpus.buckets
                    more = STRENGTH + corpus.root_discount * root_tables
                    parent = (
                        np.maximum(root - corpus.root_discount * root_t, 0) + more * base
                    ) / (STRENGTH + root_all)
                    t = seat(c, (STRENGTH + corpus.discount * tables[u]) * parent[w], corpus.discount, rng)
                    root = np.bincount(w, t, size).astype(np.int64)
                    root_t = seat(root, np.full(size, more * base), corpus.root_discount, rng)
                    if sweep >= BURN_IN:
                        samples.append((t, root_t))
                sums = [np.bincount(u, t, len(own.tables)).astype(np.int64) for t, _ in samples]
                roots = [int(r.sum()) for _, r in samples]
                columns = {
                    "bucket": batch.column("bucket").slice(i, 1),
                    "seats": pa.array([[pack(t.astype(np.uint32)) for t, _ in samples]], pa.list_(pa.binary())),
                    "root_seats": pa.array([[pack(r.astype(np.uint32)) for _, r in samples]], pa.list_(pa.binary())),
                }
                if asks:
                    columns |= {
                        "heads": pa.array([_pack_sorted(numbers)], pa.binary()),
                        "customers": pa.array([pack(customers)], pa.binary()),
                        "own": pa.array([[pack(x) for x in sums]], pa.list_(pa.binary())),
                        "n_tables": pa.array([[int(x.sum()) for x in sums]], pa.list_(pa.int64())),
                        "n_root": pa.array([roots], pa.list_(pa.int64())),
                    }
                else:
                    every = [[*x.tolist(), r] for x, r in zip(sums, roots, strict=True)]
                    columns["sums"] = pa.array([every], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return run


SEATED = (
    "bucket int, seats array<binary>, root_seats array<binary>, heads binary, customers binary, "
    "own array<binary>, n_tables array<bigint>, n_root array<bigint>"
)


def _answers(corpus: Corpus, totals: np.ndarray):
    """Replies to each block: log10 probabilities of its pairs, and the training
    counts of their words. ``totals`` are each sample's tables of the restaurants
    at hand, and of the parent; if the buckets bring theirs, of all restaurants
    together, and of the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                word, context, counts = (
                    unpack(batch.column(c)[i].as_py()) for c in ("word", "context", "counts")
                )
                context = context.astype(np.int64)
                customers, tables = corpus.by_context, totals[:, :-1]
                if "totals" in batch.schema.names:
                    customers = unpack(batch.column("customers")[i].as_py())
                    tables = np.concatenate(
                        _read_totals(batch.column("totals")[i].as_py(), len(totals)), axis=1
                    )
                size = int(word.max(initial=-1)) + 1
                per_word = np.bincount(word, counts, size).astype(np.int64)
                taught = counts > 0
                base = np.where(
                    per_word > 0, (1 - corpus.unseen) / max(corpus.n_words, 1), corpus.unseen
                )
                p = np.zeros(len(word))
                seats, roots = batch.column("seats")[i].as_py(), batch.column("root_seats")[i].as_py()
                for k in range(len(seats)):
                    t = np.zeros(len(word))
                    t[taught] = unpack(seats[k])
                    root_t = unpack(roots[k]).astype(np.float64)
                    root = np.bincount(word, t, size)
                    parent = (
                        root
                        - corpus.root_discount * root_t
                        + (STRENGTH + corpus.root_discount * totals[k, -1]) * base
                    ) / (STRENGTH + totals[k, :-1].sum())
                    p += (
                        counts
                        - corpus.discount * t
                        + (STRENGTH + corpus.discount * tables[k, context]) * parent[word]
                    ) / (STRENGTH + customers[context])
                score = np.log10(p / max(len(seats), 1)).astype(np.float32)
                blocks = batch.column("blocks")[i].as_py()
                replies = []
                for places in batch.column("places")[i].as_py():
                    place = _unpack_sorted(places)
                    replies.append((pack(score[place]), pack(per_word[word[place]])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks, pa.string()),
                        pa.array([batch.column("bucket")[i].as_py()] * len(blocks), pa.int32()),
                        pa.array([r[0] for r in replies], pa.binary()),
                        pa.array([r[1] for r in replies], pa.binary()),
                    ],
                    names=["block", "bucket", "scores", "counts"],
                )

    return run


SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def _sum_up(n_tokens: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                replies = batch.column("replies")[i].as_py()
                score = np.concatenate([unpack(r["scores"]) for r in replies]).astype(np.float64)
                count = np.concatenate([unpack(r["counts"]) for r in replies])
                base = np.log10((count + 1) / (n_tokens + 1 * (n_words + 1)))
                _, _, token = _pairs(batch.column("tokens")[i].as_py())
                sizes = unpack(batch.column("sizes")[i].as_py())
                held = unpack(batch.column("held")[i].as_py()).astype(bool)
                at = np.cumsum(sizes) - sizes  # no text is without tokens
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()),
                        pa.array(held),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((count > 0)[token].astype(np.int64), at)),
                        pa.array(np.full(len(sizes), n_tokens, dtype=np.int64)),
                        pa.array(np.add.reduceat(base[token], at)),
                        pa.array(np.add.reduceat(score[token], at)),
                    ],
                    names=[x.split(" ")[0] for x in SCORES.split(", ")],
                )

    return run


def score_documents(docs: DataFrame, held: Column | None = None, seed: int = 0) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its tokens (words, A-Z as a-z,
    and one end), those the training rows have, the training rows' number of
    tokens, the add-one unigram score and the model's, both log10. Rows for
    which ``held`` is true are scored but not learned from.

    A null or empty text is its end alone. Ids may be null or repeated; other
    columns are not read; an empty table gives an empty result. Without training
    rows the model is its base."""
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    path = shared_dir(spark, "pitman-yor")
    docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(_blocks, BLOCKS).write.parquet(
        f"{path}/blocks"
    )
    blocks = spark.read.parquet(f"{path}/blocks")
    n_blocks, n_all = blocks.agg(F.count("*"), F.sum("n_tokens")).first()
    buckets = bucket_count(4 * int(n_all or 0))
    # A row is some megabytes, and a task hands all of its rows to Python at once:
    # so few to a task that these fit in memory, however many there are.
    few_blocks, few_buckets = max(1, n_blocks // FEW), max(1, buckets // FEW)
    (
        blocks.select("block", "held", "sizes", "tokens", "words")
        .mapInArrow(_requests(buckets), REQUESTS)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(_merge, MERGED)
        .write.parquet(f"{path}/pairs")
    )
    merged = spark.read.parquet(f"{path}/pairs")
    known = merged.agg(
        *[
            F.sum(c).alias(c)
            for c in (
                "n_heads", "n_tokens", "n_tables", "n_words", "once", "pairs_once", "pairs_twice"
            )
        ]
    ).first()
    n_words, once = int(known["n_words"] or 0), int(known["once"] or 0)
    contexts = bucket_count(24 * int(known["n_heads"] or 0))
    none = np.zeros(0, dtype=np.int64)
    corpus = Corpus(
        by_context=none,  # each bucket has its own
        tables=none,
        n_words=n_words,
        # How likely a word is to be met for the first time, word by word.
        unseen=(once + 1) / (n_words + 2),
        discount=_discount(int(known["pairs_once"] or 0), int(known["pairs_twice"] or 0)),
        root_discount=_discount(once, max(n_words - once, 1)),
        buckets=max(buckets, 1),
        n_tokens=int(known["n_tokens"] or 0),
        n_tables=int(known["n_tables"] or 0),
    )
    (
        merged.select("bucket", "word", "context", "counts")
        .repartition(few_buckets, "bucket")
        .join(of_all_buckets(merged, contexts, False).repartition(few_buckets, "bucket"), "bucket")
        .mapInArrow(_sampled(corpus, seed), SEATED)
        .write.parquet(f"{path}/seats")
    )
    seated = spark.read.parquet(f"{path}/seats")
    totals = np.zeros((SAMPLES, 2))
    for r in (
        seated.select(F.posexplode(F.arrays_zip("n_tables", "n_root")).alias("k", "x"))
        .groupBy("k")
        .agg(F.sum("x.n_tables").alias("tables"), F.sum("x.n_root").alias("root"))
        .collect()
    ):
        totals[r["k"]] = r["tables"], r["root"]
    replies = (
        merged.select("bucket", "word", "context", "counts", "blocks", "places")
        .repartition(few_buckets, "bucket")
        .join(
            seated.select("bucket", "seats", "root_seats", "customers").repartition(
                few_buckets, "bucket"
            ),
            "bucket",
        )
        .join(of_all_buckets(seated, contexts, True).repartition(few_buckets, "bucket"), "bucket")
        .mapInArrow(
            _answers(corpus, totals), "block string, bucket int, scores binary, counts binary"
        )
        .repartition(few_blocks, "block")
        .groupBy("block")
        .agg(
            F.array_sort(F.collect_list(F.struct("bucket", "scores", "counts"))).alias("replies")
        )
    )
    return (
        blocks.select("block", "doc_ids", "held", "sizes", "tokens")
        .repartition(few_blocks, "block")
        .join(replies, "block")
        .mapInArrow(_sum_up(corpus.n_tokens, n_words), SCORES)
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base, over held-out rows and others."""
    def of(score: str) -> Column:
        return F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(
        of("score").alias("perplexity"), of("base_score").alias("base_perplexity")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

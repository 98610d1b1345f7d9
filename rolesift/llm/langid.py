"""Language of words and documents by a linear-chain conditional random field.

Every word of a text is a position of the chain and every learned language a
label. A word's score for a language is a sum of learned weights: of its affixes
and inner n-grams of bytes, of the word itself, and of a lexicon of words that
the sample knows from one language. Learned transitions carry evidence from word
to word, so that short or shared words follow their neighbours while a longer
stretch of another language is labelled as such: forward-backward gives every
word of code-switched text its own probabilities. A document's language is the
one its words expect most.

The model is fitted on a bounded sample of every language that labels a row
(``DOCS_PER_LANGUAGE`` documents of each, ``SNIPPET`` characters of each, chosen
by hash), with sequences spliced from two languages, so that transitions are
learned from switches at known places. Its size follows from the number of
languages alone, a quarter of a megabyte for each, and it goes to the tasks with
the function. Prediction covers whole texts in one pass, without a shuffle;
scores are computed once for each distinct word of some megabytes of text, and
the recursions run over all its positions in blocks. A text is one chain, however
long: the recursions work it off in parts of ``CELLS`` probabilities and carry
their vectors over each edge, forwards and then backwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.arrays import LOWER, Texts, mix, text_groups, words_of

DOCS_PER_LANGUAGE = 300
SNIPPET = 600
LEAST_SEEN = 2  # times a word must occur in the sample to enter the lexicon
SEQUENCE = 24  # words of a training sequence
WEIGHTS = 1 << 16
LONGEST = 4  # bytes of the longest n-gram, edges of the word included
STEPS = 60
RATE = 0.15
DECAY = 1e-4
BLOCK = 256
GROUP_BYTES = 3 << 20  # text handled at a time
CELLS = 1 << 22  # probabilities that the recursions hold at a time
SPARE = 2  # times the documents taken that the sample's range of hashes holds
UNKNOWN = "und"

#: Bytes that are not part of a word: ASCII but for letters.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[ord("a") : ord("z") + 1] = False
BETWEEN[ord("A") : ord("Z") + 1] = False
BETWEEN[0x80:] = False

PREDICTION = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_switches", T.LongType()),
    ]
)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature, language
    lexicon: np.ndarray  # sorted hashes of words
    lexicon_of: np.ndarray  # the language of each
    lexicon_weights: np.ndarray  # language of the lexicon, language
    transitions: np.ndarray  # from, to
    starts: np.ndarray


# Features and scores of distinct words


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes one after another, lowered, each between two marks, and
    where each word starts."""
    sizes = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.zeros(at[-1], dtype=np.uint8)
    inner = np.ones(at[-1], dtype=bool)
    inner[at[:-1]] = False
    inner[at[1:] - 1] = False
    shift = np.repeat(starts - at[:-1] - 1, sizes - 2)
    flat[inner] = LOWER[data[np.flatnonzero(inner) + shift]]
    flat[at[:-1]], flat[at[1:] - 1] = 2, 3
    return flat, at


def _features(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram, the features and the word of each."""
    word_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    coded = flat.astype(np.uint64) + np.uint64(1)
    running = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        size = len(flat) - n + 1
        if size <= 0:
            return
        running = running[:size] * np.uint64(0x100000001B3) + coded[n - 1 :]
        inside = word_of[:size] == word_of[n - 1 :]
        keys = mix(running[inside] + np.uint64(n << 56)) % np.uint64(WEIGHTS)
        yield keys.astype(np.int64), word_of[:size][inside]


def _word_features(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + np.uint64(99)) % np.uint64(WEIGHTS)).astype(np.int64)


def _in_lexicon(model: Model, hashes: np.ndarray) -> np.ndarray:
    """The number of the lexicon that has the word, or -1."""
    if not len(model.lexicon):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    return np.where(model.lexicon[at] == hashes, model.lexicon_of[at], -1)


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Scores (word, language) of distinct words."""
    scores = model.weights[_word_features(hashes)].astype(np.float64)
    flat, at = _spelled(data, starts, ends)
    for keys, word in _features(flat, at):
        for k in range(len(model.languages)):
            scores[:, k] += np.bincount(word, model.weights[keys, k], len(starts))
    known = _in_lexicon(model, hashes)
    scores[known >= 0] += model.lexicon_weights[known[known >= 0]]
    return scores


# The chain


def recursions(
    scores: np.ndarray,
    first: np.ndarray,
    transitions: np.ndarray,
    starts: np.ndarray,
    enter: np.ndarray | None = None,
    leave: np.ndarray | None = None,
    chains: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors (position, language) of many chains laid end
    to end, and the positions' factors; ``first`` marks where a chain begins.
    Each vector is scaled to sum to one. ``enter`` is the forward vector before
    the first position and ``leave`` the backward vector at the last, if the
    positions are a part of a longer chain.

    The recursions run in blocks handled side by side: products of each block's
    steps, then from block to block, then inside the blocks. It is the plain
    recursion in another order of multiplication. With ``chains``, the length of
    each, a chain is a block, and products are not needed."""
    n, k = scores.shape
    if chains is None:
        width = int(min(BLOCK, max(1, n**0.5)))
        sizes = np.minimum(width, n - np.arange(0, n, width))
    else:
        width, sizes = int(chains.max()), chains
    blocks = len(sizes)
    filled = np.arange(width) < sizes[:, None]
    e = np.ones((blocks, width, k))
    e[filled] = np.exp(scores - scores.max(axis=1, keepdims=True))
    begins = np.zeros((blocks, width), dtype=bool)
    begins[filled] = first
    e = np.ascontiguousarray(e.swapaxes(0, 1))
    begins, idle = np.ascontiguousarray(begins.T), np.ascontiguousarray(~filled.T)
    a = np.exp(transitions - transitions.max())
    s = np.exp(starts - starts.max())
    entering, leaving = np.ones((blocks, k)), np.ones((blocks, k))
    if enter is not None:
        entering[0] = enter
    if leave is not None:
        leaving[-1] = leave
    if chains is None and blocks > 1:
        product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in range(width):
            step = (product.reshape(-1, k) @ a).reshape(blocks, k, k)
            if begins[t].any():
                step[begins[t]] = product[begins[t]].sum(axis=2)[:, :, None] * s
            step *= e[t][:, None, :]
            step[idle[t]] = product[idle[t]]
            product = step / step.max(axis=(1, 2), keepdims=True)
        for b in range(1, blocks):
            v = entering[b - 1] @ product[b - 1]
            entering[b] = v / v.sum()
        for b in range(blocks - 1, 0, -1):
            v = product[b] @ leaving[b]
            leaving[b - 1] = v / v.sum()
    forward, backward = np.empty((width, blocks, k)), np.empty((width, blocks, k))
    alpha = entering
    for t in range(width):
        step = alpha @ a
        if begins[t].any():
            step[begins[t]] = s
        step *= e[t]
        step[idle[t]] = alpha[idle[t]]
        forward[t] = alpha = step / step.sum(axis=1, keepdims=True)
    beta = leaving
    for t in range(width - 1, -1, -1):
        backward[t] = beta
        step = (beta * e[t]) @ a.T
        step[begins[t]] = 1.0
        step[idle[t]] = beta[idle[t]]
        beta = step / step.sum(axis=1, keepdims=True)
    return tuple(x.swapaxes(0, 1)[filled] for x in (forward, backward, e))


def marginals(
    scores: np.ndarray,
    first: np.ndarray,
    transitions: np.ndarray,
    starts: np.ndarray,
    row: np.ndarray | None = None,
) -> np.ndarray:
    """Probabilities (position, language) by forward-backward; ``row`` is the row
    of ``scores`` that each position has, if they are not in order."""
    n, k = len(first), scores.shape[1]
    p = np.empty((n, k))
    size = max(1, CELLS // max(k, 1))
    lows = range(0, n, size)

    def part(low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        span = slice(low, low + size)
        own = scores[span] if row is None else scores[row[span]]
        return own, first[span], transitions, starts

    enters = [np.ones(k)]
    for low in lows[:-1]:
        enters.append(recursions(*part(low), enter=enters[-1])[0][-1])
    leave = np.ones(k)
    for low, enter in zip(reversed(lows), reversed(enters), strict=False):
        forward, backward, factors = recursions(*part(low), enter, leave)
        both = forward * backward
        p[low : low + size] = both / both.sum(axis=1, keepdims=True)
        leave = (backward[0] * factors[0]) @ np.exp(transitions - transitions.max()).T
        leave = np.ones(k) if first[low] else leave / leave.sum()
    return p


# Fitting


def fit(samples: list[tuple[str, str]], seed: int = 0) -> Model:
    """A model from (language, snippet) pairs; the order of pairs is no matter. It
    runs on the driver, some chains at a time: memory grows with the number of
    languages, time with its square and with the pairs."""
    samples = sorted(samples)
    languages = sorted({lang for lang, _ in samples})
    texts = next(text_groups(pa.array([t for _, t in samples], pa.large_string()), 1 << 40), None)
    if texts is None:
        return Model([], np.zeros((WEIGHTS, 0), np.float32), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    words = words_of(texts, lower=True, blank=BETWEEN)
    lang_of = np.array([languages.index(lang) for lang, _ in samples])
    label = np.repeat(lang_of, np.diff(words.bounds))
    hashes, where, word = np.unique(words.hashes, return_index=True, return_inverse=True)
    k, v = len(languages), len(hashes)
    # The lexicon: words seen in one language only.
    seen = np.zeros((v, k), dtype=np.int64)
    np.add.at(seen, (word, label), 1)
    alone = ((seen > 0).sum(axis=1) == 1) & (seen.sum(axis=1) >= LEAST_SEEN)
    model = Model(
        languages,
        np.zeros((WEIGHTS, k), np.float32),
        hashes[alone],
        seen[alone].argmax(axis=1),
        np.zeros((k, k)),
        np.zeros((k, k)),
        np.zeros(k),
    )
    # Sequences of one language, and as many spliced from two.
    rng = np.random.default_rng(seed)
    runs = [
        np.arange(low + i, min(low + i + SEQUENCE, high))
        for low, high in zip(words.bounds, words.bounds[1:], strict=False)
        for i in range(0, high - low, SEQUENCE)
    ]
    if not runs:
        return Model([], np.zeros((WEIGHTS, 0), np.float32), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    pairs = rng.permutation(len(runs))
    spliced = [
        np.concatenate([runs[a][: 1 + int(rng.integers(len(runs[a])))], runs[b]])[:SEQUENCE]
        for a, b in zip(pairs, np.roll(pairs, 1), strict=True)
    ]
    chains = runs + spliced
    place = np.concatenate(chains)
    lengths = np.array([len(c) for c in chains])
    ends = np.cumsum(lengths)
    first = np.zeros(len(place), dtype=bool)
    first[ends - lengths] = True
    token, truth = word[place], label[place]
    flat, at = _spelled(texts.data, words.starts[where], words.ends[where])
    spelled = [*_features(flat, at), (_word_features(hashes), np.arange(v))]
    keys, owner = (np.concatenate(x) for x in zip(*spelled, strict=True))
    used, keys = np.unique(keys, return_inverse=True)
    lexicon = _in_lexicon(model, hashes)
    inside = np.flatnonzero(lexicon >= 0)
    observed = np.zeros((k, k))
    np.add.at(observed, (truth[:-1][~first[1:]], truth[1:][~first[1:]]), 1)
    began = np.bincount(truth[first], minlength=k).astype(float)
    params = [np.zeros((len(used), k)), model.lexicon_weights, model.transitions, model.starts]
    squares = [np.full_like(p, 1e-8) for p in params]
    some = max(1, CELLS // (k * SEQUENCE))
    parts = [
        (lengths[i : i + some], slice(ends[i] - lengths[i], ends[min(i + some, len(ends)) - 1]))
        for i in range(0, len(lengths), some)
    ]
    for _ in range(STEPS):
        w, lex, trans, start = params
        scores = np.stack([np.bincount(owner, w[keys, j], v) for j in range(k)], axis=1)
        scores[inside] += lex[lexicon[inside]]
        by_word, steps, begun = np.zeros((v, k)), np.zeros((k, k)), np.zeros(k)
        a = np.exp(trans - trans.max())
        for sizes, span in parts:
            words_, begins = token[span], first[span]
            forward, backward, factors = recursions(
                scores[words_], begins, trans, start, chains=sizes
            )
            p = forward * backward
            p /= p.sum(axis=1, keepdims=True)
            begun += p[begins].sum(axis=0)
            # Expected steps inside chains: forward, transition, what follows.
            on = np.flatnonzero(~begins[1:])
            after = (factors * backward)[on + 1]
            total = ((forward[on] @ a) * after).sum(axis=1, keepdims=True)
            steps += a * ((forward[on] / total).T @ after)
            p[np.arange(len(p)), truth[span]] -= 1
            by_word += np.stack([np.bincount(words_, p[:, j], v) for j in range(k)], axis=1)
        grads = [
            np.stack([np.bincount(keys, by_word[owner, j], len(used)) for j in range(k)], axis=1),
            np.zeros((k, k)),
            steps - observed,
            begun - began,
        ]
        np.add.at(grads[1], lexicon[inside], by_word[inside])
        for param, square, grad in zip(params, squares, grads, strict=True):
            grad = grad / len(place) + DECAY * param
            square += grad**2
            param -= RATE * grad / np.sqrt(square)
    model.weights[used] = params[0]
    return model


def sample(docs: DataFrame, usable: Column) -> list[tuple[str, str]]:
    """(language, snippet) of a bounded number of rows of each language of ``docs``
    (doc_id, text, lang) for which ``usable`` holds: those with the least hashes
    of the id, so the same rows every time. Documents are counted first; then
    only those in a range of hashes that holds ``SPARE`` times as many as are
    taken are ordered, so no task meets more, however many rows a language has.
    The driver holds a row for each language, and the sample."""
    rows = docs.filter(usable & F.col("lang").isNotNull())
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.select("lang", "text", order.alias("order"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("order").alias("least"))
    wanted = [
        (r["lang"], min(1.0, SPARE * DOCS_PER_LANGUAGE / r["n"]), r["least"])
        for r in counts.collect()
    ]
    if not wanted:
        return []
    ranges = docs.sparkSession.createDataFrame(wanted, "lang string, share double, least bigint")
    at = F.col("order").cast("double") / F.lit(2.0**64) + 0.5
    # Somewhere in the text, by hash, so that openings do not stand for texts.
    room = F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1
    snippet = F.substring("text", (F.pmod("order", room) + 1).cast("int"), F.lit(SNIPPET))
    picked = (
        rows.join(F.broadcast(ranges), "lang")
        .filter((at <= F.col("share")) | (F.col("order") == F.col("least")))
        .select("lang", "order", snippet.alias("snippet"))
        .withColumn(
            "n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "snippet"))
        )
        .filter((F.col("n") <= DOCS_PER_LANGUAGE) & F.col("snippet").isNotNull())
    )
    return [(r["lang"], r["snippet"]) for r in picked.select("lang", "snippet").collect()]


# Predicting


def label_words(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (word, language) of all words of a group of texts, and the
    bounds of each text's words."""
    words = words_of(texts, lower=True, blank=BETWEEN)
    hashes, where, word = np.unique(words.hashes, return_index=True, return_inverse=True)
    scores = word_scores(model, texts.data, words.starts[where], words.ends[where], hashes)
    first = np.zeros(len(word), dtype=bool)
    first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
    p = marginals(scores, first, model.transitions, model.starts, word)
    return p, words.bounds


def predict(model: Model, texts: Texts) -> dict[str, np.ndarray]:
    """For each text the language its words expect most, its mean probability
    over them, how sure the words' own labels are (the mean of each word's largest
    probability, whichever languages they are), the number of words, and how often the most probable language
    changes from one word to the next. Languages are numbers, -1 for none."""
    rows = len(texts)
    if not model.languages:
        none = np.zeros(rows, dtype=np.int64)
        zero = np.zeros(rows)
        return {"lang": none - 1, "score": zero, "sure": zero, "words": none, "switches": none}
    p, bounds = label_words(model, texts)
    n = np.diff(bounds)
    sums = np.zeros((rows, len(model.languages)))
    sure = np.zeros(rows)
    filled = n > 0
    if filled.any():
        sure[filled] = np.add.reduceat(p.max(axis=1), bounds[:-1][filled]) / n[filled]
        sums[filled] = np.add.reduceat(p, bounds[:-1][filled], axis=0)
    best = p.argmax(axis=1)
    turn = np.zeros(len(best) + 1, dtype=np.int64)
    turn[1:-1] = best[1:] != best[:-1]
    turn[bounds] = 0  # not across texts
    before = np.concatenate([[0], np.cumsum(turn)])
    lang = np.where(filled, sums.argmax(axis=1), -1)
    score = np.where(filled, sums.max(axis=1) / np.maximum(n, 1), 0.0)
    return {
        "lang": lang,
        "score": np.clip(score, 0.0, 1.0),
        "sure": np.clip(sure, 0.0, 1.0),
        "words": n,
        "switches": before[bounds[1:]] - before[bounds[:-1]],
    }


def _predictions(model: Model):
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("held_out")
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            for texts in text_groups(batch.column("text"), GROUP_BYTES):
                rows = slice(texts.first, texts.first + len(texts))
                found = predict(model, texts)
                known = letter[rows] & (found["lang"] >= 0)
                lang = np.where(known, found["lang"], len(names) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(rows.start, len(texts)),
                        held.slice(rows.start, len(texts)),
                        names.take(pa.array(lang)),
                        pa.array(np.where(known, found["score"], 0.0)),
                        pa.array(found["words"], pa.int64()),
                        pa.array(found["switches"], pa.int64()),
                    ],
                    names=PREDICTION.names,
                )

    return run


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit_on(docs: DataFrame) -> Model:
    return fit(sample(docs, ~held_out(F.col("doc_id")) & has_letter(F.col("text"))))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A prediction for each row of ``docs`` (doc_id, text): its language, ``und``
    if the text is null or has no letter or nothing was learned; the mean
    probability of that language over its words (0 for ``und``); words and
    switches of language. A text is one chain, whatever its length. Other columns
    are not read."""
    return docs.select(
        "doc_id",
        "text",
        held_out(F.col("doc_id")).alias("held_out"),
        has_letter(F.col("text")).alias("letter"),
    ).mapInArrow(_predictions(model), PREDICTION)


def _identified(model: Model, text: str, letter: str, least_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(letter).to_numpy(zero_copy_only=False).astype(bool)
            for texts in text_groups(batch.column(text), GROUP_BYTES):
                rows = slice(texts.first, texts.first + len(texts))
                found = predict(model, texts)
                keep[rows] &= (found["lang"] >= 0) & (found["sure"] >= least_score)
            kept = batch.filter(pa.array(keep))
            yield kept.select([n for n in kept.schema.names if n != letter])

    return run


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, whose words' languages are known with at
    least that mean probability. Nothing is rejected for the language it is in, nor
    for changing between languages."""
    flag = "has_letter"
    while flag in docs.columns:
        flag += "_"
    return docs.withColumn(flag, has_letter(F.col("text"))).mapInArrow(
        _identified(model, "text", flag, least_score), docs.schema
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""SentencePiece ids of texts, and texts of ids, by a prefix table.

A merge-type (BPE) model joins, again and again, the two neighbouring pieces whose
joint piece has the highest score, the leftmost of equals. Which pieces come out
can be told without merging. Two pieces that are neighbours in a result stay
apart also when they are all there is: no merge has crossed their bounds, and
inside them the same merges are best whatever stands around. The other way round,
pieces of which each two neighbours stay apart when alone are the result, since
the first merge across a bound would also have been made with those two alone.

So every prefix of a word has one last piece: the only one of the pieces ending
there that is compatible with the last piece of what is before it. An automaton
finds the pieces that end at each place; two pieces are tested by merging their
few characters, once for each pair and task; the table of last pieces, read from
the end, gives the ids. The time is linear in the word, and nothing is kept of a
prefix but its last piece.

No merge crosses two neighbouring characters that stand side by side in no piece.
There a text is cut into words, and each distinct word of some megabytes of text
is encoded once."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from rolesift.llm.token_counts import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # what a model writes for a space
GROUP_BYTES = 4 << 20
#: Bounds of what a task remembers, all of which it can find again.
KNOWN_WORDS, KNOWN_WORD_BYTES, KNOWN_PAIRS = 300_000, 64, 400_000
CHUNK_BYTES = 256 << 10  # of words encoded at a time
ENCODED = "doc_id bigint, ids array<int>"
DECODED = "doc_id bigint, ids array<int>, decoded string"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a merge-type model by id; ``scores`` of those that are merged
    to, ``bytes_at`` the id of byte 0 or -1, ``unknown`` the id of no piece."""

    pieces: tuple[str, ...]
    scores: dict[str, float] = field(repr=False)
    ids: dict[str, int] = field(repr=False)
    bytes_at: int
    unknown: int
    control: frozenset[int]

    def together(self) -> np.ndarray:
        """For two neighbouring bytes of a text, whether a piece can have both
        characters. Bytes of characters beyond ASCII are taken to go with all,
        but for a space, if all pieces have theirs in front."""
        found = np.zeros((256, 256), dtype=bool)
        found[128:, :] = found[:, 128:] = True
        space = ord(" ")
        if not any(SPACE in p.lstrip(SPACE) for p in self.scores):
            found[128:, space] = False
        for piece in self.scores:
            raw = piece.replace(SPACE, " ").encode()
            for x, y in zip(raw, raw[1:], strict=False):
                if x < 128 and y < 128:
                    found[x, y] = True
        return found


def load(model: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file: a path, or a name of the public
    tokenizers. Models that change texts before encoding, other than by a space
    in front, or that have unused pieces, are refused, and so are those of other
    types, as far as their encoding of some probes tells."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))
    n = library.get_piece_size()
    pieces = tuple(library.id_to_piece(i) for i in range(n))
    special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i)}
    byte = [i for i in range(n) if library.is_byte(i)]
    if byte and byte != list(range(byte[0], byte[0] + 256)):
        raise ValueError("the pieces of bytes are not in a row")
    if any(library.is_unused(i) for i in range(n)):
        raise ValueError("unused pieces")
    merged = [i for i in range(n) if i not in special and not library.is_byte(i)]
    vocabulary = Vocabulary(
        pieces=pieces,
        scores={pieces[i]: library.get_score(i) for i in merged},
        ids={pieces[i]: i for i in merged},
        bytes_at=byte[0] if byte else -1,
        unknown=library.unk_id(),
        control=frozenset(i for i in special if library.is_control(i)),
    )
    encoder = Encoder(vocabulary)
    for probe in ("a  b ", " \n\tAﬁ½́e▁x", "the 12 internationalisation", "\x00"):
        if encoder.encode(probe) != library.encode(probe):
            raise ValueError(f"{model} is not a merge-type model that leaves texts as they are")
    return vocabulary


class Encoder:
    """Ids of texts. Remembers what it found out about pairs of pieces.

    Pieces are their ids here; a character without a piece is a number below
    ``START``, which stands for the start of a word."""

    START = -1
    #: Between words; no text has it, and so no piece.
    BETWEEN = "\ud800"

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.sizes = [len(p) for p in vocabulary.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.scores:
            self.automaton.add_word(piece, vocabulary.ids[piece])
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def name(self, number: int) -> str:
        if number == self.START:
            return ""
        return self.vocabulary.pieces[number] if number >= 0 else chr(-number - 2)

    def merged(self, text: str) -> list[str]:
        """The pieces of a few characters, by merging them."""
        scores, parts = self.vocabulary.scores, list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether two pieces stay as they are side by side. At the start of a
        word the piece has to come out by itself."""
        pair = [self.name(before), self.name(piece)]
        return self.merged("".join(pair)) == [p for p in pair if p]

    def _table(self, words: str) -> array:
        """For each prefix its last piece; ``START`` after what is between words."""
        codes = -2 - np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        codes[codes == -2 - ord(self.BETWEEN)] = self.START
        last = array("i", [self.START])
        last.frombytes(codes.tobytes())
        known, sizes, n = self.known, self.sizes, len(self.sizes)
        if len(known) >= KNOWN_PAIRS:
            known.clear()
        found = known.get
        for end, piece in self.automaton.iter(words):
            # Below zero the character alone, until a piece fits.
            if last[end + 1] < 0:
                before = last[end + 1 - sizes[piece]]
                fits = found(before * n + piece)
                if fits is None:
                    fits = known[before * n + piece] = self.fits(before, piece)
                if fits:
                    last[end + 1] = piece
        return last

    def numbers(self, words: str) -> np.ndarray:
        """The pieces of words, and ``START`` between two of them."""
        last, sizes, at, back = self._table(words), self.sizes, len(words), []
        while at:
            piece = last[at]
            back.append(piece)
            at -= sizes[piece] if piece >= 0 else 1
        return np.array(back, dtype=np.int32)[::-1]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. A character
        without a piece is its bytes, if the model has those, and else unknown."""
        ids = self.numbers(self.BETWEEN.join(words))
        word = np.cumsum(ids == self.START)
        word, ids = word[ids != self.START], ids[ids != self.START]
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            v = self.vocabulary
            parts, low = [], 0
            sizes = np.ones(len(ids), dtype=np.int64)
            for k in strange:
                raw = self.name(int(ids[k])).encode()
                one = [v.bytes_at + x for x in raw] if v.bytes_at >= 0 else [v.unknown]
                parts += [ids[low:k], np.array(one, dtype=np.int32)]
                sizes[k], low = len(one), k + 1
            ids, word = np.concatenate([*parts, ids[low:]]), np.repeat(word, sizes)
        return ids, np.bincount(word, minlength=len(words))

    def split(self, word: str) -> list[str]:
        """The pieces of a word or text, spaces written as the model does."""
        return [self.name(int(n)) for n in self.numbers(word)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, in one go."""
        return self.ids([SPACE + text.replace(" ", SPACE)])[0].tolist() if text else []


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings, and their bounds."""
    _, at, body = texts.buffers()
    bounds = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _words(data: np.ndarray, bounds: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Where the words start, and the end of the last."""
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[1:-1] = ~together[data[:-1], data[1:]]
    starts[bounds] = True
    return np.append(np.flatnonzero(starts[:-1]), len(data))


class _Words:
    """Ids of distinct words, many at a time. Remembers short ones."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.known: dict[bytes, bytes] = {}

    def _find(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace").replace(" ", SPACE) for w in new]
        ids, sizes = self.encoder.ids(texts)
        ends, raw = (4 * np.cumsum(sizes)).tolist(), ids.astype(np.int32).tobytes()
        self.known.update(
            zip(new, [raw[low:high] for low, high in zip([0, *ends], ends, strict=False)], strict=True)
        )

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit numbers."""
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        chunk, size = [], 0
        for word in words:
            if word not in self.known:
                chunk.append(word)
                size += len(word)
                if size >= CHUNK_BYTES:
                    self._find(chunk)
                    chunk, size = [], 0
        if chunk:
            self._find(chunk)
        found = [self.known[w] for w in words]
        for word in words:
            if len(word) > KNOWN_WORD_BYTES:
                del self.known[word]
        return found


def _ids(texts: pa.Array, words: _Words, together: np.ndarray) -> pa.Array:
    """Lists of ids of an array of large strings."""
    # With a space in front, and the model's own mark read as a space.
    front = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
    none = pa.scalar("", pa.large_string())
    texts = pc.replace_substring(pc.binary_join_element_wise(front, texts, none), SPACE, " ")
    data, bounds = _flat(texts)
    starts = _words(data, bounds, together)
    every = pa.Array.from_buffers(
        pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]
    ).dictionary_encode()
    found = words(every.dictionary.to_pylist())
    which = every.indices.to_numpy()
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.int32)
    firsts = np.cumsum(sizes) - sizes
    counts = sizes[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(firsts[which] - ends[:-1], counts) + np.arange(ends[-1])
    # Words before each text's start, and so the ids before it.
    offsets = ends[np.searchsorted(starts[:-1], bounds)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[at]))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ``ids`` for each row of ``docs`` (doc_id, text): what the
    library gives without begin and end. A null text is empty and has none;
    repeated rows come out alike. Other columns are not read. Nothing is
    shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, together = _Words(Encoder(vocabulary)), vocabulary.together()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for part in _slices(batch, sizes):
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), _ids(texts, words, together)], names=["doc_id", "ids"]
                )

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, ENCODED)


class Decoder:
    """Texts of ids: a table of what each id stands for, and for each once more
    what it stands for in front, where one space is taken away."""

    UNKNOWN = " ⁇ ".encode()

    def __init__(self, vocabulary: Vocabulary) -> None:
        inside, front = [], []
        for number, piece in enumerate(vocabulary.pieces):
            at = number - vocabulary.bytes_at
            if number in vocabulary.control:
                shown = first = b""
            elif number == vocabulary.unknown:
                shown = first = self.UNKNOWN
            elif vocabulary.bytes_at >= 0 and 0 <= at < 256:
                shown = first = bytes([at])
            else:
                shown = piece.replace(SPACE, " ").encode()
                first = piece.removeprefix(SPACE).replace(SPACE, " ").encode()
            inside.append(shown)
            front.append(first)
        self.n = len(inside)
        self.table = pa.array(inside + front, pa.large_binary())
        self.silent = np.zeros(self.n, dtype=bool)
        self.silent[list(vocabulary.control)] = True

    @staticmethod
    def text(shown: bytes) -> str:
        """Bytes that are no text are a replacement character each."""
        parts, at = [], 0
        while True:
            try:
                return "".join(parts) + shown[at:].decode()
            except UnicodeDecodeError as wrong:
                parts.append(shown[at : at + wrong.start].decode() + "�")
                at += wrong.start + 1

    def texts(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids."""
        numbers = ids.values.to_numpy().astype(np.int64)
        offsets = ids.offsets.to_numpy().astype(np.int64)
        if len(numbers) and not (0 <= numbers.min() and numbers.max() < self.n):
            raise ValueError("an id that the model does not have")
        # The first id of each text that shows anything.
        speaks = np.flatnonzero(~self.silent[numbers])
        at = np.searchsorted(speaks, offsets[:-1])
        there = at < len(speaks)
        first = speaks[at[there]]
        numbers[first[first < offsets[1:][there]]] += self.n
        data, bounds = _flat(self.table.take(pa.array(numbers)))
        joined = pa.Array.from_buffers(
            pa.large_binary(),
            len(ids),
            [None, pa.py_buffer(np.ascontiguousarray(bounds[offsets])), pa.py_buffer(data)],
        )
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self.text(shown) for shown in joined.to_pylist()], pa.string())


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``decoded`` to rows of (doc_id, ids), the text that the library makes
    of the ids. Null and no ids give an empty text; an id that the model does not
    have is an error. Control ids show nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy()
            for part in _slices(batch, sizes * 8):
                ids = part.column("ids")
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
                whole = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pc.list_flatten(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ids, decoder.texts(whole)], names=["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs, for merge-type vocabularies.

A text becomes code points, a space each ``▁``, with one ``▁`` in front (as the
model says).  An agenda holds every adjacent pair of symbols whose joined string
is a piece; the pair of best score goes first, the leftmost of equal ones, and
the merged symbol puts its own pairs on the agenda.  What is no piece at the end
is spelled in byte pieces.

No piece holds a ``▁`` behind another character, nor a line end with anything
else (checked when a vocabulary is read), so no merge crosses such a border: a
text is cut there, and the ids of short stretches are remembered, up to a fixed
number of them.  A vocabulary without those borders is worked on whole.

The short stretches of a group of texts that are not remembered are encoded
together: their agendas are the rows of a matrix, and each step merges the best
pair of every row.

Every text's ids are held against the sentencepiece library in the Arrow batch
they were made in; ids that differ end the job.  Decoding is the library's.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows and ids are encoded each for itself; no rows give no rows; other
columns are ignored.  The time for a stretch without borders grows as n log n.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise
from math import inf
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: stretches of up to so many characters are remembered, so many at once
SHORT, REMEMBERED = 48, 1_000_000
#: for up to so many symbols the agenda is a list
LISTED = 48
#: agendas in a matrix
ROWS = 4096
#: the rank of a pair that is no piece
NEVER = 2**31 - 1
#: between stretches while a text is cut: no character, so in no text
CUT = "\ud800"
#: an output batch is handed on once it holds so many ids or characters
FLUSH = 4_000_000

_vocabularies: dict[int, Vocabulary] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(piece: int) -> bytes:
    return piece.to_bytes(4, sys.byteorder)


class _Memory(dict):
    """Packed ids by stretch.  An unknown stretch is encoded, and kept if it is short.

    Once half of REMEMBERED came in, they become the older half, and the older half before them goes, but for
    what is met again: so frequent stretches stay.
    """

    def __init__(self, encode, encode_all):
        self.encode, self.encode_all, self.older = encode, encode_all, {}

    def learn(self, stretches: set[str]) -> None:
        """Of stretches that are not in the newer half, those in the older one are taken over, the other short ones encoded together."""
        older = self.older
        met = {s: ids for s in stretches if (ids := older.get(s)) is not None}
        self.make_room(len(met))
        self.update(met)
        unknown = sorted((s for s in stretches if len(s) <= SHORT and s not in met), key=len)
        rows = max(1, min(ROWS, REMEMBERED // 2))
        for k in range(0, len(unknown), rows):
            some = unknown[k : k + rows]
            self.make_room(len(some))
            self.update(zip(some, self.encode_all(some), strict=True))

    def make_room(self, n: int) -> None:
        if len(self) + n > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = self.encode(stretch)
        if len(stretch) <= SHORT:
            self.make_room(1)
            self[stretch] = ids
        return ids


class _Pairs:
    """Ranks and pieces of pairs of symbols, by number: pieces by their ids, the other letters of pieces above them.

    ``nothing`` is the number of no symbol, ``unknown`` that of letters in no piece.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float], size: int):
        self.nothing = size
        numbers = dict(ids)
        for letter in sorted(set("".join(ids)) - set(ids)):
            numbers[letter] = size + len(numbers) - len(ids) + 1
        self.unknown = size + len(numbers) - len(ids) + 1
        self.letters = np.full(sys.maxunicode + 1, self.unknown, np.int32)
        for symbol, number in numbers.items():
            if len(symbol) == 1:
                self.letters[ord(symbol)] = number
        cuts = [(numbers[p[:k]], numbers[p[k:]], scores[p], n) for p, n in ids.items() for k in range(1, len(p)) if p[:k] in numbers and p[k:] in numbers]
        left, right, score, piece = (np.array(c) for c in zip(*cuts, strict=True)) if cuts else [np.empty(0, int)] * 4
        rank = np.unique(score, return_inverse=True)[1]
        # the pairs of one left symbol lie at its start plus the right symbol, those of several without meeting
        self.start = np.zeros(self.unknown + 1, np.int32)
        room = 1 << max(16, (4 * len(left)).bit_length())
        self.owner = np.full(room + self.unknown + 1, -1, np.int32)
        self.ranks = np.full(len(self.owner), NEVER, np.int32)
        self.pieces = np.full(len(self.owner), self.nothing, np.int32)
        by = np.argsort(left, kind="stable")
        groups = np.split(by, np.flatnonzero(np.diff(left[by])) + 1) if len(by) else []
        random = np.random.default_rng(0)
        for group in sorted(groups, key=len, reverse=True):
            at = right[group]
            while (self.owner[at] != -1).any():
                at = right[group] + int(random.integers(room))
            self.start[left[group[0]]] = at[0] - right[group[0]]
            self.owner[at], self.ranks[at], self.pieces[at] = left[group], rank[group], piece[group]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, NEVER for what is no piece, and the pieces' ids."""
        at = self.start[left] + right
        return np.where(self.owner[at] == left, self.ranks[at], NEVER), self.pieces[at]


class Vocabulary:
    """Pieces, scores and byte pieces of a model, and the borders that no merge crosses."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, bytes] = {}
        for k in range(sp.get_piece_size()):
            if sp.is_byte(k):
                self.bytes[int(sp.id_to_piece(k)[3:5], 16)] = _packed(k)
            elif not (sp.is_control(k) or sp.is_unknown(k)):
                if sp.is_unused(k):
                    raise ValueError("vocabularies with unused pieces are not supported")
                self.ids[sp.id_to_piece(k)] = k
        self.scores = {piece: -sp.get_score(k) for piece, k in self.ids.items()}
        self.packed = {piece: _packed(k) for piece, k in self.ids.items()}
        self.bordered = not any(SPACE in piece.lstrip(SPACE) or "\n" in piece and len(piece) > 1 for piece in self.ids)
        self.pairs = _Pairs(self.ids, self.scores, sp.get_piece_size())
        self.memory = _Memory(self.merged, self.merged_together)

    def stretches(self, text: str) -> list[str]:
        """The text cut before runs of ``▁`` and around line ends; some may be empty."""
        if not self.bordered:
            return [text]
        text = text.replace(SPACE, CUT + SPACE).replace("\n", f"{CUT}\n{CUT}")
        while (inner := SPACE + CUT + SPACE) in text:
            text = text.replace(inner, SPACE + SPACE)
        return text.split(CUT)

    def spelled(self, symbol: str) -> bytes:
        """The piece's id, or those of its bytes."""
        known = self.packed.get(symbol)
        if known is not None:
            return known
        return b"".join([self.bytes[b] for b in symbol.encode()]) if self.bytes else _packed(self.library.unk_id())

    def merged(self, stretch: str) -> bytes:
        """Ids of a stretch, by the agenda."""
        symbols = self._from_list(list(stretch)) if len(stretch) <= LISTED else self._from_heap(list(stretch))
        return b"".join(map(self.spelled, symbols))

    def merged_together(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches, by agendas that are the rows of a matrix; best where they are short and of like lengths."""
        pairs, n, lengths = self.pairs, len(stretches), np.fromiter(map(len, stretches), int, len(stretches))
        # a row has nothing at both ends, and behind a shorter stretch
        width = int(lengths.max(initial=0)) + 2
        matrix = np.full((n, width), pairs.nothing, np.int32)
        letters = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")
        matrix[:, 1:-1][np.arange(width - 2) < lengths[:, None]] = pairs.letters[letters]
        symbols = matrix.reshape(-1)
        agenda = np.full((n, width), NEVER, np.int32)
        ranks, made = agenda.reshape(-1), np.empty(n * width, np.int32)
        ranks[:-1], made[:-1] = pairs.find(symbols[:-1], symbols[1:])
        places = np.arange(n * width)
        left_of, right_of, rows = places - 1, places + 1, np.arange(n)
        while True:
            best = agenda[rows].argmin(1) + rows * width
            going = ranks[best] < NEVER
            rows, k = rows[going], best[going]
            if not len(rows):
                break
            r, before = right_of[k], left_of[k]
            after = right_of[r]
            symbols[k], symbols[r], ranks[r] = made[k], pairs.nothing, NEVER
            right_of[k], left_of[after] = after, k
            ranks[before], made[before] = pairs.find(symbols[before], symbols[k])
            ranks[k], made[k] = pairs.find(symbols[k], symbols[after])
        is_symbol = matrix != pairs.nothing
        packed = matrix[is_symbol].tobytes()
        ends = [0, *(np.cumsum(is_symbol.sum(1)) * matrix.itemsize).tolist()]
        out = [packed[a:b] for a, b in pairwise(ends)]
        for row in np.flatnonzero((matrix > pairs.nothing).any(1)).tolist():  # what is no piece is spelled
            out[row] = b"".join(map(self.spelled, self._from_list(list(stretches[row]))))
        return out

    def _from_list(self, symbols: list[str]) -> list[str]:
        """The agenda as a list by place, whose least entry comes first: quicker for few symbols."""
        score, never = self.scores.get, inf
        pairs = list(map(add, symbols, symbols[1:]))
        agenda = [score(pair, never) for pair in pairs]
        while agenda and (best := min(agenda)) < never:
            k = agenda.index(best)
            symbols[k] = pair = pairs[k]
            del symbols[k + 1], pairs[k], agenda[k]
            if k:
                pairs[k - 1] = wider = symbols[k - 1] + pair
                agenda[k - 1] = score(wider, never)
            if k < len(agenda):
                pairs[k] = wider = pair + symbols[k + 1]
                agenda[k] = score(wider, never)
        return symbols

    def _from_heap(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, over symbols that know their neighbours."""
        n, scores = len(symbols), self.scores
        left_of, right_of = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(scores[pair], k, k + 1, pair) for k, pair in enumerate(a + b for a, b in pairwise(symbols)) if pair in scores]
        heapify(agenda)
        while agenda:
            _, k, r, pair = heappop(agenda)
            # a symbol that was merged away is empty, one that has grown makes another string
            if right_of[k] != r or not symbols[r] or symbols[k] + symbols[r] != pair:
                continue
            symbols[k], symbols[r] = pair, ""
            after = right_of[k] = right_of[r]
            before = left_of[k]
            for a, b in ((before, k), (k, after)):
                if a >= 0 and b >= 0 and (wider := symbols[a] + symbols[b]) in scores:
                    heappush(agenda, (scores[wider], a, b, wider))
            if after >= 0:
                left_of[after] = k
        return [s for s in symbols if s]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.stretches(self.library.normalize(text)) for text in texts]
        stretches = list(chain.from_iterable(cut))
        known = list(map(self.memory.get, stretches))
        self.memory.learn({s for s, ids in zip(stretches, known, strict=True) if ids is None})
        packed = iter([self.memory[s] if ids is None else ids for s, ids in zip(stretches, known, strict=True)])
        return [np.frombuffer(b"".join(islice(packed, len(c))), np.int32) for c in cut]


def vocabulary(model: bytes) -> Vocabulary:
    """Kept for the life of a worker."""
    key = hash(model)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(model)
    return _vocabularies[key]


def _shared(spark: SparkSession, model: str | None) -> Broadcast:
    """The bytes of a model (about half a MB), read by the driver and broadcast."""
    with open(model or model_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _encoded(own: Vocabulary, batches: Iterator[pa.RecordBatch], decoded: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    for b in batches:
        first, held, texts = 0, 0, []
        for k, text in enumerate(b.column(1)):
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held > FLUSH or k == b.num_rows - 1:
                docs, out = b.column(0)[first : k + 1], own.encode_all(texts)
                for doc, ids, want in zip(docs, out, own.library.encode_as_numpy(texts, num_threads=1), strict=True):
                    if not np.array_equal(ids, want):
                        raise ValueError(f"document {doc.as_py()}: the ids are not those of the sentencepiece library")
                back = [own.library.decode(ids) if len(ids) else "" for ids in out] if decoded else []
                columns = [docs, pa.array(map(len, out), pa.int64()), _lists(out), *[pa.array(back, pa.string())] * decoded]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                first, held, texts = k + 1, 0, []


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of every document; with ``decoded``, also the text that the library decodes from the ids."""
    shared = _shared(docs.sparkSession, model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(vocabulary(shared.value), batches, decoded)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encoded, "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of ``encode`` with the text that the library decodes from their ids (null ids: an empty text)."""
    shared = _shared(rows.sparkSession, model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(shared.value).library
        for b in batches:
            first, held, out = 0, 0, []
            ends, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            for k in range(b.num_rows):
                ids = flat[ends[k] : ends[k + 1]].tolist()
                out.append(library.decode(ids) if ids else "")
                held += len(out[-1])
                if held > FLUSH or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c[first : k + 1] for c in b.columns[:3]), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
                    first, held, out = k + 1, 0, []

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(texts, "doc_id long, n_tokens long, ids array<int>, decoded string")

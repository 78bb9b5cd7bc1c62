"""Byte-level BPE by monoid tree reduction, and decoding up the same tree.

An encoded text is an element of a monoid: its pieces with their ids. A text is halved
down to short leaves, leaves are encoded, and neighbours are joined. A join encodes only
a window around the border again and lets the window grow until what lies outside
provably stays as it is:

* *Pieces.* A piece that ends two characters before the end of the left half cannot
  change, since the pattern reads no farther than that. From the first other piece on
  the text is split again, until a new border falls on one of the right half's. The
  pattern never looks back, so from there on the right half's pieces hold.
* *Tokens.* A sequence of tokens is the encoding of its bytes if, and only if, every two
  neighbours encode to themselves. Merges take the lowest rank first, the leftmost of
  equals, so the merges inside two neighbours come in the same order with and without
  the rest; a merge across their border would show in the pair alone. Two halves of a
  long piece therefore join by encoding the last k tokens of one with the first k of the
  other anew and doubling k until both ends of the window fit their outer neighbours.

The ranks are read on the driver and broadcast; their size is that of the vocabulary
file and does not grow with the data. Executors need this package on their path.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free_name

#: Characters of a leaf of the text's tree, bytes of a leaf of a long piece's tree.
LEAF_CHARS = 2048
LEAF_BYTES = 48
#: Ids of a leaf when decoding.
LEAF_IDS = 8192
#: Runs of text whose ids a worker keeps, twice: a full table becomes the earlier one.
#: Longer runs than this many characters are encoded each time.
KEPT_RUNS = 300_000
LONGEST_KEPT = 60
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 1_000_000
#: Characters of text whose results leave the worker together.
BATCH_CHARS = 4_000_000
#: Fixed value: Unicode's white space, as the patterns of rank files mean it.
SPACES = (
    "\t-\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)
#: Runs of text between which every piece of the pattern ends: a word with one blank
#: before it, or white space.
RUNS = f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: No decision of the patterns reads this many characters past the end of a run.
LOOKAHEAD = 2


class Ranks:
    """A vocabulary of ranks with the pattern that splits text before merges.

    ``pattern`` must let a piece end wherever a run of ``RUNS`` ends.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file)
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = pattern


class TreeEncoder:
    """Encodes and decodes texts inside one process."""

    def __init__(self, vocabulary: Ranks):
        self.ranks = vocabulary.ranks
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, number in self.ranks.items():
            self.tokens[number] = token
        self.pieces = regex.compile(vocabulary.pattern)
        self.runs = re.compile(RUNS)
        self.kept: dict[str, tuple] = {}
        self.earlier: dict[str, tuple] = {}
        self.fitting: dict[int, bool] = {}

    # --- one piece --------------------------------------------------------------------

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by merging pair by pair, lowest rank first."""
        if len(piece) > 2 * LEAF_BYTES:
            return self._merge_long(piece)
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while True:
            best, at = None, -1
            for i, score in enumerate(scores):
                if score is not None and (best is None or score < best):
                    best, at = score, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap: windows of repetitive text can grow long."""
        ranks, n = self.ranks, len(piece)
        ends = list(range(1, n + 1))  # ends[i]: where the part that begins at i ends
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)

        def offer(i: int) -> None:
            middle = ends[i]
            if middle < n:
                rank = ranks.get(piece[i : ends[middle]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[middle]))

        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle <= i or middle >= n or ends[middle] != end:
                continue  # one of the two parts has been merged since
            ends[i], ends[middle] = end, -1
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        found, i = [], 0
        while i < n:
            found.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return found

    def fits(self, left: int, right: int) -> bool:
        """True if two tokens side by side encode to themselves."""
        key = left << 32 | right
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) >= KEPT_PAIRS:
                self.fitting.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.fitting[key] = known
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encoded neighbours of one piece."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merge(self.decode(left[a:]) + self.decode(right[:b]))
            if (a == 0 or self.fits(left[a - 1], window[0])) and (
                b == len(right) or self.fits(window[-1], right[b])
            ):
                return left[:a] + window + right[b:]
            k *= 2

    def tree(self, piece: bytes) -> list[int]:
        """Ids of a piece by halves; merges alone, no entry is taken whole."""
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join_tokens(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    # --- a text -----------------------------------------------------------------------

    def _run(self, run: str) -> tuple:
        """Ids of a run of ``RUNS``: those of its pieces in order."""
        found = self.kept.get(run)
        if found is None:
            found = self.earlier.get(run)
            if found is None:
                pieces = self.pieces.findall(run)
                if len(pieces) == 1:
                    found = tuple(self._piece(pieces[0]))
                else:  # pieces are runs too, and often known
                    found = tuple(chain.from_iterable(map(self._run, pieces)))
            if len(run) <= LONGEST_KEPT:
                if len(self.kept) >= KEPT_RUNS:
                    self.earlier, self.kept = self.kept, {}
                self.kept[run] = found
        return found

    def _join_run(self, run: str, parts: list[tuple[str, tuple]]) -> tuple:
        """Ids of a run from those of the parts it was cut into.

        Worth it for one long piece only: the pieces of all others are short.
        """
        if len(run) <= LONGEST_KEPT or len(self.pieces.findall(run)) > 1:
            return self._run(run)
        data = run.encode()
        if data in self.ranks:
            return (self.ranks[data],)
        found: list[int] = []
        for part, ids in parts:
            # a part that is an entry was taken whole, which merges may not do
            inner = list(ids) if len(ids) > 1 else self.tree(part.encode())
            found = self.join_tokens(found, inner)
        return tuple(found)

    def _join(self, left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list]:
        """Two neighbouring texts, each as its runs and their ids."""
        runs, ids = left
        tail, at = "", len(runs)
        while at and len(tail) < LOOKAHEAD:  # this run's end is nearer than LOOKAHEAD
            at -= 1
            tail = runs[at] + tail
        open_runs = list(zip(runs[at:], ids[at:]))
        border = len(tail)
        more, taken = right
        count = 2
        while True:
            count = min(count, len(more))
            window = tail + "".join(more[:count])
            last = len(window) - (0 if count == len(more) else LOOKAHEAD)
            new, end, j, there = [], 0, 0, border
            for run in self.runs.findall(window):
                if end >= border:
                    while there < end:
                        there, j = there + len(more[j]), j + 1
                    if there == end:
                        break
                new.append(run)
                end += len(run)
                if end > last:
                    break
            else:
                j, there = count, end  # the window holds the whole right half
            if there == end and end <= last and (end < len(window) or count == len(more)):
                break
            count *= 2
        del runs[at:], ids[at:]
        parts = open_runs + list(zip(more[:j], taken[:j]))
        begin, k, place = 0, 0, 0  # place: where the k-th old part begins
        for run in new:
            own = []
            while k < len(parts) and place < begin + len(run):
                own.append((place, parts[k]))
                place += len(parts[k][0])
                k += 1
            tiled = own and own[0][0] == begin and place == begin + len(run)
            if place > begin + len(run):  # an old part goes on in the next run
                k -= 1
                place -= len(parts[k][0])
            runs.append(run)
            ids.append(self._join_run(run, [p for _, p in own]) if tiled else self._run(run))
            begin += len(run)
            while k < len(parts) and place + len(parts[k][0]) <= begin:
                place += len(parts[k][0])
                k += 1
        runs += more[j:]
        ids += taken[j:]
        return runs, ids

    def _text(self, text: str) -> tuple[list, list]:
        if len(text) <= LEAF_CHARS:
            runs = self.runs.findall(text)
            return runs, list(map(self._run, runs))
        middle = len(text) // 2
        return self._join(self._text(text[:middle]), self._text(text[middle:]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._text(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            tokens = self.tokens
            return b"".join([tokens[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    if len(data) % 4:
        raise ValueError("packed ids take four bytes each")
    return [i for (i,) in struct.iter_unpack("<I", data)]


_ENCODERS: dict[int, TreeEncoder] = {}


def _encoder(shared) -> TreeEncoder:
    """The process's encoder: built once, its tables serve all later tasks."""
    key = id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TreeEncoder(shared.value)
    return _ENCODERS[key]


def byte_bpe_encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids",
    packed: bool = False,
) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``out``, as the public library gives them.

    Ids are an array of integers or, ``packed``, binary of little-endian unsigned 32-bit
    integers. Special tokens in a text are ordinary text. Null and empty texts have no
    ids. Rows are encoded one by one: repeated rows stay repeated, texts of any length
    are encoded whole, an empty table gives an empty table. All other columns stay; one
    named ``out`` is replaced.
    """
    return _mapped(df, Ranks(path, pattern), text, [(out, _id_type(packed))], "encode", packed)


def byte_bpe_decode(
    df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """``df`` with the bytes of ``ids`` (array or packed) in ``out``; null: no bytes.

    Bytes need not be valid UTF-8: a token may end inside a character. An id that the
    vocabulary lacks fails the query.
    """
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)
    return _mapped(df, Ranks(path, pattern), ids, [(out, T.BinaryType())], "decode", packed)


def byte_bpe_round_trip(
    df: DataFrame, path: str, pattern: str, text: str = "text", packed: bool = False
) -> DataFrame:
    """``df`` with ``ids`` and ``decoded``: both directions in one pass over the rows."""
    new = [("ids", _id_type(packed)), ("decoded", T.BinaryType())]
    return _mapped(df, Ranks(path, pattern), text, new, "both", packed)


def _id_type(packed: bool) -> T.DataType:
    return T.BinaryType() if packed else T.ArrayType(T.IntegerType())


def _mapped(df, ranks, source, new, what, packed):
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    names = [name for name, _ in new]
    kept = [c for c in df.columns if c not in names]
    binary = [isinstance(kind, T.BinaryType) for _, kind in new]
    types = [pa.binary() if b else pa.list_(pa.int32()) for b in binary]
    schema = T.StructType([df.schema[c] for c in kept])
    for name, kind in new:
        schema = schema.add(name, kind)

    def results(encoder, value):
        if what == "decode":
            return (encoder.decode(unpack(value) if packed else value),)
        ids = encoder.encode(value)
        out = pack(ids) if packed else ids
        return (out, encoder.decode(ids)) if what == "both" else (out,)

    def run(batches):
        encoder = _encoder(shared)
        empty = ("" if what != "decode" else b"" if packed else [])
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            begin = 0
            while begin < batch.num_rows:
                rows: list = []
                size, at = 0, begin
                while at < batch.num_rows and size < BATCH_CHARS:
                    value = values[at].as_py() or empty
                    size += len(value) + 1
                    rows.append(results(encoder, value))
                    at += 1
                columns = [
                    pa.array(c, type=t)
                    for c, t in zip(zip(*rows, strict=True), types, strict=True)
                ]
                rest = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns[:-1], *columns], names=[*kept, *names]
                )
                begin = at

    carried = free_name("_source", kept)
    return df.select(*kept, F.col(source).alias(carried)).mapInArrow(run, schema)

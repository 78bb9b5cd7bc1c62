"""Byte-pair encoding and decoding with a given vocabulary.

A word's encoding is found by dynamic programming over its prefixes. A suffix
automaton of the vocabulary reads the word once; at every position its suffix links
name the vocabulary entries that end there. Among them exactly one is the last token
of the prefix's encoding: the one that is compatible with the last token of the
shorter prefix, i.e. merging the two side by side would not have crossed the border
between them. The back-pointers of the whole word give its ids, identical to those of
merging pair by pair.

The vocabulary is read on the driver, turned into flat arrays and broadcast; its size
is fixed by the vocabulary file and does not grow with the data.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Added to the code of a word's last byte: vocabulary entries mark word ends.
END = 256
#: Runs of text whose ids a worker keeps, twice: a full table becomes the earlier one.
#: Longer runs than this many characters are encoded each time.
KEPT_WORDS = 300_000
LONGEST_KEPT = 60
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 1_000_000
#: Characters of text whose results leave the worker together.
BATCH_CHARS = 4_000_000
#: Fixed value: the vocabulary's pattern for pieces of text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]
#: White space for ``str.split`` but not for the vocabulary's pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Vocabulary:
    """What a worker needs to encode: automaton, merges and entries as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a BPE vocabulary with word ends is needed")
        entries = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*entries.values(), *self.specials.values()])
        self.tokens = [""] * size
        for token, i in [*entries.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.merges = np.full((size, 3), -1, dtype=np.int32)  # left, right, rank
        for rank, (left, right) in enumerate(model["merges"]):
            made = entries[left + right]
            if self.merges[made, 2] < 0:
                self.merges[made] = entries[left], entries[right], rank
        codes = {c: b for b, c in enumerate(byte_symbols())}
        spelled = {
            i: [codes[c] for c in token.removesuffix("</w>")] for token, i in entries.items()
        }
        for token, i in entries.items():
            if token.endswith("</w>") and spelled[i]:
                spelled[i][-1] += END
        single = {s[0] for s in spelled.values() if len(s) == 1}
        if len(single) < 2 * END:
            raise ValueError("the vocabulary must hold every byte, within and at a word end")
        self._automaton({i: s for i, s in spelled.items() if s})

    def _automaton(self, spelled: dict[int, list[int]]) -> None:
        """Suffix automaton of all entries, with the entries found at each state."""
        edges, link, length = [{}], [-1], [0]

        def extend(last: int, code: int) -> int:
            known = edges[last].get(code)
            if known is not None and length[known] == length[last] + 1:
                return known
            if known is None:
                state = len(edges)
                edges.append({})
                length.append(length[last] + 1)
                link.append(0)
                at = last
                while at >= 0 and code not in edges[at]:
                    edges[at][code] = state
                    at = link[at]
                if at < 0:
                    return state
                target = edges[at][code]
                if length[target] == length[at] + 1:
                    link[state] = target
                    return state
            else:
                state, at, target = None, last, known
            copy = len(edges)
            edges.append(dict(edges[target]))
            length.append(length[at] + 1)
            link.append(link[target])
            while at >= 0 and edges[at].get(code) == target:
                edges[at][code] = copy
                at = link[at]
            link[target] = copy
            if state is None:
                return copy
            link[state] = copy
            return state

        for i in sorted(spelled):
            at = 0
            for code in spelled[i]:
                at = extend(at, code)
        ends: dict[int, list[tuple[int, int]]] = {}
        for i, codes in spelled.items():
            at = 0
            for code in codes:
                at = edges[at][code]
            ends.setdefault(at, []).append((len(codes), i))
        pairs = [(s * 512 + c, t) for s, e in enumerate(edges) for c, t in e.items()]
        self.edge_keys = np.array([p[0] for p in pairs], dtype=np.int64)
        self.edge_to = np.array([p[1] for p in pairs], dtype=np.int32)
        self.link = np.array(link, dtype=np.int32)
        self.length = np.array(length, dtype=np.int32)
        self.ends = {s: sorted(found, reverse=True) for s, found in ends.items()}
        holder = np.full(len(edges), -1, dtype=np.int32)  # nearest state with entries
        for s in sorted(range(len(edges)), key=length.__getitem__):
            holder[s] = s if s in ends else (holder[link[s]] if s else -1)
        self.holder = holder


class Encoder:
    """Encodes and decodes texts inside one process."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.tokens, self.specials = v.tokens, v.specials
        self.edges = dict(zip(v.edge_keys.tolist(), v.edge_to.tolist(), strict=True))
        self.link, self.length = v.link.tolist(), v.length.tolist()
        self.holder, self.ends = v.holder.tolist(), v.ends
        self.left, self.right, self.rank = v.merges.T.tolist()
        self.pairs = {
            (a, b): r
            for a, b, r in zip(self.left, self.right, self.rank, strict=True)
            if r >= 0
        }
        self.chains: dict[int, tuple] = {}
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, tuple] = {}
        self.earlier: dict[str, tuple] = {}
        self.pieces = regex.compile(PIECES)
        marks = sorted(self.specials, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def _chain(self, state: int) -> tuple:
        """Entries that end at a state, longest first, as (length, id)."""
        found, at = [], self.holder[state]
        while at > 0:
            found += self.ends[at]
            at = self.holder[self.link[at]]
        chain = self.chains[state] = tuple(found)
        return chain

    def _fits(self, left: int, right: int) -> bool:
        """True if ``left`` and ``right`` stay two tokens when they stand side by side.

        Undoes the merges that made the two tokens, latest first. At each step the
        pieces that touch the border were neighbours until one of them was merged
        away; a merge across the border that comes before that moment breaks the pair.
        Equal merges go from left to right.
        """
        a, b, until = left, right, 1 << 30
        fits = True
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < until:
                fits = False
                break
            rank_a, rank_b = self.rank[a], self.rank[b]
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                until, a = rank_a, self.right[a]
            else:
                until, b = rank_b + 1, self.left[b]
        if len(self.compatible) >= KEPT_PAIRS:
            self.compatible.clear()
        self.compatible[left << 20 | right] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of text."""
        codes = list(word.encode("utf-8", "surrogatepass"))
        codes[-1] += END
        edges, link, length, chains = self.edges, self.link, self.length, self.chains
        compatible = self.compatible
        last, start = [-1], [0]  # last token of each prefix, and where it begins
        state = matched = at = 0
        for code in codes:
            at += 1
            to = edges.get(state << 9 | code)
            while to is None:  # every byte leaves the first state, see Vocabulary
                state = link[state]
                matched = length[state]
                to = edges.get(state << 9 | code)
            state = to
            matched += 1
            for size, token in chains.get(state) or self._chain(state):
                if size > matched:
                    continue
                begin = at - size
                if not begin:
                    break
                before = last[begin]
                fits = compatible.get(before << 20 | token)
                if fits or (fits is None and self._fits(before, token)):
                    break
            last.append(token)
            start.append(begin)
        ids = []
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; names of special tokens in it become their ids."""
        if self.marks is None or "<|" not in text:
            return self._encode_plain(text)
        ids: list[int] = []
        for i, part in enumerate(self.marks.split(text)):
            ids += [self.specials[part]] if i % 2 else self._encode_plain(part)
        return ids

    def _encode_plain(self, text: str) -> list[int]:
        text = normalize(text)
        known = self.words
        ids: list[int] = []
        # No piece holds white space, so runs without it can be looked up whole.
        for run in [text] if _SEPARATORS.search(text) else text.split():
            found = known.get(run)
            if found is None:
                found = self._encode_run(run)
            ids += found
        return ids

    def _encode_run(self, run: str) -> tuple:
        found = self.earlier.get(run)
        if found is None:
            found = ()
            for piece in self.pieces.findall(run):
                found += tuple(self.encode_word(piece))
        if len(run) <= LONGEST_KEPT:
            if len(self.words) >= KEPT_WORDS:
                self.earlier = dict(self.words)
                self.words.clear()
            self.words[run] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """Entries joined by blanks: this vocabulary has no decoder of its own."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def normalize(text: str) -> str:
    """Composed form, each character in lower case by itself."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if "Σ" not in text:
        return text.lower()
    return "σ".join(part.lower() for part in text.split("Σ"))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The process's encoder: built once, its tables of words serve all later tasks."""
    key = str(id(shared.value))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def bpe_encode(
    df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids"
) -> DataFrame:
    """``df`` with the token ids of ``text`` as an array of integers in ``out``.

    Null and empty texts give an empty array. All other columns stay; one of the name
    ``out`` is replaced. Rows are encoded one by one, so repeated rows stay repeated
    and texts of any length are encoded whole.
    """
    return _mapped(df, tokenizer_path, text, out, T.ArrayType(T.IntegerType()), "encode")


def bpe_decode(
    df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """``df`` with the tokens of ``ids`` written out in ``out``; null counts as no ids."""
    return _mapped(df, tokenizer_path, ids, out, T.StringType(), "decode")


def bpe_round_trip(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``: both directions in one pass over the rows."""
    return _mapped(df, tokenizer_path, text, "ids", T.ArrayType(T.IntegerType()), "both")


def _mapped(df, tokenizer_path, source, out, kind, what):
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))
    new = [T.StructField(out, kind)]
    if what == "both":
        new.append(T.StructField("decoded", T.StringType()))
    taken = {f.name for f in new}
    kept = [c for c in df.columns if c not in taken]
    types = [pa.list_(pa.int32()) if f.dataType != T.StringType() else pa.string() for f in new]
    carried = "_source"
    while carried in kept:
        carried += "_"
    schema = T.StructType([*[df.schema[c] for c in kept], *new])

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            begin = 0
            while begin < batch.num_rows:
                results: list = []
                size, at = 0, begin
                while at < batch.num_rows and size < BATCH_CHARS:
                    value = values[at].as_py() or ("" if what != "decode" else [])
                    size += len(value) + 1
                    if what == "decode":
                        results.append((encoder.decode(value),))
                    else:
                        ids = encoder.encode(value)
                        both = what == "both"
                        results.append((ids, encoder.decode(ids)) if both else (ids,))
                    at += 1
                columns = [
                    pa.array(c, type=t) for c, t in zip(zip(*results, strict=True), types, strict=True)
                ]
                rest = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns[:-1], *columns], names=[*kept, *[f.name for f in new]]
                )
                begin = at

    return df.select(*kept, F.col(source).alias(carried)).mapInArrow(run, schema)

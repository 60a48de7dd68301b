"""Byte-level BPE by backtracking over longest matches, in linear time.

A split of a piece into tokens is what the ranked merges give exactly when every
token and every pair of neighbours is. So the longest token is taken at each place
(the automaton finds those of a piece in one pass, which is often the answer);
if it doesn't fit its left neighbour, its next shorter prefix is tried, and if none
fits, the place is marked dead and the neighbour is shortened. A place is left dead
once at most. Which prefix of a token fits its left neighbour is worked out once and kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim
from .token_files import _blocks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text that are encoded together and of a worker's memory of pieces, about, and entries (about 120 bytes) of that of pairs of tokens.
BLOCK, PIECES, PAIRS = 8_000_000, 64_000_000, 400_000
#: Segments of texts, and distinct segments or pieces, that are put together at once.
TOGETHER, LOT = 500_000, 50_000
#: Rows that are decoded before they are given on.
SLICE = 500
#: White space of the usual pattern, and of it what takes one byte.
SPACE = "".join(regex.findall(r"\s", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))))
ONE_BYTE = np.isin(np.arange(256), [ord(c) for c in SPACE if c < "\x80"])


class Vocabulary:
    """Token bytes and ids of a rank file with one line "base64 rank" per token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def merged(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """Merges the lowest-ranked neighbours again and again, while more than ``parts_left`` parts are left; for short pieces only."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > parts_left:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[x] for x in parts]


class Encoder:
    """Ids of texts as little-endian 32-bit integers.

    No piece of the usual pattern goes from a character on to white space, so a text is cut
    into segments before white space, and Arrow numbers the distinct segments of a block of
    texts. These are cut into pieces, many in one text, and the distinct pieces looked up
    in a bounded memory; when it is full, the pieces of the present block stay. The
    automaton goes over all new pieces of a lot at once, and only those whose longest
    matches don't fit each other are gone through one by one. With another pattern a text is one segment.
    """

    whole, plain = "^ ?[A-Za-z]+$", f"^ ?[^{SPACE}]+$"

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.usual = pattern == public_tokenizers.PATTERN
        self.search = ahocorasick.Automaton()
        self.length = [0] * len(vocabulary.bytes_of)
        self.token_of: dict[str, int] = {}
        #: The two tokens of the last merge of each token that the merges can reach; itself twice for a byte.
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in vocabulary.ranks.items():
            last = vocabulary.merged(token, 2)
            if len(token) == 1 or len(last) == 2 and sum(map(len, map(vocabulary.bytes_of.__getitem__, last))) == len(token):
                self.halves[rank] = (rank, rank) if len(token) == 1 else (last[0], last[1])
                self.length[rank] = len(token)
                self.token_of[token.decode("latin-1")] = rank
                self.search.add_word(token.decode("latin-1"), rank)
        self.search.make_automaton()
        self.most = max(self.length)
        #: The longest token that starts a token.
        self.shorter = {rank: next((r for n in range(len(t) - 1, 0, -1) if self.length[r := vocabulary.ranks.get(t[:n], 0)] == n), None) for t, rank in vocabulary.ranks.items()}
        self.fits: dict[int, int | None] = {}
        self.tokens = pa.array(vocabulary.bytes_of, pa.large_binary())
        self.sizes = np.array(self.length)
        self.forget()

    def encode(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Binaries of the ids of some texts after the other, in their order; a null text counts as empty."""
        segments, until = self._segments(pc.fill_null(texts.cast(pa.large_string()), ""))
        found = segments.dictionary_encode()
        ids, at = self._distinct(found.dictionary)
        places = at[found.indices.to_numpy()]
        del segments, found, at
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(until, until[i] + TOGETHER, "right")) - 1)
            yield _grouped(ids.take(pa.array(places[until[i] : until[j]])), until[i : j + 1] - until[i]).cast(pa.binary())
            i = j

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Segments of all texts, and how many come before each text and the end."""
        cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not self.usual or cuts[0] == cuts[-1]:
            return texts, np.arange(len(texts) + 1)
        data, cuts = np.frombuffer(texts.buffers()[2], np.uint8)[cuts[0] : cuts[-1]], cuts - cuts[0]
        space = ONE_BYTE[data]
        starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        far = np.flatnonzero(data[starts - 1] > 127)  # here the character before may be white space too
        last = [data[np.maximum(starts[far] - n, 0)].astype(np.int64) for n in (1, 2, 3)]
        wide = [int.from_bytes(c.encode(), "big") for c in SPACE if c > "\x7f"]
        after = np.isin(last[1] << 8 | last[0], wide) | np.isin(last[2] << 16 | last[1] << 8 | last[0], wide)
        first = np.zeros(len(data) + 1, bool)
        first[np.delete(starts, far[after])] = True
        first[cuts] = True
        starts = np.flatnonzero(first)
        segments = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        return segments, np.searchsorted(starts, cuts)

    def _distinct(self, segments: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct segments in an order of their own, and the place of each segment in it."""
        none = np.zeros(len(segments), bool)
        whole, plain = ((pc.match_substring_regex(segments, x).to_numpy(zero_copy_only=False) if self.usual else none) for x in (self.whole, self.plain))
        kinds = [np.flatnonzero(x) for x in (whole, plain & ~whole, ~plain)]
        parts, counts = [segments.take(pa.array(kinds[0]))], [np.ones(len(kinds[0]), np.int64)]
        for i in range(0, len(kinds[1]), LOT):  # the pattern takes a line's end between two of these as a piece
            lines = segments.take(pa.array(kinds[1][i : i + LOT])).to_pylist()
            cut = pa.array(self.find("\n".join([*lines, ""])), pa.large_string())
            end = pc.equal(cut, "\n")
            counts.append(np.diff(np.flatnonzero(end.to_numpy(zero_copy_only=False)), prepend=-1) - 1)
            parts.append(cut.filter(pc.invert(end)))
        for i in range(0, len(kinds[2]), LOT):
            cuts = list(map(self.find, segments.take(pa.array(kinds[2][i : i + LOT])).to_pylist()))
            counts.append(np.array(list(map(len, cuts)), np.int64))
            parts.append(pa.array(chain.from_iterable(cuts), pa.large_string()))
        found = pa.concat_arrays(parts).dictionary_encode()
        at = np.empty(len(segments), np.int32)
        at[np.concatenate(kinds)] = np.arange(len(segments))
        ids = self._pieces(found.dictionary).take(found.indices)
        return _grouped(ids, np.r_[0, np.cumsum(np.concatenate(counts))]), at

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, from the memory, to which new ones are added."""
        at = pc.index_in(pieces, value_set=self.known)
        if self.known.nbytes + self.ids.nbytes > PIECES:
            stay = at.drop_null()
            self.known, self.ids = self.known.take(stay), self.ids.take(stay)
            at = pc.index_in(pieces, value_set=self.known)
        new, out = pieces.filter(at.is_null()), at.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = np.arange(len(new)) + len(self.known)
        self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, *self._learn(new)])
        return self.ids.take(pa.array(out))

    def _learn(self, pieces: pa.Array) -> Iterator[pa.Array]:
        for i in range(0, len(pieces), LOT):
            lot = pieces.slice(i, LOT).cast(pa.large_binary())
            tokens = pc.index_in(lot, value_set=self.tokens)
            ids: list[list[int]] = [[x] for x in tokens.to_pylist()]
            rest = np.flatnonzero(tokens.is_null().to_numpy(zero_copy_only=False))
            for k, part in zip(rest.tolist(), self.split(lot.take(pa.array(rest)).to_pylist()), strict=True):
                ids[k] = part
            flat = pa.py_buffer(np.fromiter(chain.from_iterable(ids), "<u4"))
            ends = np.r_[0, np.cumsum(list(map(len, ids)))].astype(np.int64) * 4
            yield pa.Array.from_buffers(pa.large_binary(), len(lot), [None, pa.py_buffer(ends), flat])

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes that the ids of each binary stand for, null for null."""
        own = pc.fill_null(ids.cast(pa.large_binary()), b"")
        cuts = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
        if ((cuts - cuts[:1]) % 4).any():
            raise ValueError("ids take 4 bytes each")
        tokens = np.frombuffer(own.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]].view("<u4") if len(own) else np.empty(0, "<u4")
        found = self.tokens.take(pa.array(tokens))
        if found.null_count:
            raise ValueError("an id has no token")
        out = _grouped(found, (cuts - cuts[:1]) // 4).cast(pa.binary())
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.binary()), out) if ids.null_count else out

    def forget(self) -> None:
        """At the end of a task, as a worker that waits for its next one may wait long."""
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        trim()

    def longest(self, text: str, place: int) -> int | None:
        """The longest token at a place of a piece's bytes as Latin-1."""
        ahead = text[place : place + self.most]
        for n in range(self.search.longest_prefix(ahead), 0, -1):
            if (token := self.token_of.get(ahead[:n])) is not None:
                return token
        return None

    def split(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Tokens of each piece. The automaton takes all of them as one text, in which no token has a mark between two."""
        text = "\u0100".join(x.decode("latin-1") for x in pieces)
        ends, tokens = np.fromiter(chain.from_iterable(self.search.iter_long(text)), np.int64).reshape(-1, 2).T
        stops = np.cumsum([len(x) + 1 for x in pieces])
        of = np.searchsorted(stops, ends, "right")  # the piece of each token
        covered = np.bincount(of, self.sizes[tokens], len(pieces)) == np.diff(stops, prepend=0) - 1
        inner = np.flatnonzero(of[1:] == of[:-1])
        pairs, one = np.unique(tokens[inner] << 32 | tokens[inner + 1], return_inverse=True)
        fit = np.array([self.fit(x >> 32, x & 0xFFFFFFFF) == x & 0xFFFFFFFF for x in pairs.tolist()], bool)
        misfits = inner[~fit[one]]
        apart, at = np.unique(of[misfits], return_index=True)
        firsts = np.searchsorted(of, np.arange(len(pieces) + 1))
        good = np.full(len(pieces), -1)  # how many tokens fit each other from the left, where not all do
        good[apart] = misfits[at] + 1 - firsts[apart]
        good[~covered] = 0
        tokens, firsts = tokens.tolist(), firsts.tolist()
        for i, (piece, n) in enumerate(zip(pieces, good.tolist(), strict=True)):
            greedy = tokens[firsts[i] : firsts[i + 1]]
            yield greedy if n < 0 else self.backtrack(piece, greedy if n else [], n)

    def backtrack(self, data: bytes, greedy: list[int], good: int) -> list[int]:
        """Tokens of a piece, given the longest that follow each other from its start, of which the first ``good`` fit."""
        text, size = data.decode("latin-1"), len(data)
        length, shorter, fits = self.length, self.shorter, self.fits
        place, at = 0, {}
        for token in greedy:
            at[place] = token
            place += length[token]
        dead: set[int] = set()
        tokens = greedy[:good]
        place, last = sum(map(length.__getitem__, tokens)), tokens[-1] if tokens else None
        token = at[place] if place in at else self.longest(text, place)
        while place < size:
            while token is not None:
                if last is not None:
                    fit = fits.get(last << 32 | token, -1)
                    token = self.fit(last, token) if fit == -1 else fit
                if token is None or place + length[token] not in dead:
                    break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                place += length[token]
                last, token = token, at.get(place)
                if token is None and place < size:
                    token = at[place] = self.longest(text, place)
            elif tokens:
                dead.add(place)
                token = tokens.pop()
                place -= length[token]
                last = tokens[-1] if tokens else None
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return tokens

    def fit(self, left: int, right: int) -> int | None:
        """The longest of a token and the tokens that start it that fits its left neighbour."""
        token = self.fits.get(left << 32 | right, -1)
        if token != -1:
            return token
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        token = right
        while token is not None and not self.together(left, token):
            token = self.shorter[token]
        self.fits[left << 32 | right] = token
        return token

    def together(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as neighbours.

        Their merges are undone, the last made first. They are left so unless at some
        point the two parts at the border could be merged before the merge that is
        undone. Of merges of one rank the left one is made first.
        """
        of, ranks, halves, before = self.vocabulary.bytes_of, self.vocabulary.ranks, self.halves, 1 << 60
        while True:
            across = ranks.get(of[left] + of[right])
            if across is not None and across < before:
                return False
            a, b = halves[left][1], halves[right][0]
            if a != left and (left > right or b == right):
                left, before = a, left
            elif b != right:
                right, before = b, right + 1
            else:
                return True


_made: dict = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Encoder(Vocabulary(path), pattern)
    return _made[path, pattern]


def _grouped(parts: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Binaries put together, those between two cuts as one."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset :][cuts] if len(parts) else np.zeros(len(cuts), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), parts.buffers()[2] or pa.py_buffer(b"")])


def _coded(path: str, pattern: str, back: bool):
    """Ids of the texts in the second column and, if ``back``, the bytes that these ids stand for."""

    def over(batches):
        enc = encoder(path, pattern)
        try:
            for who, texts in _blocks(batches, BLOCK):
                done = 0
                for ids in enc.encode(texts):
                    columns = {"id": who.slice(done, len(ids)), "n_tokens": pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), "ids": ids}
                    if back:
                        columns["decoded"] = enc.decode(ids)
                    done += len(ids)
                    yield pa.RecordBatch.from_pydict(columns)
        finally:
            enc.forget()

    return over


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens, ids) for each row; ids are little-endian unsigned 32-bit integers in a binary.

    A null text counts as empty: no tokens and an empty binary. Ids may be null or
    repeat; other columns are ignored. ``path`` must be readable on each executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    coded = _coded(path or public_tokenizers.path(RANKS), pattern, False)
    return _rows(docs, id_col, text_col).mapInArrow(coded, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the bytes that the ids stand for, made in the same pass by the same workers."""
    kind = docs.schema[id_col].dataType.simpleString()
    coded = _coded(path or public_tokenizers.path(RANKS), pattern, True)
    return _rows(docs, id_col, text_col).mapInArrow(coded, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the bytes that the ids stand for, null for null ids; all other columns stay, but one named like ``out_col`` is replaced."""
    path, rows = path or public_tokenizers.path(RANKS), encoded.drop(out_col)

    def over(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out = enc.decode(part.column(part.schema.get_field_index(ids_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, out_col])

    return rows.mapInArrow(over, T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of an exact round trip."""
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

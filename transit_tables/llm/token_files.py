"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of each id, level
k + 1 the next chunk of those ids that go on. A bitmap of each level tells which
ids go on, and a directory holds the count of ones before every 512 bits, so the
place of an id in the next level is one directory entry and a few bytes' ones away.
Any token is found without decoding others.

A file: 8 bytes of magic, the header's length as 4 bytes, a JSON header, then the
arrays at the offsets named there: document ids (a bitmap of nulls beside them), the
documents' first tokens, and for each level its chunks, bitmap and directory. All
numbers are little-endian. Files hold whole documents in ascending order of id.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import files, new_path, partitions, save, trim

TOKENIZER = "word_bpe_49k.json"
END = 2
MAGIC = b"DACTOK01"
SPAN = 512
#: Tokens after which a file ends, at the next document.
FILE_TOKENS = 4_000_000
#: Bytes of text that are encoded together and of a worker's memory of pieces, about; words of texts, and distinct words, that are put together at once.
BLOCK, PIECES, TOGETHER, LOT = 32_000_000, 64_000_000, 500_000, 50_000
#: What the short cut of ``Tokens`` relies on: the tokenizer's normalizer and pre-tokenizer, and the end of its words. Fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SUFFIX = "</w>"
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def known_kind(file: dict) -> bool:
    """Whether a tokenizer's file is of the kind whose words and pieces can be encoded one by one."""
    cutter = {"type": "Sequence", "pretokenizers": [CUTS, BYTES]}
    model, added = file["model"], file.get("added_tokens") or []
    usual = model["type"] == "BPE" and model.get("end_of_word_suffix") == SUFFIX and not model.get("dropout") and not model.get("continuing_subword_prefix")
    return usual and file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == cutter and file.get("post_processor") is None and all("<|" in t["content"] for t in added)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of these starts and sizes, one after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


class Tokens:
    """Ids of texts by the tokenizers library, which sees each word's pieces once.

    White space ends every word of the usual tokenizer and leaves no token, so a text's ids
    are those of its words in turn. Arrow splits the texts of a block and numbers their
    distinct words. A word of printable ASCII and Latin-1 letters is lower-cased
    and cut where the tokenizer cuts it, so that words with other capitals or marks share pieces;
    other words go to the library whole. New pieces are encoded in one text, and the ids
    of tokens that end a word tell them apart. Pieces and their ids are remembered in
    arrays; when these are full, only the pieces of the present block stay. Texts go whole to the
    library if the tokenizer's file isn't of this kind.
    """

    odd = r"[^!-~À-ÖØ-öø-ÿ]|<\|"
    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+").findall

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
        with open(path, "rb") as file:
            self.by_words = known_kind(json.load(file))
        self.pieces, self.ids = pa.array([], pa.string()), np.empty(0, "<u4")
        self.starts = self.sizes = np.empty(0, np.int64)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        if not self.by_words:
            for text in texts.to_pylist():
                yield from self._each([text])
            return
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        until, places = split.offsets.to_numpy(), found.indices.to_numpy()
        starts, sizes, ids = self._words(found.dictionary)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(until, until[i] + TOGETHER, "right")) - 1)
            words = places[until[i] : until[j]]
            own = ids[spans(starts[words], sizes[words])]
            ends = np.r_[0, np.cumsum(sizes[words])][until[i : j + 1] - until[i]].tolist()
            yield from (own[a:b] for a, b in zip(ends, ends[1:], strict=False))
            i = j

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and numbers of each distinct word's ids, and these ids."""
        first, counts, parts, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64), [pa.array([], pa.string())], 0
        for i in range(0, len(words), LOT):
            lot = words.slice(i, LOT)
            odd = pc.match_substring_regex(lot, self.odd)
            (text,) = _joined(pc.if_else(odd, "", lot), "\n", LOT)
            cut = pa.array(self.cut(text.lower() + "\n"), pa.string())
            end = pc.equal(cut, "\n")
            ends = np.flatnonzero(end.to_numpy(zero_copy_only=False)) - np.arange(len(lot))
            parts += [cut.filter(pc.invert(end)), lot.filter(odd)]
            of, odd = slice(i, i + len(lot)), odd.to_numpy(zero_copy_only=False)
            counts[of] = np.where(odd, 1, np.diff(ends, prepend=0))
            first[of] = np.where(odd, ends[-1] + np.cumsum(odd) - 1, np.r_[0, ends[:-1]]) + n
            n += len(parts[-2]) + len(parts[-1])
        found = pa.concat_arrays(parts).dictionary_encode()
        at = self._places(found.dictionary)[found.indices.to_numpy()]
        sizes = self.sizes[at]
        before = np.r_[0, np.cumsum(sizes)]
        return before[first], before[first + counts] - before[first], self.ids[spans(self.starts[at], sizes)]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the memory, to which new ones are added."""
        at = pc.index_in(pieces, value_set=self.pieces)
        if sum(x.nbytes for x in (self.pieces, self.starts, self.sizes, self.ids)) > PIECES:
            stay = at.drop_null().to_numpy()
            self.pieces, self.ids, self.sizes = self.pieces.take(pa.array(stay)), self.ids[spans(self.starts[stay], self.sizes[stay])], self.sizes[stay]
            self.starts = np.cumsum(self.sizes) - self.sizes
            at = pc.index_in(pieces, value_set=self.pieces)
        known, new = len(self.pieces), pieces.filter(at.is_null())
        if len(new):
            starts, sizes, ids = self._learn(new)
            self.starts, self.sizes = np.r_[self.starts, len(self.ids) + starts], np.r_[self.sizes, sizes]
            self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), np.concatenate([self.ids, ids])
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = np.arange(known, len(self.pieces))
        return out

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and numbers of each piece's ids, and these ids."""
        starts, sizes, out, n = np.empty(len(pieces), np.int64), np.full(len(pieces), -1), [], 0
        odd = pc.match_substring_regex(pieces, self.odd)
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        for i, text in enumerate(_joined(pieces.filter(pc.invert(odd)), " ", 512)):
            (ids,), part = self._each([text]), plain[512 * i : 512 * (i + 1)]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                starts[part], sizes[part] = np.r_[0, ends[:-1]] + n, np.diff(ends, prepend=0)
                out.append(ids)
                n += len(ids)
        rest = np.flatnonzero(sizes < 0)
        for i in range(0, len(rest), 512):
            part = rest[i : i + 512]
            each = self._each(pieces.take(pa.array(part)).to_pylist())
            sizes[part] = list(map(len, each))
            starts[part] = np.cumsum(sizes[part]) - sizes[part] + n
            out += each
            n += int(sizes[part].sum())
        return starts, sizes, np.concatenate(out)


def _joined(words: pa.Array, by: str, lot: int) -> list[str]:
    """Texts of ``lot`` words each."""
    cuts = np.minimum(np.arange(0, len(words) + lot, lot), len(words)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), by).to_pylist()


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        spans = np.add.reduceat(ONES[bits].astype(np.uint64), np.arange(0, len(bits), SPAN // 8)) if len(bits) else np.empty(0, np.uint64)
        out.append(((rest & 255).astype(np.uint8), bits, np.r_[np.uint64(0), np.cumsum(spans)].astype("<u8")))
        if not more.any():
            return out
        rest = rest[more] >> 8


def to_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    arrays = {"nulls": np.packbits([x is None for x in doc_ids], bitorder="little"), "docs": np.array([x or 0 for x in doc_ids], "<i8"), "starts": np.cumsum([0, *counts]).astype("<u8")}
    levels = levels_of(ids)
    for k, (chunks, bits, ones) in enumerate(levels):
        arrays |= {f"chunks{k}": chunks, f"bits{k}": bits, f"ones{k}": ones}
    at, places = 0, {}
    for name, x in arrays.items():
        places[name] = [at, len(x), x.dtype.str]
        at += x.nbytes
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": len(levels), "arrays": places}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in arrays.values())


class TokenFile:
    """Random access to a file; only the asked-for ranges of its arrays are read."""

    def __init__(self, source):
        self.source = source
        if source.read(8) != MAGIC:
            raise ValueError("no token file")
        size = int.from_bytes(source.read(4), "little")
        self.head, self.base = json.loads(source.read(size)), 12 + size

    def part(self, name: str, start: int = 0, end: int | None = None) -> np.ndarray:
        at, n, kind = self.head["arrays"][name]
        end, width = n if end is None else min(end, n), np.dtype(kind).itemsize
        self.source.seek(self.base + at + start * width)
        return np.frombuffer(self.source.read(max(0, end - start) * width), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        nulls = np.unpackbits(self.part("nulls"), bitorder="little")[: self.head["docs"]]
        return [None if n else int(x) for x, n in zip(self.part("docs"), nulls, strict=True)], self.part("starts")

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids from place ``start`` to before ``end``."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for k in range(self.head["levels"]):
            if end <= start:
                break
            out[where] |= self.part(f"chunks{k}", start, end).astype(np.uint32) << np.uint32(8 * k)
            first = start // SPAN
            bits = self.part(f"bits{k}", first * SPAN // 8, -(-end // 8))
            more = np.unpackbits(bits, bitorder="little")
            ones = int(self.part(f"ones{k}", first, first + 1)[0])
            skip = start - first * SPAN
            own = more[skip : skip + end - start].astype(bool)
            start = ones + int(more[:skip].sum())
            end = start + int(own.sum())
            where = where[own]
        return out

    def token(self, place: int) -> int:
        return int(self.tokens(place, place + 1)[0])


MANIFEST = "part int, seq int, path string, docs long, tokens long"


_made: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One for each worker process."""
    if path not in _made:
        _made[path] = Tokens(path)
    return _made[path]


def _blocks(batches, limit: int | None = None) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of about ``limit`` bytes, ``BLOCK`` if not given; a longer text ends its block."""
    held, size, limit = [], 0, limit or BLOCK
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            size += n + 1
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))


def _written(path: str, folder: str, end: int):
    def over(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = files(folder)
        system.create_dir(root, recursive=True)
        enc, stop, seq = tokens_of(path), np.array([end], "<u4"), 0
        docs, counts, held = [], [], []

        def close():
            name = f"{root}/{task.partitionId():06d}-{seq:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.dac"
            ids = np.concatenate(held)
            with system.open_output_stream(name) as out:
                out.write(to_file(docs, counts, ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((task.partitionId(), pa.int32()), (seq, pa.int32()), (name, pa.string()), (len(docs), pa.int64()), (len(ids), pa.int64()))], names=["part", "seq", "path", "docs", "tokens"])

        total = 0
        for doc_ids, texts in _blocks(batches):
            for who, ids in zip(doc_ids.to_pylist(), enc.encode(pc.fill_null(texts.cast(pa.string()), "")), strict=True):
                held += [ids, stop]
                docs.append(who)
                counts.append(len(ids) + 1)
                total += counts[-1]
                if total >= FILE_TOKENS:
                    yield close()
                    docs, counts, held, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield close()
        trim()

    return over


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each followed by ``end``, in ascending order of id (nulls first), and returns the manifest.

    A null text counts as empty. Rows of equal ids follow each other in order of
    their text's hash. A task that is run again writes files of other names; the
    manifest names those that count. ``folder`` must be shared by the executors.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", F.xxhash64("text"))
    return save(ordered.mapInArrow(_written(path, folder, end), MANIFEST), "manifest")


def _read(folder: str):
    def over(batches):
        system = files(folder)[0]
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(name) as source:
                    one = TokenFile(source)
                    docs, starts = one.documents()
                    i = 0
                    while i < len(docs):
                        j = max(i + 1, min(len(docs), int(np.searchsorted(starts, starts[i] + 1_000_000))))
                        ids = one.tokens(int(starts[i]), int(starts[j])).astype("<u4").tobytes()
                        cuts = ((starts[i : j + 1] - starts[i]) * 4).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs[i:j], pa.int64()), pa.array((starts[i:j] + np.uint64(base)).astype(np.int64)), pa.array(np.diff(cuts) // 4, pa.int64()), pa.array([ids[s:e] for s, e in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                            names=["id", "start", "n_tokens", "ids"],
                        )
                        i = j

    return over


def read_tokens(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row (id, start, n_tokens, ids) for each document of the files; start counts the tokens of all before it."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    based = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "part")
    dealt = based.repartition(partitions(manifest.sparkSession), "path").select("path", "base")
    return dealt.mapInArrow(_read(folder), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    back = read_tokens(write_tokens(docs, folder), folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def open_bytes(data: bytes) -> TokenFile:
    return TokenFile(io.BytesIO(data))

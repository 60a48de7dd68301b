"""BPE through a table of distinct words.

Texts are cut into words, and a block of about 32 MB of text into its distinct words: what
a document keeps is a number for each word's position. The distinct words of all
blocks meet by equality in one table, where each is encoded once and its ids are decoded
by a join with the table of pieces. Ids and decoded words go back to the blocks
that asked for them and from there, by position, into the documents.

White space ends every word of the usual tokenizer and leaves no token, so the ids of a text are
those of its words in turn. The tokenizer lower-cases words and cuts them at marks and
digits, so of words of printable ASCII and Latin-1 letters only these parts are looked up;
other words are looked up as they are. A tokenizer's file of another kind has whole texts as its words.

A null text counts as empty and has no ids. Ids of documents may be of any type, null or
repeated: a document is a place in its block. Other columns are ignored. The file must be readable on each
executor. A word lies in a block once, so no word has more rows than there are blocks.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import files, fresh, new_path, partitions, save, trim
from .token_files import SUFFIX, known_kind

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text of a block, words of documents that are put together at once, and ids of words that go back together.
BLOCK, TOGETHER, LOT = 32_000_000, 1_000_000, 200_000
#: Blocks of one partition, and partitions whose equal words are one row of the table.
SEQUENCES, WAVE = 1 << 20, 4096
#: A vocabulary's pieces at most: about 50 MB.
MOST_PIECES = 1_000_000
#: Words whose parts the tokenizer finds by itself: printable ASCII and Latin-1 letters, and where it cuts them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def _file(path: str) -> dict:
    with open(path, "rb") as file:
        return json.load(file)


def splits_at_space(file: dict) -> bool:
    """Whether texts of this tokenizer may be encoded word by word."""
    return known_kind(file) and not any(re.search(r"\s", t["content"]) for t in file.get("added_tokens") or [])


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, piece) of a tokenizer's file, whose ids are decoded by spaces between their pieces; it has ``MOST_PIECES`` rows at most, so that it may be broadcast."""
    file = _file(path)
    if file.get("decoder"):
        raise ValueError("the tokenizer has a decoder of its own")
    pieces = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file.get("added_tokens") or []}
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"the tokenizer has {len(pieces)} pieces")
    return F.broadcast(spark.createDataFrame(pa.table({"token": pa.array(pieces, pa.int32()), "piece": list(pieces.values())})))


class Words:
    """Ids of single words by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
        self.by_words = splits_at_space(_file(path))

    def encode(self, words: list[str]) -> list[list[int]]:
        """Parts of plain words are encoded many in a text, as the last token of each tells them apart; others one by one."""
        out: dict[str, list[int]] = {}
        plain = [w for w in words if PLAIN(w) and "<|" not in w] if self.by_words else []
        lots = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for lot, found in zip(lots, self._ids([" ".join(x) for x in lots]), strict=True):
            ends = (np.flatnonzero(self.ends[found]) + 1).tolist()
            if len(ends) == len(lot):
                out.update((w, found[a:b]) for w, a, b in zip(lot, [0, *ends], ends, strict=False))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._ids(rest), strict=True))
        return [out[w] for w in words]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_made: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One for each worker process."""
    if path not in _made:
        _made[path] = Words(path)
    return _made[path]


def cut_words(words: list[str]) -> list[list[str]]:
    """The parts of each word that are looked up."""
    return [CUT(w.lower()) if PLAIN(w) and "<|" not in w else [w] if w else [] for w in words]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of these starts and sizes, one after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first the lowest bytes of all, then the next."""
    data = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 4 * n, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(n).astype(np.int64)


def _block(ids: pa.Array, texts: pa.Array, by_words: bool) -> tuple[pa.RecordBatch, list[str]]:
    """What a block keeps of its documents, and its distinct parts of words."""
    texts = pc.fill_null(texts, "")
    if by_words:
        split = pc.ascii_split_whitespace(texts)
        counts, found = np.diff(split.offsets.to_numpy()), split.flatten().dictionary_encode()
    else:
        counts, found = np.ones(len(texts), np.int64), texts.dictionary_encode()
    often = np.argsort(-np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)), kind="stable")
    number = np.empty_like(often)
    number[often] = np.arange(len(often))
    words = found.dictionary.take(pa.array(often)).to_pylist()
    cut = cut_words(words) if by_words else [[w] if w else [] for w in words]
    parts = sorted(set().union(*cut))
    place = {p: i for i, p in enumerate(parts)}
    kept = {
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "counts": pa.array([_packed(counts)]),
        "places": pa.array([_packed(number[found.indices.to_numpy()])]),
        "sizes": pa.array([_packed(np.array(list(map(len, cut)), np.int64))]),
        "parts": pa.array([_packed(np.array([place[p] for x in cut for p in x], np.int64))]),
    }
    return pa.RecordBatch.from_pydict(kept), parts


def _split(path: str, folder: str):
    def over(batches):
        from pyspark import TaskContext

        task, by_words = TaskContext.get(), splits_at_space(_file(path))
        system, root = files(folder)
        system.create_dir(root, recursive=True)
        held, size, seq = [], 0, 0

        def close():
            ids, texts = (pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))
            kept, parts = _block(ids, texts, by_words)
            name = f"{root}/{task.partitionId()}-{seq}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.block"
            with system.open_output_stream(name) as out, pa.ipc.new_stream(out, kept.schema) as writer:
                writer.write_batch(kept)
            return pa.RecordBatch.from_pydict({"block": pa.array([task.partitionId() * SEQUENCES + seq], pa.int64()), "path": [name], "parts": pa.array([parts], pa.list_(pa.string()))})

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                size += n + 1
                if size >= BLOCK:
                    held.append(batch.slice(start, i + 1 - start))
                    yield close()
                    held, size, seq, start = [], 0, seq + 1, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield close()
        trim()

    return over


def _ids_of(path: str):
    @F.arrow_udf("array<int>")
    def ids(words: pa.Array) -> pa.Array:
        return pa.array(words_of(path).encode(words.to_pylist()), pa.list_(pa.int32()))

    return ids.asNondeterministic()  # else a filter on ids would call it before the words are made distinct


def word_table(words: DataFrame, path: str, pieces: DataFrame) -> DataFrame:
    """Rows (at, token, piece, asked) of each distinct word's ids in turn, from rows (word, asked): a word is encoded once and its ids joined with their pieces.

    A word's rows follow each other, as the broadcast join keeps the order of its larger side; only the first has ``asked``.
    """
    coded = words.select("asked", _ids_of(path)("word").alias("ids"))
    each = coded.select("asked", F.posexplode("ids").alias("at", "token")).join(pieces, "token")
    return each.select("at", "token", "piece", F.when(F.col("at") == 0, F.col("asked")).alias("asked"))


def _lots(batches):
    """Words with all that asked for them to lots of one block each."""

    def close(rows: pa.Table):
        ats, tokens, pieces = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).combine_chunks()
        starts = np.flatnonzero(ats == 0)
        counts = np.diff(np.r_[starts, len(ats)])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ats)].astype(np.int32)), pieces), " ")
        asked = rows.column(3).combine_chunks().take(pa.array(starts))
        blocks, numbers = (asked.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
        word = np.repeat(np.arange(len(starts)), pc.list_value_length(asked).to_numpy())
        order = np.lexsort((numbers, blocks))
        blocks, numbers, word = blocks[order], numbers[order], word[order]
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])
        for a, b in zip(cuts, cuts[1:], strict=False):
            w = word[a:b]
            own, decoded = tokens[_spans(starts[w], counts[w])], text.take(pa.array(w))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([blocks[a]], pa.int64()), "path": pa.array([None], pa.string()), "numbers": [_packed(numbers[a:b])], "counts": [_packed(counts[w])],
                "tokens": [_packed(own)], "widths": [_packed(pc.binary_length(decoded).to_numpy())], "texts": [pa.compress("".join(decoded.to_pylist()).encode(), "zstd", asbytes=True)],
            })

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LOT:
            rows = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(rows.column(0).to_numpy() == 0)[-1])  # the last word may go on
            if cut:
                yield from close(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), size - cut
    if held:
        yield from close(pa.Table.from_batches(held))
    trim()


LOTS = "block long, path string, numbers binary, counts binary, tokens binary, widths binary, texts binary"


def _assembled(folder: str):
    def block(path: str, lots: list[dict]):
        with files(folder)[0].open_input_stream(path) as source:
            kept = pa.ipc.open_stream(source).read_next_batch()
        ids, (doc_words, places, sizes, parts) = kept.column(0).flatten(), (_unpacked(kept.column(i)[0].as_py()) for i in range(1, 5))
        # The block's parts by number: ids as ranges of one array, and text.
        numbers = np.concatenate([np.empty(0, np.int64), *(_unpacked(x["numbers"]) for x in lots)])
        n = int(max(parts, default=-1)) + 1
        counts, starts, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(numbers), np.int64)
        found = np.concatenate([np.empty(0, np.int64), *(_unpacked(x["counts"]) for x in lots)])
        tokens = np.concatenate([np.empty(0, np.int32), *(_unpacked(x["tokens"]).astype(np.int32) for x in lots)])
        counts[numbers], starts[numbers], at[numbers] = found, np.cumsum(found) - found, np.arange(len(numbers))
        widths = [_unpacked(x["widths"]) for x in lots]
        data = b"".join(pa.decompress(x["texts"], int(w.sum()), "zstd", asbytes=True) for x, w in zip(lots, widths, strict=True))
        offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *widths])).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        # Words from parts; parts and words without ids leave no space in the text.
        ends = np.cumsum(sizes)
        word_of = np.repeat(np.arange(len(sizes)), sizes)
        tokens = tokens[_spans(starts[parts], counts[parts])]
        before = np.r_[0, np.cumsum(counts[parts])]
        starts, counts = before[ends - sizes], before[ends] - before[ends - sizes]
        full = at[parts] < len(numbers)
        offsets = np.r_[0, np.cumsum(np.bincount(word_of[full], minlength=len(sizes)))].astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts.take(pa.array(at[parts][full]))), " ")
        # Documents from words.
        until = np.r_[0, np.cumsum(doc_words)]
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(until, until[i] + TOGETHER, "right")) - 1)
            words = places[until[i] : until[j]]
            own, some = tokens[_spans(starts[words], counts[words])], counts[words] > 0
            n_tokens = np.diff(np.r_[0, np.cumsum(counts[words])][until[i : j + 1] - until[i]])
            n_words = np.r_[0, np.cumsum(some)][until[i : j + 1] - until[i]].astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "id": ids.slice(i, j - i), "n_tokens": pa.array(n_tokens, pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_tokens)].astype(np.int32)), pa.array(own.astype(np.int32))),
                "decoded": pc.binary_join(pa.ListArray.from_arrays(pa.array(n_words), texts.take(pa.array(words[some]))), " "),
            })
            i = j

    def over(batches):
        """Rows come in order of block, the lots of one before its path."""
        lots = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] is None:
                    lots.append(row)
                else:
                    yield from block(row["path"], lots)
                    lots = []
        trim()

    return over


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens, ids array, decoded) for each row, as the tokenizers library encodes and decodes, special tokens kept."""
    spark, path = docs.sparkSession, path or public_tokenizers.path(TOKENIZER)
    folder = new_path(spark, "words")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = save(rows.mapInArrow(_split(path, folder), "block long, path string, parts array<string>"), "blocks", compression="zstd")
    n = partitions(spark)
    asked = blocks.select("block", F.posexplode("parts").alias("number", "word"))
    wave = F.expr(f"block div {SEQUENCES * WAVE}").alias("wave")
    dealt = asked.select(wave, "word", F.struct("block", "number").alias("asked")).repartition(n, "word", "wave")
    words = dealt.groupBy("wave", "word").agg(F.collect_list("asked").alias("asked"))
    lots = word_table(words, path, piece_table(spark, path)).mapInArrow(_lots, LOTS)
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in LOTS.split(", ")[2:])]
    together = lots.unionByName(blocks.select("block", "path", *none)).repartition(n, "block").sortWithinPartitions("block", F.col("path").asc_nulls_first())
    kind = docs.schema[id_col].dataType.simpleString()
    return together.mapInArrow(_assembled(folder), f"id {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the pieces of an array of ids, joined by spaces, as the library's decode without a decoder gives them; null for null, empty for no ids.

    Ids that the tokenizer lacks are left out. Other columns stay, but one named like ``out_col`` is replaced.
    """
    spark = encoded.sparkSession
    key, at, token, parts = fresh(encoded, "row_key", "row_at", "row_token", "row_parts")
    rows = save(encoded.drop(out_col).withColumn(key, F.monotonically_increasing_id()), "encoded")
    pieces = piece_table(spark, path or public_tokenizers.path(TOKENIZER)).withColumnRenamed("token", token)
    each = rows.select(key, F.posexplode(ids_col).alias(at, token)).join(pieces, token)
    texts = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, "piece"))).alias(parts))
    joined = rows.join(texts, key, "left")
    text = F.coalesce(F.array_join(F.transform(parts, lambda x: x["piece"]), " "), F.lit(""))
    return joined.select(*(c for c in rows.columns if c != key), F.when(F.col(ids_col).isNotNull(), text).alias(out_col))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by spaces) and decoded_sha256."""
    found = encode(docs)
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Token ids in packed files.

Documents are put in ascending id order by a range partitioning, encoded, and packed into
shards of a few megabytes. Each document is a zstandard frame of its own, compressed with one
dictionary that was trained on serialized id arrays, so a single short document
can be read without its neighbours and still compresses well.

A shard is bytes::

    magic   8 bytes   b"DQTOKS1\\n"
    frames            one zstandard frame per document: its ids, little-endian, ``width`` bytes each
    index             JSON: dict_sha256, width, end_id, null flags; then binary arrays
                      doc_id int64[n], offset uint64[n + 1], n_tokens uint32[n]
    trailer 28 bytes  offset of the index (8), JSON length (4), documents (4), crc32 of the index (4), magic (8)

Shards are stored as rows of a Parquet table (``first_*`` sort columns, ``n_tokens``, ``blob``) since Spark
commits those atomically in any store; ``blob`` is the file, byte for byte.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small, table, text_key, tidy

MAGIC = b"DQTOKS1\n"
TRAILER = struct.Struct("<QIII8s")
SHARD_BYTES = 4 << 20
DICT_BYTES = 64 << 10
#: Rows and MB of texts that are encoded together: more share more words.
BATCH = (2048, 8)
#: Documents whose ids the dictionary is trained on: those with the smallest id hash.
DICT_SAMPLE = 256
#: Characters of each of them; the dictionary changes no result.
DICT_CHARS = 1 << 16


def _gather(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which`` of a list of lists, given flat with the end of each, one after the other; and how long each is."""
    starts = np.concatenate([[0], ends[:-1]])[which]
    counts = ends[which] - starts
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(counts.sum())], counts


class _Slots(dict):
    """Numbers pieces as they come; those since the last look are in ``new``. What stands between words has number -1."""

    def __init__(self):
        super().__init__({"\n": -1})
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self) - 1
        self.new.append(piece)
        return n


class WordEncoder:
    """Encodes texts with a tokenizers file, each distinct word of a batch once.

    A tokenizer that marks the ends of words drops white space and never joins characters across it, so a text's ids are
    its words' ids in order. Words of plain letters, digits and punctuation consist of
    pieces that the tokenizer would split alike; distinct pieces are encoded many in a call, and remembered. All
    other words go to the library whole, and so do whole texts if the tokenizer marks no ends.
    The memory of pieces is emptied when full, which costs time but changes nothing.
    """

    PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{-~]+$"
    #: Pieces of lowered plain words, and the line feeds between words.
    PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+|\n")
    #: About 200 bytes each: some 80 MB in a worker when all are held.
    MOST_PIECES = 400_000
    #: Ids that are put together at a time.
    TOGETHER = 1 << 18

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, mark = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.marked = bool(mark)
        self.kind = np.dtype("<u2" if max(len(vocabulary), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if mark:
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots = _Slots()
        self.flat, self.ends = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, flat, and how many each has."""
        found = [x.ids for i in range(0, len(texts), 256) for x in self.tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), self.kind, counts.sum()), counts

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # the tokenizer splits otherwise: ask it piece by piece
                ids, counts = self._whole(part)
                ends = np.cumsum(counts)
            self.ends = np.concatenate([self.ends, len(self.flat) + ends])
            self.flat = np.concatenate([self.flat, ids])

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, flat, and how many each has."""
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), "\n")
        pieces = self.PIECE.findall(line[0].as_py().lower())
        if len(self.slots) > self.MOST_PIECES:
            self._forget()
        slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        self._learn(self.slots.new)
        self.slots.new = []
        between = slots < 0
        ids, counts = _gather(self.flat, self.ends, slots[~between])
        return ids, np.bincount(np.cumsum(between)[~between], counts, len(words)).astype(np.int64)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text and the end id, as bytes; null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.marked:
            for text in texts:
                yield self._whole([text.as_py()])[0].tobytes() + self.end.tobytes()
            return
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        plain = pc.match_substring_regex(words.dictionary, self.PLAIN)
        parts, place = [(self.end, np.ones(1, np.int64))], np.zeros(len(words.dictionary), np.int64)
        for mask, encode in ((plain, self._plain), (pc.invert(plain), lambda some: self._whole(some.to_pylist()))):
            if len(some := words.dictionary.filter(mask)):
                place[np.flatnonzero(mask)] = sum(len(c) for _, c in parts) + np.arange(len(some))
                parts.append(encode(some))
        flat, ends = np.concatenate([x for x, _ in parts]), np.cumsum(np.concatenate([c for _, c in parts]))
        # the words of all texts, each text followed by the end id
        after = np.cumsum(pc.list_value_length(split).to_numpy())
        line = np.insert(place.astype(np.int32)[words.indices.to_numpy()], after, 0)
        size = np.diff(ends, prepend=0).astype(np.int32)
        last = after + np.arange(1, len(after) + 1)  # where each text ends in ``line``
        upto = np.cumsum(size[line], dtype=np.int64)[last - 1]
        begin = 0
        while begin < len(texts):
            done = upto[begin - 1] if begin else 0
            stop = max(int(np.searchsorted(upto, done + self.TOGETHER, "right")), begin + 1)
            ids, _ = _gather(flat, ends, line[last[begin - 1] if begin else 0 : last[stop - 1]])
            at = np.concatenate([[0], upto[begin:stop] - done]).tolist()
            yield from (ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False))
            begin = stop


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    """This process's encoder of a tokenizer file."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary for id arrays; too few samples become a plain content prefix."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def pack(docs: list[tuple[int | None, bytes]], dictionary: bytes, width: int, end_id: int) -> bytes:
    """A shard of (doc_id, id bytes)."""
    import zstandard as zstd

    press = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
    frames = [press.compress(raw) for _, raw in docs]
    head = {"dict_sha256": hashlib.sha256(dictionary).hexdigest(), "width": width, "end_id": end_id, "null_ids": [i for i, (d, _) in enumerate(docs) if d is None]}
    head = json.dumps(head).encode()
    offsets = np.cumsum([len(MAGIC), *map(len, frames)], dtype="<u8")
    index = head + np.array([d or 0 for d, _ in docs], "<i8").tobytes() + offsets.tobytes() + np.array([len(raw) // width for _, raw in docs], "<u4").tobytes()
    return b"".join([MAGIC, *frames, index, TRAILER.pack(int(offsets[-1]), len(head), len(docs), zlib.crc32(index), MAGIC)])


class Shard:
    """Reads a shard; ``ids(i)`` touches the i-th document only."""

    def __init__(self, blob: bytes, dictionary: bytes):
        import zstandard as zstd

        at, n_head, n, crc, magic = TRAILER.unpack_from(blob, len(blob) - TRAILER.size)
        index = blob[at : len(blob) - TRAILER.size]
        if magic != MAGIC or blob[: len(MAGIC)] != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a token shard, or a damaged one")
        self.head = json.loads(index[:n_head])
        if self.head["dict_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the shard was written with another dictionary")
        self.blob, self.n = blob, n
        self.doc_ids = np.frombuffer(index, "<i8", n, n_head).tolist()
        for i in self.head["null_ids"]:
            self.doc_ids[i] = None
        self.offsets = np.frombuffer(index, "<u8", n + 1, n_head + 8 * n).tolist()
        self.n_tokens = np.frombuffer(index, "<u4", n, n_head + 8 * n + 8 * (n + 1))
        self._open = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        raw = self._open.decompress(self.blob[self.offsets[i] : self.offsets[i + 1]])
        return np.frombuffer(raw, f"<u{self.head['width']}")


def _sample(rows: DataFrame) -> list[str]:
    """The beginnings of the texts that the dictionary is trained on; ids are chosen first, so that no other text moves."""
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_SAMPLE)
    known = [r[0] for r in chosen.collect() if r[0] is not None]  # at most DICT_SAMPLE numbers
    texts = rows.filter(F.col("doc_id").isin(known)).select("doc_id", "key", F.left("text", F.lit(DICT_CHARS)).alias("text"))
    return [r[0] for r in texts.orderBy("doc_id", "key").limit(DICT_SAMPLE).select("text").collect()]  # at most DICT_SAMPLE times DICT_CHARS


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Encode and pack all rows; the table of shards (settled) and the dictionary.

    Rows stand in ascending order of id, null first, equal ids by text hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    coder = encoder(tokenizer, end_id)
    sample = _sample(rows)
    samples = [raw[i : i + 8192] for raw in coder.encode(pa.array(sample, pa.string())) for i in range(0, len(raw), 8192)] if sample else []
    dictionary = train_dictionary(samples) if samples else b""
    width = coder.kind.itemsize

    @tidy
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        first, size = None, 0

        def shard() -> pa.RecordBatch:
            total = sum(len(raw) for _, raw in held) // width
            blob = pack(held, dictionary, width, end_id)
            return pa.RecordBatch.from_arrays(
                [pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), pa.array([(part << 24) + k], pa.int64()), pa.array([total], pa.int64()), pa.array([blob], pa.binary())],
                names=["first_id", "first_key", "shard", "n_tokens", "blob"],
            )

        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            for doc, key, raw in zip(ids, keys, coder.encode(batch.column("text")), strict=True):
                first = first or (doc, key)
                held.append((doc, raw))
                size += len(raw)
                if size >= SHARD_BYTES:
                    yield shard()
                    held, first, size, k = [], None, 0, k + 1
        if held:
            yield shard()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    shards = ordered.mapInArrow(packed, "first_id long, first_key long, shard long, n_tokens long, blob binary")
    return settle(shards, "token-shards", batch=BATCH), dictionary


def read_shards(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """One row per document of the shards, in terms of the whole: ``doc_id, start, n_tokens, ids_crc32``.

    The starts of the shards are prefix sums over one row per shard of some megabytes.
    """
    order = Window.orderBy("first_id", "first_key", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("shard_start"))

    @tidy
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("shard").to_pylist(), batch.column("blob"), strict=True):
                shard = Shard(blob.as_py(), dictionary)
                crcs = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(shard.n)]
                counts = shard.n_tokens.astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * shard.n, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("shard", "blob").mapInArrow(unpacked, "shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    rows = settle(rows, "token-rows")
    rows = rows.join(small(settle(starts, "token-starts")), "shard")
    return rows.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token shards and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    One row per input row. Null and empty texts are the end id alone. Null ids come first; equal ids are
    ordered by text hash, and repeated rows stand side by side. An empty table gives no rows. Only the named columns are read.
    A text is encoded whole, in about 40 times its bytes of a worker's memory, and makes a shard of its own if its ids fill one.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_shards(*write_shards(docs, tokenizer, end_id, id_col, text_col))


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents", spread=False))  # they are dealt out in order of their ids

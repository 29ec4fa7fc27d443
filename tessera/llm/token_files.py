"""Token-id files: encoded documents in id order with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id, so that shard i holds smaller ids than shard
i + 1 and no task sees more than its range.  A task encodes its sorted documents and writes
blocks of about `BLOCK_TOKENS` ids.  A block is one binary value:

    magic 'TEF1' | id width (2 or 4) | l | n_docs, n_ids (u64) | start in the shard (u64)
    doc_ids  i64 x n_docs, with a null bitmap before them
    low      l bits of each end boundary, packed
    high     unary upper parts, one 1 a document
    hints    u32 positions of every 256th 1 in `high`
    ids      u16 or u32 little endian, all documents one after the other

Boundaries take about 2 + log2(n_ids / n_docs) bits a document; `EliasFano.select(i)`
finds the end of document i from the hints without a table of 64-bit offsets.  Blocks are
rows of a Parquet table in the shared folder: Spark commits them, so a lost executor's
half-written blocks never show.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows
that repeat a doc_id follow each other by text; other columns are not read; an empty table
gives an empty file and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import over_batches, text_or_empty
from tessera.llm.wordtable import WordTable, encode_texts

BLOCK_TOKENS = 1 << 20
TABLE_WORDS = 400_000
HINT_EVERY = 256
_HEAD = struct.Struct("<4sBBxxQQQ")
# Letters, then marks: the shape of most words, which the tokenizer cuts between the two at most.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,%&$*#!|?;:]*)")
WORD_END = "</w>"
JOINED_WORDS = 256
PROBE_SPACES = " \n\t\r\x0b\x0c "
PROBE = ["The", "Élan", ",", "Straße", "%%%", "ñandú", "...", "don", "x"]
_ENCODERS: dict[str, TokenEncoder] = {}


class EliasFano:
    """A non-decreasing sequence of n values in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, hints: np.ndarray):
        self.n, self.l, self.low, self.high, self.hints = n, l, low, high, hints

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        low_bits = (values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(
            n, l,
            np.packbits(low_bits.astype(np.uint8).ravel(), bitorder="little"),
            np.packbits(high, bitorder="little"),
            ones[::HINT_EVERY].astype("<u4"),
        )

    def select(self, i: int) -> int:
        """Value i, from the nearest hint before it."""
        at = int(self.hints[i // HINT_EVERY])
        left = i % HINT_EVERY
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        return (one - i) << self.l | self._low(i)

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.l):
            bit = i * self.l + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return value

    def select_group(self, g: int) -> list[int]:
        """Values g * HINT_EVERY and on, up to the next hint: one look at the bytes between."""
        first = g * HINT_EVERY
        count = min(HINT_EVERY, self.n - first)
        begin = int(self.hints[g])
        end = int(self.hints[g + 1]) if g + 1 < len(self.hints) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[begin & 7 :])[:count] + begin
        high = (ones - np.arange(first, first + count)) << self.l
        at = first * self.l
        low = np.unpackbits(self.low[at >> 3 : (at + count * self.l + 7) >> 3], bitorder="little")
        low = low[at & 7 : (at & 7) + count * self.l].reshape(count, self.l)
        return (high + (low.astype(np.int64) << np.arange(self.l)).sum(axis=1)).tolist()

    def __iter__(self) -> Iterator[int]:
        for g in range(len(self.hints)):
            yield from self.select_group(g)


def pack_block(doc_ids: list, ends: np.ndarray, ids: np.ndarray, start: int, width: int) -> bytes:
    ef = EliasFano.of(ends)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        (
            _HEAD.pack(b"TEF1", width, ef.l, len(doc_ids), len(ids), start),
            np.packbits(known, bitorder="little").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            ef.low.tobytes(),
            struct.pack("<Q", len(ef.high)),
            ef.high.tobytes(),
            ef.hints.tobytes(),
            ids.astype(f"<u{width}").tobytes(),
        )
    )


class Block:
    """A packed block, read without copying the ids."""

    def __init__(self, data: bytes):
        magic, self.width, l, n, self.n_ids, self.start = _HEAD.unpack_from(data)
        if magic != b"TEF1":
            raise ValueError("not a token block")
        at = _HEAD.size
        known = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
        at += (n + 7) // 8
        ids = np.frombuffer(data, "<i8", n, at)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        at += 8 * n
        n_low = (n * l + 7) // 8
        low = np.frombuffer(data, np.uint8, n_low, at)
        (n_high,) = struct.unpack_from("<Q", data, at + n_low)
        at += n_low + 8
        high = np.frombuffer(data, np.uint8, n_high, at)
        at += n_high
        n_hints = -(-n // HINT_EVERY)
        hints = np.frombuffer(data, "<u4", n_hints, at)
        self.ends = EliasFano(n, l, low, high, hints)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + 4 * n_hints)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i of the block, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class TokenEncoder:
    """Encodes texts as the tokenizer file does, each distinct word once where it allows that.

    Most tokenizers split at white space before anything else, so that a text's ids are
    those of its words one after the other; one that does not, as `PROBE` tells, gets whole
    texts.  New words go to the library many to a call.  If a word of letters and then marks
    is cut between the two and nowhere else, such parts are given to the same model with
    white space as the only splitter; each part ends with a token that carries the end mark,
    which tells the parts' ids apart again.  Otherwise the library gets the words as they are.
    """

    def __init__(self, path: str, bound: int = TABLE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith(WORD_END)
        whole = self._ids(self.tokenizer, [PROBE_SPACES.join(PROBE)])
        self.by_word = whole == self._ids(self.tokenizer, PROBE)
        self.in_parts = self.by_word and whole == self._joined(PROBE)
        self.table = WordTable(self._encode_words, bound)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[int]:
        coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [i for c in coded for i in c.ids]

    def _joined(self, parts: list[str]) -> list[int]:
        """The ids of words and marks, lower-cased and given many to a text."""
        step = JOINED_WORDS
        texts = [" ".join(parts[i : i + step]).lower() for i in range(0, len(parts), step)]
        return self._ids(self.plain, texts)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, kind).tobytes() for c in coded]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        if not self.in_parts:
            return self._bytes(texts)
        kind = f"<u{self.width}"
        coded: dict[str, bytes] = {}
        plain, parts, counts = [], [], []
        for word in texts:
            if m := _PLAIN.fullmatch(word):
                own = [p for p in m.groups() if p]
                plain.append(word)
                parts += own
                counts.append(len(own))
        ids = np.array(self._joined(parts), kind)
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        wanted = np.cumsum(counts, dtype=np.int64) - 1
        if plain and len(cuts) == wanted[-1] + 1:
            size, raw, begin = self.width, ids.tobytes(), 0
            for word, end in zip(plain, (cuts[wanted] * size).tolist(), strict=True):
                coded[word] = raw[begin:end]
                begin = end
        rest = [w for w in texts if w not in coded]
        coded.update(zip(rest, self._bytes(rest), strict=True))
        return [coded[w] for w in texts]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, given in UTF-8; bytes split at exactly ASCII white space."""
        if self.by_word:
            return encode_texts(texts, bytes.split, self.table)
        return iter(self._bytes([t.decode() for t in texts]))


def encoder(path: str) -> TokenEncoder:
    """One encoder for each tokenizer in a worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encodes every text, appends `end_id` and writes the blocks in doc_id order to `folder`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        width = tokens.width
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()
        start, held, doc_ids, parts, sizes = 0, 0, [], [], []

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), f"<u{width}")
            data = pack_block(doc_ids, np.cumsum(sizes, dtype=np.int64), ids, start, width)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                 "block": pa.array([data], pa.binary())}
            )

        for batch in batches:
            texts = tokens.encode(batch.column(1).cast(pa.binary()).to_pylist())
            for doc_id, coded in zip(batch.column(0).to_pylist(), texts, strict=True):
                doc_ids.append(doc_id)
                parts += (coded, end)
                sizes.append(len(coded) // width + 1)
                held += sizes[-1]
                if held >= block_tokens:
                    yield block()
                    start += held
                    held, doc_ids, parts, sizes = 0, [], [], []
        if doc_ids:
            yield block()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "shard int, n_ids long, block binary")
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .parquet(folder)
    )


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and ids), from the files at `folder`."""
    blocks = spark.read.parquet(folder)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"shard": [], "doc_id": [], "local": [], "n_tokens": [], "ids_crc32": [], "ids": []}
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block = Block(data)
            ids = block.ids.astype("<u4")
            begin = 0
            for doc_id, end in zip(block.doc_ids, block.ends, strict=True):
                out["shard"].append(shard)
                out["doc_id"].append(doc_id)
                out["local"].append(block.start + begin)
                out["n_tokens"].append(end - begin)
                out["ids_crc32"].append(zlib.crc32(ids[begin:end]))
                if with_ids:
                    out["ids"].append(ids[begin:end])
                begin = end
        if not with_ids:
            del out["ids"]
        kinds = (pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=False)], list(out)
        )

    columns = "shard int, doc_id long, local long, n_tokens long, ids_crc32 long"
    documents = over_batches(
        blocks.select("shard", "block"), work, columns + ", ids array<int>" * with_ids
    )
    # One row a shard, so as many as the writer had tasks: small whatever the data.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    )
    return documents.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids,
    )

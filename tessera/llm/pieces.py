"""SentencePiece encoding through a table of distinct chunks, and decoding.

The model writes a marker for each space and one in front of the text.  Where no piece
holds a marker after another character, and the model changes nothing else in a text, no
piece can cross from one marked word into the next: each distinct marked word is then
segmented once and its ids are joined back by position.  A model without that property is
given whole texts.  The table (`wordtable.WordTable`) lives in the task's worker and is
bounded, so that nothing is shuffled and memory does not grow with the vocabulary.

Defined results: a null or empty text has no ids and decodes to ''; a null doc_id stays
null; repeated rows give repeated rows; other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import over_batches, text_or_empty
from tessera.llm.wordtable import WordTable, encode_texts

MARK = "▁"
TABLE_WORDS = 100_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts exactly as the library does with the model at `path`."""

    def __init__(self, path: str, bound: int = TABLE_WORDS):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.separable = self._separable()
        self.table = WordTable(self._encode_words, bound)

    def _separable(self) -> bool:
        """Whether no piece crosses a marker and spaces and other characters pass unchanged."""
        model = self.model
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or MARK not in pieces:
            return False
        spaced = " a  b ① "
        return "".join(model.encode(spaced, out_type=str)).startswith(
            MARK + spaced.replace(" ", MARK)[:6]
        ) and model.encode("a ")[-1] == model.piece_to_id(MARK)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        # The library adds the first marker itself; a lone marker would vanish as an empty text.
        plain = [w[1:].replace(MARK, " ") for w in words]
        ids = self.model.encode(plain, num_threads=1)
        lone = [self.model.piece_to_id(MARK)]
        return [np.array(i if p else lone, "<i4").tobytes() for i, p in zip(ids, plain, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.separable:
            return [np.array(i, "<i4") for i in self.model.encode(texts, num_threads=1)]
        return [np.frombuffer(b, "<i4") for b in encode_texts(texts, self._split, self.table)]

    @staticmethod
    def _split(text: str) -> list[str]:
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist()) if len(ids) else ""


def encoder(path: str) -> PieceEncoder:
    """One encoder for each model in a worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every text; a narrow step."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = encoder(model_path)
        ids = pieces.encode(batch.column(1).to_pylist())
        offsets = np.zeros(len(ids) + 1, "<i4")
        np.cumsum([len(i) for i in ids], out=offsets[1:])
        values = np.concatenate([np.empty(0, "<i4"), *ids])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                pa.array([pieces.decode(i) for i in ids], pa.string()),
            ],
            ["doc_id", "ids", "decoded"],
        )

    return over_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")),
        work,
        "doc_id long, ids array<int>, decoded string",
    )

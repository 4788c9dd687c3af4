"""Token counts by overlap resynchronisation.

A document of up to ``huge`` characters is encoded whole.  A longer one is cut
into chunks that overlap, each encoded on its own with offsets; neighbouring
chunks are spliced at a boundary in their overlap that is *stable*: a single
space between two non-blank characters, at which both encodings start a token,
and after which both give the same ids up to the overlap's last such place.
The scan of the pre-tokeniser passes through every such place whatever came
before it, so what the left chunk has before it and the right chunk after it
are the tokens of the whole text.  Where an overlap holds no such place it is
doubled, at the most up to the rest of the document.  A worker holds one chunk
pair of a document besides its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .bpe import UnitEncoder, encoder
from .wordhash import cut_rows

_STABLE = re.compile(r"(?<=\S) (?=\S)")


class ChunkCounter:
    """Counts a text's tokens; ``widened`` counts how often an overlap had to grow."""

    def __init__(self, encoder: UnitEncoder, huge: int, chunk: int, overlap: int):
        if not 0 < overlap < chunk:
            raise ValueError("need 0 < overlap < chunk")
        self.encoder, self.huge, self.chunk, self.overlap = encoder, huge, chunk, overlap
        self.widened = 0

    def count(self, text: str | None) -> int:
        return int(self.counts(pa.array([text], pa.string()))[0])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text; those that aren't huge are encoded together."""
        if not self.encoder.splits:
            return self.encoder.counts(texts)
        huge = pc.fill_null(pc.greater(pc.utf8_length(texts), self.huge), False)
        apart = huge.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        out[~apart] = self.encoder.counts(texts.filter(pc.invert(huge)))
        for k in np.flatnonzero(apart).tolist():
            out[k] = self._spliced(texts[k].as_py())
        return out

    def _encode(self, piece: str):
        return self.encoder.tokenizer.encode(piece, add_special_tokens=False)

    def _spliced(self, text: str) -> int:
        total, n = 0, len(text)
        begin, overlap = 0, self.overlap
        left, left_from = None, 0  # the encoding of text[begin:end], and its first token that counts
        while True:
            end = min(n, begin + self.chunk + overlap)
            if left is None:
                left, left_from, begin_left, end_left = self._encode(text[begin:end]), 0, begin, end
            if end_left == n:
                return total + len(left.ids) - left_from
            right_begin = end_left - overlap
            right_end = min(n, right_begin + self.chunk + overlap)
            right = self._encode(text[right_begin:right_end])
            at = self._boundary(text, left, begin_left, end_left, right, right_begin)
            if at is None:
                self.widened += 1
                overlap *= 2
                end_left = min(n, begin_left + self.chunk + overlap)
                left = self._encode(text[begin_left:end_left])
                continue
            total += at[0] - left_from
            left, left_from, begin_left, end_left = right, at[1], right_begin, right_end
            overlap = self.overlap

    @staticmethod
    def _boundary(text, left, begin_left, end_left, right, begin_right) -> tuple[int, int] | None:
        places = [m.start() for m in _STABLE.finditer(text, max(begin_right, begin_left) + 1, end_left - 1)]
        if len(places) < 2:
            return None
        last = places[-1]

        def token(encoding, begin, place):  # of the token that starts at the space, whose offsets leave the space out
            k = encoding.char_to_token(place + 1 - begin)
            return k if k is not None and encoding.offsets[k][0] in (place - begin, place + 1 - begin) and (not k or encoding.offsets[k - 1][1] <= place - begin) else None

        stop = token(left, begin_left, last), token(right, begin_right, last)
        if None in stop:
            return None
        for place in places[:-1]:
            cut = token(left, begin_left, place), token(right, begin_right, place)
            if None not in cut and left.ids[cut[0] : stop[0]] == right.ids[cut[1] : stop[1]]:
                return cut
        return None


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, huge: int = 1 << 15, chunk: int = 1 << 13, overlap: int = 256) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts count 0 bytes and 0 tokens; a null id stays null; repeated
    rows are counted each; other columns are left out, whatever their names; an
    empty table gives an empty result.  One narrow pass: nothing is shuffled.  The splices hold for
    byte-level vocabularies with the standard split into words and no prefix space; with any other one
    each text is encoded whole, whatever its size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(encoder(tokenizer_path), huge, chunk, overlap)
        for t in cut_rows(batches, 1 << 21):
            t = t.combine_chunks()
            ids, texts = (c.chunk(0) for c in t.columns)
            n = counter.counts(texts)
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])
        store.release_memory()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)

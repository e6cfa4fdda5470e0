"""Token counts of a SentencePiece BPE model, with overlap resynchronisation for huge documents.

A merge joins neighbouring characters only if some vocabulary piece holds them side by side.  A position whose two
characters stand side by side in no piece is therefore stable: what is left of it never changes what is right of it.
A long text is encoded in chunks that overlap.  Inside the overlap both chunks' token starts are compared; at a start
common to both that is stable by the vocabulary the chunks are spliced.  If there is none, the overlap is widened, up
to the whole chunk, which is then encoded together with the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SPACE = "▁"


class ChunkedEncoder:
    """Exact token ids of texts of any length; the encoder itself sees at most about two chunks at once (more only where nothing is stable)."""

    def __init__(self, model: str, chunk: int = 1 << 15, overlap: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = [(self.sp.id_to_piece(i), self.sp.is_byte(i), self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(self.sp.vocab_size())]
        self.inside = {p[k:k + 2] for p, byte, other in pieces if not byte and not other for k in range(len(p) - 1)}
        #: characters that begin in a token: of a byte token one, unless it continues a character
        self.begins = np.array([int(not 0x80 <= int(p[3:5], 16) < 0xC0) if byte else len(p) for p, byte, _ in pieces])

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1].replace(" ", SPACE) not in self.inside

    def _encode(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice and the position in the text at which each begins (-1 inside a character)."""
        ids = np.array(self.sp.encode(text[start:end], num_threads=1), dtype=np.int64)
        n = self.begins[ids]
        at = np.cumsum(n) - n + start - 1  # the encoder puts one space before the slice
        return ids, np.where((n > 0) & (at >= start), at, -1)

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= self.chunk:
            return np.array(self.sp.encode(text, num_threads=1), dtype=np.int64)
        done, start, end = [], 0, self.chunk
        ids, at = self._encode(text, start, end)
        while end < len(text):
            overlap, splice = self.overlap, None
            upto = min(len(text), end + self.chunk)
            while splice is None and overlap < end - start:
                right = self._encode(text, end - overlap, upto)
                common = np.intersect1d(at[at >= 0], right[1][right[1] > end - overlap])
                splice = next((int(p) for p in common[::-1] if self.stable(text, int(p))), None)
                overlap *= 2
            if splice is None:
                ids, at = self._encode(text, start, upto)
            else:
                done.append(ids[:np.flatnonzero(at == splice)[0]])
                cut = np.flatnonzero(right[1] == splice)[0]
                ids, at, start = right[0][cut:], right[1][cut:], splice
            end = upto
        return np.concatenate([*done, ids])

    def count(self, texts: list[str]) -> list[int]:
        """Lengths, short texts in one call; ids of a few megabytes at once are held."""
        out, batch, size = [0] * len(texts), [], 0

        def flush() -> None:
            for i, ids in zip(batch, self.sp.encode([texts[i] for i in batch], num_threads=1), strict=True):
                out[i] = len(ids)
            batch.clear()

        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = len(self.ids(text))
                continue
            batch.append(i)
            size += len(text)
            if size > 1 << 19:
                flush()
                size = 0
        if batch:
            flush()
        return out


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per input row.

    Null text counts as empty (no tokens); null ids and repeated rows stay; other columns are ignored; an empty table
    gives no rows.  Each Python worker loads the model once; texts of any length are encoded whole.
    """

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = ChunkedEncoder(model)
        for texts in batches:
            yield pd.Series(encoder.count(texts.tolist()), dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

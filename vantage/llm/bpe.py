"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two bytes that stand side by side inside no vocabulary token can never be merged, so a text may be cut between them.
The fragments are encoded independently and their ids concatenated.  Pre-splitting looks at more than byte pairs, so a
cut is made only where it does not change that either: between characters, not after white space (the rule for white
space looks ahead), not before an apostrophe (contractions) and not inside a special token's string.  Fragments are
mostly words, so each worker keeps the ids of those it has seen, up to a number of bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class FragmentCodec:
    """Encodes and decodes whole texts, fragment by fragment.

    A block of text is worked on at once: fragments get a 64-bit key each, are looked up among those seen before in one
    search, and compared with them byte by byte, so equal keys of different fragments do no harm.  Past `keep` bytes
    with their ids (and the table that finds them) all are forgotten before the next block; fragments of more than `LONG` bytes are never kept.
    """

    LONG = 256
    BLOCK = 1 << 20

    def __init__(self, path: str, keep: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.tokens = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        listed = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.token_size = np.array([len(t) for t in listed])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(listed), np.uint8)
        never = np.ones((256, 256), dtype=bool)
        for token in self.tokens.values():
            for a, b in zip(token, token[1:], strict=False):
                never[a, b] = False
        for c in map(chr, range(0x3001)):
            if c.isspace():
                never[c.encode()[-1], :] = False
        never[:, 0x80:0xC0] = False  # inside a character
        never[:, ord("'")] = False
        self.never = never.ravel()
        self.whole = re.compile("|".join(re.escape(s) for s in self.special).encode()) if self.special else None
        rng = np.random.default_rng(1)
        self.letter_key, self.place_key = (rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, self.LONG))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.raw, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.raw_start, self.id_start = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.raw_size, self.id_size = np.zeros(0, np.uint16), np.zeros(0, np.uint16)
        self.table, self.shift = np.full(1 << 12, -1, np.int32), np.uint64(64 - 12)

    def cuts(self, raw: bytes) -> np.ndarray:
        """For each byte whether a fragment ends behind it."""
        codes = np.frombuffer(raw, np.uint8)
        cut = np.ones(len(codes), dtype=bool)
        cut[:-1] = self.never[(codes[:-1].astype(np.uint16) << 8) | codes[1:]]
        if self.whole:
            for m in self.whole.finditer(raw):
                cut[m.start():m.end() - 1] = False
        return cut

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the fragment with each key, -1 if there is none: the key's first bits lead into a table of
        numbers, and the search goes on from there to the next free place."""
        place = (keys >> self.shift).astype(np.int64)
        number = self.table[place]
        open_ = np.flatnonzero(number >= 0)
        while len(open_):
            open_ = open_[self.keys[number[open_]] != keys[open_]]
            place[open_] = (place[open_] + 1) & (len(self.table) - 1)
            number[open_] = self.table[place[open_]]
            open_ = open_[number[open_] >= 0]
        return number

    def _enter(self, numbers: np.ndarray) -> None:
        """Put fragments, by their numbers, into the first free places; of two that want one place one goes on."""
        place = (self.keys[numbers] >> self.shift).astype(np.int64)
        while len(numbers):
            free = self.table[place] < 0
            self.table[place[free]] = numbers[free]
            waits = self.table[place] != numbers
            numbers, place = numbers[waits], (place[waits] + 1) & (len(self.table) - 1)

    def _known(self, codes: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each fragment among the known ones, -1 if it is not there."""
        number = self._find(keys)
        hit = number >= 0
        hit[hit] = self.raw_size[number[hit]] == sizes[hit]
        starts, sizes, at = starts[hit], sizes[hit], number[hit]
        if len(at):
            inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            equal = codes[inner + np.repeat(starts, sizes)] == self.raw[inner + np.repeat(self.raw_start[at], sizes)]
            hit[hit] = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
        return np.where(hit, number, -1)

    def _learn(self, keys: np.ndarray, new: list[bytes]) -> None:
        """Encode fragments with keys that none has yet."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)]
        sizes, counts = np.array([len(x) for x in new]), np.array([len(x) for x in ids])
        before, starts, id_starts = len(self.keys), len(self.raw) + np.cumsum(sizes) - sizes, len(self.ids) + np.cumsum(counts) - counts
        for name, more in (("keys", keys), ("raw_start", starts), ("raw_size", sizes), ("id_start", id_starts), ("id_size", counts)):
            held = getattr(self, name)
            setattr(self, name, np.concatenate([held, more.astype(held.dtype)]))
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(new), np.uint8)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, counts.sum())])
        if 2 * len(self.keys) > len(self.table):
            bits = int(4 * len(self.keys)).bit_length()
            self.table, self.shift, before = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits), 0
        self._enter(np.arange(before, len(self.keys), dtype=np.int32))

    def _encode_block(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block cut into fragments that stop at `ends`, and the number of ids of each fragment."""
        if self.raw.nbytes + self.ids.nbytes + 20 * len(self.keys) + self.table.nbytes > self.keep:
            self._forget()
        codes, starts = np.frombuffer(raw, np.uint8), np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        place = np.minimum(np.arange(len(codes)) - np.repeat(starts, sizes), self.LONG - 1)
        keys = np.add.reduceat(self.letter_key[codes] * self.place_key[place], starts)
        slot = self._known(codes, keys, starts, sizes)
        unseen = np.flatnonzero((slot < 0) & (sizes <= self.LONG))
        if len(unseen):
            new, first = np.unique(keys[unseen], return_index=True)
            untaken = self._find(new) < 0
            if untaken.any():
                self._learn(new[untaken], [raw[starts[i]:ends[i]] for i in unseen[first[untaken]].tolist()])
            slot[unseen] = self._known(codes, keys[unseen], starts[unseen], sizes[unseen])
        direct = np.flatnonzero(slot < 0).tolist()
        own = [e.ids for e in self.tokenizer.encode_batch_fast([raw[starts[i]:ends[i]].decode() for i in direct], add_special_tokens=False)]
        hit = slot >= 0
        counts = np.zeros(len(slot), np.int64)
        counts[hit] = self.id_size[slot[hit]]
        shift = np.repeat(self.id_start[slot[hit]] - (np.cumsum(counts[hit]) - counts[hit]), counts[hit])
        known = self.ids[np.arange(len(shift)) + shift]
        if not direct:
            return known, counts
        counts[direct] = [len(x) for x in own]
        begin, ids = np.cumsum(counts) - counts, np.empty(counts.sum(), np.uint32)
        ids[np.repeat(hit, counts)] = known
        for i, x in zip(direct, own, strict=True):
            ids[begin[i]:begin[i] + len(x)] = x
        return ids, counts

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text.  Short texts are joined to blocks, long ones cut into blocks where a fragment ends."""
        waiting: list[tuple[bytes, np.ndarray]] = []
        held = 0
        for text in texts:
            raw = (text or "").encode()
            waiting.append((raw, np.flatnonzero(self.cuts(raw)) + 1))
            held += len(raw)
            if held >= self.BLOCK:
                yield from self._blocks(waiting)
                waiting, held = [], 0
        yield from self._blocks(waiting)

    def _blocks(self, waiting: list[tuple[bytes, np.ndarray]]) -> Iterator[np.ndarray]:
        short = [(raw, ends) for raw, ends in waiting if len(raw) < self.BLOCK]
        ids, per_text = np.zeros(0, np.uint32), iter(())
        if any(raw for raw, _ in short):
            sizes = np.array([len(raw) for raw, _ in short])
            ends = np.concatenate([ends + a for (_, ends), a in zip(short, np.cumsum(sizes) - sizes, strict=True)])
            ids, counts = self._encode_block(b"".join([raw for raw, _ in short]), ends)
            upto = np.concatenate([[0], np.cumsum(counts)])
            per_text = iter(np.split(ids, upto[np.cumsum([len(ends) for _, ends in short])[:-1]]))
        for raw, ends in waiting:
            if len(raw) < self.BLOCK:
                yield next(per_text, ids)
            else:
                marks = np.unique(np.searchsorted(ends, [*range(self.BLOCK, len(raw), self.BLOCK), len(raw)])) + 1
                parts, a, e = [], 0, 0
                for m in marks.tolist():
                    parts.append(self._encode_block(raw[a:ends[m - 1]], ends[e:m] - a)[0])
                    a, e = int(ends[m - 1]), m
                yield np.concatenate(parts)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        sizes = self.token_size[ids]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.token_bytes[inner + np.repeat(self.token_start[ids], sizes)].tobytes()

    def decode(self, ids) -> str:
        """The text of ids, as the decoder writes it: bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, dtype=np.int64)
        return b"".join(self.decode_bytes(ids[i:i + self.BLOCK]) for i in range(0, len(ids), self.BLOCK)).decode("utf-8", "replace")

    def round_trips(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, and the text decoded from them."""
        for ids in self.encode_all(texts):
            yield ids.astype("<u4").tobytes(), self.decode(ids)


@lru_cache(maxsize=1)
def shared_codec(path: str) -> FragmentCodec:
    """The codec of a Python worker; tasks that follow each other in a worker go on with the fragments it knows."""
    return FragmentCodec(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the ids of each whole text as an array; null text gives no ids.  A column called `into` is replaced."""

    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = shared_codec(path)
        for texts in batches:
            yield pd.Series([ids.astype(np.int32) for ids in codec.encode_all(texts.tolist())], dtype=object)

    return docs.withColumn(into, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """`docs` with the text of an array of ids; null gives the empty text."""

    @pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = shared_codec(path)
        for arrays in batches:
            yield pd.Series([codec.decode(a) for a in arrays], dtype=object)

    return docs.withColumn(into, texts(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def encode_checked(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with `ids`, `n_tokens` and `round_trip` (whether the ids decode to the text), encoded and decoded in one pass.

    Null text counts as empty; columns of these names are replaced.
    """

    @pandas_udf("ids array<int>, round_trip boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = shared_codec(path)
        for texts in batches:
            rows = list(zip(codec.round_trips(texts.tolist()), texts, strict=True))
            yield pd.DataFrame({"ids": [np.frombuffer(ids, "<i4") for (ids, _), _ in rows], "round_trip": [back == t for (_, back), t in rows]})

    held = "coded"
    while held in docs.columns:
        held += "_"
    rows = docs.withColumn(held, both(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.withColumns({"ids": F.col(f"{held}.ids"), "n_tokens": F.size(f"{held}.ids").cast("long"), "round_trip": F.col(f"{held}.round_trip")}).drop(held)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per input row: every text encoded whole and decoded again.

    Null text counts as empty; null ids and repeated rows stay; other columns are ignored; an empty table gives none.
    """

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = shared_codec(path)
        for texts in batches:
            rows = []
            for ids, back in codec.round_trips(texts.tolist()):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), both(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).select("doc_id", "x.*")

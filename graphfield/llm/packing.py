"""Packing: first-fit decreasing by a tournament tree of bin capacities, in randomised groups of documents.

A document is tokenised once, in the scan, and cut at multiples of the sequence
length.  Its full pieces are sequences as they stand; the rest goes to bins.
Groups are dealt by a hash of the piece and its place in the scan (a task that is run
again reads its rows in the same order), so equal rows spread too; they hold about
``group_docs`` documents at any corpus size, and are packed apart, so no state is shared
and nothing is collected.  Only piece descriptions (no ids) are shuffled.

Nulls count as empty texts; an empty text is one piece, the closing id.  A text of any
length is tokenised whole, chunk by chunk between white space.  Pieces of equal size
(ties) go by row hash, doc_id and start.  A null
doc_id is kept and packed like any other.  Repeated rows are packed once each.
Extra columns are ignored.  An empty table gives no pieces.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, per_batch, ready, text_bytes

SEQUENCE, END_ID, GROUP_DOCS = 2048, 1, 1024
#: Chunks that need no Unicode normalisation and lower-case by character: Latin-1 letters, then at most one run of ASCII marks other than apostrophes, a token's word of its own.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?")
#: Bytes that a worker's chunks may hold, and its words as well.
KEPT_BYTES = 96 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Chunks(Kept):
    """A chunk between white space to its ids, as little-endian bytes.  White space never lies in a token, so chunks are independent."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self.ids_of, KEPT_BYTES)
        self.tokenizer, self.words = Tokenizer.from_file(path), Kept(self.word, KEPT_BYTES)
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def word(self, w: str) -> bytes:
        shown = w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if chunk.isalpha():
            return self.words[text.lower()]
        if m := PLAIN.fullmatch(text):
            return self.words[m[1].lower()] + (self.words[m[2]] if m[2] else b"")
        got = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(got)}I", *got)


_CHUNKS: dict[str, Chunks] = {}


def encoder(path: str) -> Chunks:
    """One for each worker process, so that tasks share what earlier ones have looked up."""
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path]


def encoded(text: bytes | None, chunks: Chunks, end_id: int = END_ID) -> bytes:
    """A document's ids and the closing one, as little-endian unsigned 32-bit numbers."""
    return b"".join(map(chunks.__getitem__, (text or b"").split())) + struct.pack("<I", end_id)


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and a hash of the row for each piece; its ids too, if asked for."""
    ready(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def make():
        chunks = encoder(path)

        def step(rows):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", *["ids"] * with_ids)}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = encoded(text, chunks, end_id)
                n, row = len(ids) // 4, zlib.crc32(ids) ^ zlib.crc32(str(doc).encode(), 1)
                for start in range(0, n, sequence):
                    part = ids[4 * start : 4 * (start + sequence)]
                    for k, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n, row, part), strict=False):
                        out[k].append(v)
            return out

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), text_bytes()), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids binary" * with_ids, make)


class Capacities:
    """A tournament over bins in order of opening: each inner node holds the larger capacity of its two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(1, (bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """The first bin with room, and its room before: left wherever the left half holds a fit."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        had, bin_ = best[at], at - self.leaves
        best[at] -= need
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, in the order given, which must be decreasing."""
    tree, bins, offsets = Capacities(max(1, len(sizes)), room), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, need in enumerate(sizes.tolist()):
        bins[i], had = tree.place(need)
        offsets[i] = room - had
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its sequence and the offset there."""
    cut = pieces(docs, tokenizer, sequence, end_id, with_ids)
    groups = max(1, -(-docs.count() // group_docs))
    cut = cut.withColumn("bunch", F.pmod(F.xxhash64("row", "doc_id", F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        full = int((sizes == sequence).sum())
        bins, offsets = first_fit_decreasing(sizes[full:], sequence)
        at = np.concatenate([np.arange(full), full + bins])
        return pdf.assign(sequence_id=int(pdf["bunch"].iloc[0]) * (1 << 32) + at, offset=np.concatenate([np.zeros(full, np.int64), offsets])).drop(columns=["bunch", "row"])

    kept = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return cut.groupBy("bunch").applyInPandas(run, kept + ", sequence_id long, offset long")


def sequences(packed: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The padded sequences themselves, of what pack(with_ids=True) gives; a sequence that fills a power of two isn't padded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(pdf.sort_values("offset")["ids"])
        n = len(ids) // 4
        if n & (n - 1):
            ids += struct.pack("<I", pad_id) * (sequence - n)
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids], "n_tokens": [n]})

    return packed.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids binary, n_tokens long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


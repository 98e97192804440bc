"""Benchmark decontamination by an FM-index for each training shard.

A shard (an Arrow batch of documents) is turned into one sequence of word
numbers.  Words that no test phrase of the block holds can't lie in an
occurrence, so each run of them becomes one separator, and runs shorter than the
shortest phrase go altogether; the alphabet is then the block's vocabulary.  The
index is the Burrows-Wheeler transform of that sequence in a wavelet tree (bit
rows with rank counts, most significant bit first) with every ``sample``-th
suffix position kept.  All phrases of a block take each backward-search step
together; occurrences are located by walking the last-to-first map to a sampled
position, and their spans are merged in the document.

Phrases come in blocks of about ``block_bytes`` of item text, each a broadcast of its
own.  The driver makes one block at a time, and a task holds one at a time, for which it
indexes its shard, and drops it before the next; blocks wait on executors' disks.
Documents aren't shuffled.

Null texts, and items that are null or without words, have no words and no hits.  Texts
may be of any length; a shard holds at least one whole text.  Items with the same window
(ties) all have it.
Items with a null id are ignored.  An item given twice counts once.  A document
row given twice gives two rows.  Extra columns are ignored.  With an empty
benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, per_batch, ready, text_bytes

WINDOW, BLOCK_BYTES, SAMPLE = 10, 2_000_000, 16


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class Wavelet:
    """Ranks over a sequence of symbols: one bit row for each bit of a symbol, stably parted by it."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.rows, self.zeros, self.bits = [], [], bits
        for b in reversed(range(bits)):
            bit = (symbols >> b) & 1
            self.rows.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.rows[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        lo, hi = np.zeros_like(at), at
        for level, b in enumerate(reversed(range(self.bits))):
            ones, one = self.rows[level], (symbol >> b) & 1 == 1
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(one, self.zeros[level] + lo1, lo - lo1), np.where(one, self.zeros[level] + hi1, hi - hi1)
        return hi - lo


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable").astype(np.int64)
    rank = np.zeros(n + 1, np.int64)  # the last is the empty suffix, before all
    head = np.concatenate([[True], s[order[1:]] != s[order[:-1]]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group + 1
    width = 1
    while width < n:
        tie = np.concatenate([group[1:] == group[:-1], [False]])
        tie[1:] |= tie[:-1].copy()
        slots = np.flatnonzero(tie)
        if not len(slots):
            break
        at = order[slots]
        key = rank[np.minimum(at + width, n)]
        perm = np.lexsort((key, group[slots]))
        at, key, own = at[perm], key[perm], group[slots][perm]
        order[slots] = at
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        group[slots] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[at] = group[slots] + 1
        width *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a sequence of symbols from 1 on; 0 parts documents and unknown words."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        size += 1  # in here all symbols are one higher, so that the end is a symbol of its own
        s = np.concatenate([symbols + 1, [0]]).astype(np.int64)
        order = suffix_array(s)
        self.n, self.bits = len(s), int(size).bit_length()
        self.bwt = s[order - 1]
        self.tree = Wavelet(self.bwt, self.bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size + 1))])[: size + 1]
        kept = order % sample == 0
        self.is_kept, self.kept_rank, self.kept = kept, np.concatenate([[0], np.cumsum(kept)]), order[kept]

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of suffixes that begin with each phrase, all phrases going back one word at a time."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        length = np.array([len(p) for p in phrases])
        for back in range(1, int(length.max(initial=0)) + 1):
            live = np.flatnonzero((length >= back) & (lo < hi))
            if not len(live):
                break
            c = np.array([phrases[i][-back] + 1 for i in live])
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Suffix positions: step to the suffix before until a sampled one, and add the steps."""
        at, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.is_kept[at]
            out[todo[done]] = self.kept[self.kept_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.bwt[at]
            at, steps = self.before[c] + self.tree.rank(c, at), steps + 1
        return out


class Phrases:
    """The windows of a block of items, each once, and which items hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.phrases = [np.array(p, np.int64) for p in found]
        self.items = list(found.values())
        self.shortest = min(map(len, found), default=1)


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size, one at a time."""
    rows, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), text_bytes()).where("item_id is not null and text is not null").toLocalIterator():
        rows.append((item, bytes(text)))
        size += len(text)
        if size >= block_bytes:
            yield Phrases(rows, window)
            rows, size = [], 0
    if rows:
        yield Phrases(rows, window)


def shard_hits(docs: list[list[bytes]], block: Phrases, sample: int = SAMPLE) -> Iterator[tuple[int, int, int, set[str]]]:
    """(document, first word, end, items) of each occurrence in a shard."""
    if not block.phrases:
        return
    get, parts, homes, base = block.vocabulary.get, [], [], 0
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    every = np.zeros(starts[-1], np.int64)
    for d, start in zip(docs, starts, strict=False):
        every[start : start + len(d)] = np.fromiter((get(w, 0) for w in d), np.int64, len(d))
    known = np.concatenate([[False], every > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    for a, b in edge.reshape(-1, 2)[(edge[1::2] - edge[::2]) >= block.shortest]:
        parts += [every[a:b], [0]]
        homes.append((base, a))
        base += b - a + 1
    if not parts:
        return
    index = FMIndex(np.concatenate(parts), len(block.vocabulary), sample)
    lo, hi = index.search(block.phrases)
    which = np.repeat(np.arange(len(lo)), hi - lo)
    if not len(which):
        return
    rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
    place, runs = index.locate(rows), np.array(homes)
    run = np.searchsorted(runs[:, 0], place, "right") - 1
    place = place - runs[run, 0] + runs[run, 1]
    doc = np.searchsorted(starts, place, "right") - 1
    for i, p, k in zip(doc.tolist(), (place - starts[doc]).tolist(), which.tolist(), strict=True):
        yield i, p, p + len(block.phrases[k]), block.items[k]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def drop(b) -> None:
    """Forget a broadcast's value in this process; its file stays, and is read when the value is asked for again."""
    if getattr(b, "_path", None) is not None:
        b.__dict__.pop("_value", None)


def _hits(texts: list[bytes | None], sent: list) -> tuple[list[list[bytes]], list[list[tuple[int, int]]], list[set[str]]]:
    docs = [words_of(t) for t in texts]
    spans: list[list] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]
    for b in sent:
        for d, a, e, of in shard_hits(docs, b.value):
            spans[d].append((a, e))
            items[d] |= of
        if len(sent) > 1:
            drop(b)
    return docs, [merged(s) for s in spans], items


def _sent(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    sc = ready(docs.sparkSession).sparkContext
    sent = []
    for block in blocks(benchmark, window, block_bytes):
        sent.append(sc.broadcast(block))
        drop(sent[-1])
    return sent


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: its words, those hit, the merged removal spans in words, and the items found."""
    sent = _sent(docs, benchmark, window, block_bytes)

    def make():
        def step(rows):
            words, spans, items = _hits(rows["text"], sent)
            hit = [sum(b - a for a, b in s) for s in spans]
            return {
                "doc_id": rows["doc_id"], "n_words": [len(w) for w in words], "n_hit": hit, "n_items": [len(i) for i in items],
                "items_sha256": [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], "contaminated": [h > 0 for h in hit],
                "spans": [[{"first": a, "end": b} for a, b in s] for s in spans],
            }

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), text_bytes()), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:int,end:int>>", make)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    sent = _sent(docs, benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not s for s in _hits(texts, sent)[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")

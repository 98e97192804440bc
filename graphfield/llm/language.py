"""Language ID by prediction by partial matching.

For each language a byte context tree: counts of the byte that follows each context
of up to ``order`` bytes, in whole texts (A-Z in lower case, all other bytes as they
are; before a text stand blanks).  A byte costs the escapes from the contexts that
don't know it plus its code in the longest one that does (escape method C, no
exclusion; below order 0 all 256 bytes are alike).  Statistics are frozen after
learning.  Costs are integers of 1/1024 bit, so a text's code length is exact
whatever way its bytes are summed.  All languages' trees are merged: a row of costs, one
for each language, for every byte in a context that any of them knows, looked up for
``SLICE`` bytes at a time.

Learning takes at most ``docs_per_lang`` documents for each language, those with the
least hash, and of one at most ``doc_bytes`` bytes; that sample is all that reaches
the driver.  Documents to be judged are scanned whole, however long.

A null text, or one without a letter (Unicode category L), is ``und`` with score 0, as
is every text when nothing could be learned.  Ties go to the first language in order.
Rows with a null doc_id are judged (held_out false) but not learned from.  Repeated
rows are judged each.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, ready, text_bytes

ORDER, DOCS_PER_LANG, DOC_BYTES = 4, 400, 16_384
UNIT, SLICE = 1024, 1 << 19
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")
NONE = np.uint64((1 << 64) - 1)


class Places:
    """Where each of some keys stands, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.key, self.place = np.full(1 << self.bits, NONE), np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self.start(keys)
        while len(todo):
            free = np.flatnonzero(self.key[at] == NONE)
            slot, first = np.unique(at[free], return_index=True)
            self.key[slot], self.place[slot] = keys[todo[free[first]]], todo[free[first]]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo, at = todo[left], at[left] + 1 & (1 << self.bits) - 1

    def start(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.start(keys)
        got = self.key[at]
        out = np.where(got == keys, self.place[at], np.int32(-1))
        live = np.flatnonzero((got != keys) & (got != NONE))
        at = at[live]
        while len(live):
            at = at + 1 & (1 << self.bits) - 1
            got = self.key[at]
            hit = got == keys[live]
            out[live[hit]] = self.place[at[hit]]
            on = ~hit & (got != NONE)
            live, at = live[on], at[on]
        return out


def grams(text: np.ndarray, n: int) -> np.ndarray:
    """The number that each n consecutive bytes make, for each end."""
    out = np.zeros(max(0, len(text) - n + 1), np.uint64)
    for j in range(n):
        out = out << np.uint64(8) | text[j : len(text) - n + 1 + j]
    return out


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in a row, each after ``order`` blanks, and where each begins."""
    blanks = b" " * order
    starts = np.cumsum([0, *(len(t) + order for t in texts)])[:-1] + order
    return np.frombuffer(b"".join(blanks + t for t in texts), np.uint8), starts


class Trees:
    """The frozen trees of all languages, merged: costs by context and byte, and by context for a byte it doesn't know."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        self.known: list[tuple[Places, np.ndarray]] = []
        self.escapes: list[tuple[Places, np.ndarray]] = []
        whole = [padded([t.translate(LOWER) for t in samples[x]], order) for x in self.langs]
        bits = lambda part, total: np.round(-np.log2(part / total) * UNIT).astype(np.int32)
        last: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(order + 1):
            trees = []
            for (text, starts), lang in zip(whole, self.langs, strict=True):
                inside = np.ones(len(text), bool)
                for j in range(order):
                    inside[starts - 1 - j] = False
                gram, count = np.unique(grams(text, k + 1)[inside[k:]], return_counts=True) if samples[lang] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                context, own, kinds = np.unique(gram >> np.uint64(8), return_inverse=True, return_counts=True)
                total = np.bincount(own, count, len(context)) + kinds
                trees.append((gram, bits(count, total[own]), context, bits(kinds, total)))
            every, contexts = (np.unique(np.concatenate([t[i] for t in trees] or [np.zeros(0, np.uint64)])) for i in (0, 2))
            escape = np.zeros((len(contexts), len(trees)), np.int32)
            for i, t in enumerate(trees):
                escape[np.searchsorted(contexts, t[2]), i] = t[3]
            if last is None:
                cost = np.full((len(every), len(trees)), 8 * UNIT, np.int32)
            else:
                cost = last[1][np.searchsorted(last[0], every & np.uint64((1 << 8 * k) - 1))]
            cost = cost + escape[np.searchsorted(contexts, every >> np.uint64(8))]
            for i, t in enumerate(trees):
                cost[np.searchsorted(every, t[0]), i] = t[1]
            last = (every, cost)
            self.known.append((Places(every), cost))
            self.escapes.append((Places(contexts), escape))

    def costs(self, text: np.ndarray) -> np.ndarray:
        """Costs of each byte after the first ``order``, a column for each language."""
        n = len(text) - self.order
        out, todo = np.zeros((n, len(self.langs)), np.int32), np.arange(n)
        whole = grams(text, self.order + 1)
        for k in range(self.order, -1, -1):
            gram = whole[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            places, cost = self.known[k]
            at = places.find(gram)
            hit = at >= 0
            out[todo[hit]] += cost[at[hit]]
            todo, gram = todo[~hit], gram[~hit]
            places, escape = self.escapes[k]
            at = places.find(gram >> np.uint64(8))
            out[todo[at >= 0]] += escape[at[at >= 0]]
        out[todo] += 8 * UNIT
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        text, starts = padded([t.translate(LOWER) for t in texts], self.order)
        ends = starts + [len(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for a in range(self.order, len(text), SLICE):
            b = min(len(text), a + SLICE)
            cost = np.concatenate([np.zeros((1, len(self.langs)), np.int64), np.cumsum(self.costs(text[a - self.order : b]), 0, dtype=np.int64)])
            lo, hi = (np.clip(x, a, b) - a for x in (starts, ends))
            out += cost[hi] - cost[lo]
        return out


def lettered(text: bytes | None) -> bool:
    """Whether the text has a letter."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))))


def judged(texts: list[bytes | None], trees: Trees) -> list[tuple[str, float]]:
    """For each text the language of least code length, and its share of the probability that all languages give the text."""
    out = [("und", 0.0)] * len(texts)
    some = [i for i, t in enumerate(texts) if trees.langs and lettered(t)]
    if some:
        for i, lengths in zip(some, trees.lengths([texts[i] for i in some]), strict=True):
            best = int(lengths.argmin())
            out[i] = (trees.langs[best], float(1 / np.exp2(np.maximum(-1000, (lengths[best] - lengths) / UNIT)).sum()))
    return out


def fold(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG, doc_bytes: int = DOC_BYTES, usable=None) -> Trees:
    """Trees from a bounded sample of the documents with a language, of those that ``usable`` admits."""
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string"), text_bytes()).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    if usable is not None:
        rows = rows.where(usable)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000))
    sample = None
    for r in rows.groupBy("lang").count().collect():
        # twice as many as are wanted on average, so that the sort sees few rows
        near = rows.where((F.col("lang") == r["lang"]) & (place <= 2_000_000 * (docs_per_lang + 10) // r["count"]))
        part = near.select("lang", place.alias("place"), F.substring("text", 1, doc_bytes).alias("text")).orderBy("place", "text").limit(docs_per_lang)
        sample = part if sample is None else sample.unionByName(part)
    samples: dict[str, list[bytes]] = {}
    for r in sample.collect() if sample is not None else []:
        samples.setdefault(r["lang"], []).append(bytes(r["text"]))
    return Trees({k: sorted(v) for k, v in samples.items()}, order)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred and score for each document."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(trees)  # bounded by the sample

    def make():
        def step(rows):
            got = judged(rows["text"], sent.value)
            return {"doc_id": rows["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), text_bytes()), "doc_id long, lang_pred string, score double", make)


def accept(docs: DataFrame, trees: Trees, least: float = 0.0) -> DataFrame:
    """The documents with a language, of at least that score, with all their columns."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judged(batch.column("text").cast(pa.binary()).to_pylist(), sent.value)
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    trees = learn(docs, usable=fold() != 2)
    return predict(docs, trees).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

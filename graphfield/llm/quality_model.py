"""Quality by a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on a document.  Expectation
maximisation over the histogram of all documents' vote patterns estimates, without labels, how each
labeller votes on good and on bad documents, and the share of good ones.  The posteriors of the
documents in a sample are then soft labels for a logistic scorer over hashed
words and the votes' own inputs, which judges every whole document.

The sample for the scorer is at most ``sample_docs`` documents, those with the least
hash of doc_id, and of each at most ``DOC_BYTES`` bytes; it and the histogram (bounded by
the labellers' patterns, a few hundred in practice) alone reach the driver, and the
weights (2**``bits`` floats) alone are broadcast.  Patterns and scores are those of whole
texts of any length.

A null or empty text has no words: score 0, not kept.  A score of exactly the limit (a
tie) is kept.  Repeated rows are judged each.  Extra columns are ignored.  From an empty
table nothing is learned and no rows come.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, per_batch, ready, text_bytes, windows

SAMPLE_DOCS, DOC_BYTES, BITS, EPOCHS = 3000, 32_768, 16, 30
SYMBOL = b"#*$%&|<>{}[]=\\~^"
SYMBOLS = bytes(set(range(256)) - set(SYMBOL))
NO_CAPS = bytes(set(range(256)) - set(range(65, 91)))
CAPS_OUT = bytes(set(range(256)) - set(range(97, 123)))
SYMBOL_WORD = re.compile(rb"[^ \t-\r]*[" + re.escape(SYMBOL) + rb"][^ \t-\r]*")


def measures(text: bytes, words: list[bytes], h: np.ndarray) -> np.ndarray:
    """What the labellers look at; ``h`` are the words' hashes.

    Words, distinct share, share of the commonest word, of words like the one before, and of
    five-word windows seen before; repeated lines' share; symbols a word, share of words with
    one, characters a word; share of capitals, of words that begin with one, exclamation marks
    a word; sentence ends a word.
    """
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = len(text.translate(None, NO_CAPS)), len(text.translate(None, CAPS_OUT))
    _, often = np.unique(h, return_counts=True)
    five = windows(h, 5)
    return np.array([
        len(words), len(often) / n, often.max(initial=0) / n, np.count_nonzero(h[1:] == h[:-1]) / n, 1 - len(np.unique(five)) / max(1, len(five)) if len(five) else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), len(text.translate(None, SYMBOLS)) / n, len(SYMBOL_WORD.findall(text)) / n, sum(map(len, words)) / n,
        upper / max(1, upper + lower), sum(w[:1].isupper() for w in words) / n, text.count(b"!") / n, (text.count(b". ") + text.count(b".\n") + text.endswith(b".")) / n,
    ])


#: Which measure, bad below, good from, good to, bad above; between them no vote, as without a range for good.  Each kind of junk (repetition, symbols, shouting) has several that overlap.
LABELLERS = (
    (0, 10, 30, 1e9, 1e9),
    (1, 0.4, 0.55, 1.0, 1.1),
    (2, -1.0, 2.0, 2.0, 0.2),
    (3, -1.0, 2.0, 2.0, 0.1),
    (4, -1.0, 0.0, 0.05, 0.3),
    (5, -1.0, 2.0, 2.0, 0.3),
    (6, -1.0, 0.0, 0.05, 0.2),
    (7, -1.0, 2.0, 2.0, 0.2),
    (8, 2.5, 1e9, 1e9, 7.0),
    (9, -1.0, 0.0, 0.3, 0.5),
    (10, -1.0, 2.0, 2.0, 0.6),
    (11, -1.0, 2.0, 2.0, 0.2),
    (12, 0.01, 0.02, 0.4, 0.8),
)


def votes(m: np.ndarray) -> tuple[int, ...]:
    return tuple(-1 if m[k] < lo or m[k] > hi else 1 if a <= m[k] <= b else 0 for k, lo, a, b, hi in LABELLERS)


def fit_labellers(patterns: Counter, rounds: int = 200, prior: float = 0.8) -> tuple[np.ndarray, float]:
    """log P(vote | class) as labeller x (bad, nothing, good) x (bad, good), and the share of good documents, by expectation maximisation."""
    v, n = np.array(list(patterns)).reshape(len(patterns), len(LABELLERS)), np.array(list(patterns.values()), float)
    table = np.log(np.broadcast_to(np.array([[0.4, 0.02], [0.1, 0.08], [0.5, 0.9]]), (len(LABELLERS), 3, 2)))
    pseudo = 4 * np.exp(table)
    for _ in range(rounds):
        p = posterior(v, table, prior)
        both = np.column_stack([n * (1 - p), n * p])
        seen = np.stack([(v == x).T.astype(float) @ both for x in (-1, 0, 1)], 1) + pseudo
        table = np.log(seen / seen.sum(1, keepdims=True))
        prior = float(np.clip(n @ p / n.sum(), 0.05, 0.95))
    return table, prior


def posterior(v: np.ndarray, table: np.ndarray, prior: float) -> np.ndarray:
    """P(good | votes) for each row of votes."""
    odds = (table[:, :, 1] - table[:, :, 0])[np.arange(len(LABELLERS)), np.asarray(v, int) + 1].sum(1)
    return 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -50, 50)))


class Scorer:
    """Weights of hashed words (their mean counts), of scaled measures, and a bias."""

    def __init__(self, words: np.ndarray, dense: np.ndarray, bias: float, table: np.ndarray, prior: float):
        self.words, self.dense, self.bias, self.table, self.prior = words, dense, bias, table, prior


def scaled(m: np.ndarray) -> np.ndarray:
    """Measures within [0, 1], with hinges where the labellers turn."""
    m = np.atleast_2d(m)
    bad = [np.maximum(m[:, k] < lo, m[:, k] > hi) for k, lo, _, _, hi in LABELLERS]
    return np.column_stack([np.minimum(1, np.log1p(m[:, 0]) / 8), np.minimum(1, m[:, 8] / 12), *np.minimum(1, m[:, [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12]]).T, *bad])


def patterns(docs: DataFrame) -> Counter:
    """How many documents have each pattern of votes; those with a null text don't count."""

    def make():
        ids = Ids()

        def step(rows):
            seen = Counter(votes(measures(t, w, ids.of(w))) for t in rows["text"] for w in [t.split()])
            return {"pattern": list(seen), "n": list(seen.values())}

        return step

    each = per_batch(docs.where(F.col("text").isNotNull()).select(text_bytes()), "pattern array<int>, n long", make)
    return Counter({tuple(r["pattern"]): r["n"] for r in each.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()})


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = BITS, epochs: int = EPOCHS) -> Scorer:
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(1_000_000))
    near = docs.where((place <= 2_000_000 * (sample_docs + 10) // max(1, docs.count())) & F.col("text").isNotNull())  # twice as many as are wanted on average
    texts = [bytes(r["text"]) for r in near.select(place.alias("place"), F.substring(text_bytes(), 1, DOC_BYTES).alias("text")).orderBy("place", "text").limit(sample_docs).collect()]
    ids, split = Ids(), [t.split() for t in texts]
    m = np.array([measures(t, w, ids.of(w)) for t, w in zip(texts, split, strict=True)]).reshape(-1, len(LABELLERS))
    v = [votes(x) for x in m]
    if not v:
        return Scorer(np.zeros(1 << bits), np.zeros(scaled(np.zeros(len(LABELLERS))).shape[1]), 0.0, np.zeros((len(LABELLERS), 3, 2)), 0.8)
    table, prior = fit_labellers(patterns(docs))
    y, dense = posterior(np.array(v), table, prior), scaled(m)
    size = np.array([max(1, len(w)) for w in split])
    row = np.repeat(np.arange(len(split)), [len(w) for w in split])
    col = np.concatenate([(ids.of(w) & np.uint64((1 << bits) - 1)).astype(np.int64) for w in split])
    value = 1 / np.sqrt(size)[row]
    w, d, bias = np.zeros(1 << bits), np.zeros(dense.shape[1]), 0.0
    for k in range(epochs):
        z = np.bincount(row, value * w[col], len(split)) + dense @ d + bias
        slip, rate = y - 1 / (1 + np.exp(-z)), 4.0 / (1 + 0.1 * k)
        w += rate * (np.bincount(col, value * slip[row], 1 << bits) / len(split) - 1e-3 * w)
        d += rate * (dense.T @ slip / len(split))
        bias += rate * slip.mean()
    return Scorer(w, d, bias, table, prior)


def score(docs: DataFrame, scorer: Scorer | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, the posterior of the labellers, the scorer's score and whether to keep, for each document."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(scorer or learn(docs))

    def make():
        s, ids = sent.value, Ids()
        mask = np.uint64(len(s.words) - 1)

        def step(rows):
            out = {k: [] for k in ("doc_id", "n_words", "label", "score", "kept")}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                words = (text or b"").split()
                p = z = 0.0
                if words:
                    h = ids.of(words)
                    m = measures(text, words, h)
                    p = float(posterior(np.array([votes(m)]), s.table, s.prior)[0])
                    w = s.words[(h & mask).astype(np.int64)].sum() / np.sqrt(len(words))
                    z = float(1 / (1 + np.exp(-(w + scaled(m)[0] @ s.dense + s.bias))))
                for k, x in zip(out, (doc, len(words), p, z, bool(words) and z >= least), strict=True):
                    out[k].append(x)
            return out

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), text_bytes()), "doc_id long, n_words long, label double, score double, kept boolean", make)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return score(table(spark, sf_dir, "documents"))

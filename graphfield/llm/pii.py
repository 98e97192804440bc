"""Personal data by a skip-chain conditional random field.

Nodes are the places of a document that may be personal data: number clusters of
seven digits or more, words with an ``@``, and words that repeat the local part of
an address.  A node's label is o, email, ip, card or phone.  Neighbouring nodes
share a chain potential.  However far apart, nodes with the same digits, or the same
word, share a skip potential, and nodes that are similar (the last seven digits, the
local part of an address, the network of an ip) a weaker one, each to the next alike, so
edges stay linear in the nodes.  Loopy sum-product message passing gives label
marginals.  Nodes that the base patterns match are observed; others become spans where a
label other than o has a marginal above ``sure``, so an entity that is written again in
another way takes the label it has elsewhere in the document.  The field runs on every
document with a node that isn't observed, with or without a base match.

All weights are learned together by pseudo-likelihood (a node's label given its features
and its neighbours' labels) from at most ``sample_docs`` documents, those with the least
hash of doc_id, and at most ``DOC_BYTES`` characters of each; their base matches are the
labels.  Each node counts twice, once with its features masked, so that potentials are
learned for what no pattern tells; nodes that equal an observed one without being matched
count nowhere.  Potentials have a normal prior (``PRIORS``, as strong
as ``STRENGTH`` nodes), which is what holds where a sample has no linked nodes.

Null and empty texts have no spans.  Offsets are code points, ends exclusive.  Texts are
scanned whole, of any length; time is linear in them but for sorting nodes.  Ties between
labels go to the first listed, o before all.  Repeated rows are judged each.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, ready

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, DOC_BYTES, SURE, ROUNDS = 4000, 32_768, 0.9, 12
#: Kinds of edges, and the means of their potentials' priors.
PRIORS, STRENGTH = {"chain": 0.0, "skip": 8.0, "similar": 3.0}, 20
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: All of an ip, card or phone match lies in one such region, and starts no earlier.
REGION = re.compile(r"[0-9+][0-9 ().+-]{6,}")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CLUSTER = re.compile(r"\+?\(?[0-9](?:[\x20().+/-]{0,2}[0-9])+")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{4,}")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base(text: str) -> dict[str, list[Span]]:
    """What the fixed patterns find, by kind."""
    out: dict[str, list[Span]] = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    for region in REGION.finditer(text):
        a, b = region.span()
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text, a, b):
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        for m in PHONE.finditer(text, a, b):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def nodes(text: str, found: dict[str, list[Span]]) -> list[tuple[int, int, str, int]]:
    """(start, end, what it shares with alike nodes, observed label or -1), in text order.  Observed ones are the base spans."""
    out, taken = [], []
    for k, kind in enumerate(KINDS, 1):
        for a, b in found[kind]:
            digits = NOT_DIGIT.sub("", text[a:b])
            out.append((a, b, text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else digits, k))
            taken.append((a, b))
    joined: list[list[int]] = []  # what base spans cover, in order
    for a, b in sorted(taken):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])

    def free(a: int, b: int) -> bool:
        at = bisect_right(joined, [b - 1, len(text) + 1]) - 1
        return at < 0 or joined[at][1] <= a

    for m in CLUSTER.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if len(digits) >= 7 and free(*m.span()):
            out.append((*m.span(), digits, -1))
    names = {text[a:b].partition("@")[0].lower(): text[a:b].lower() for a, b in found["email"]}
    names = {n: whole for n, whole in names.items() if len(n) >= 5 and re.search(r"[0-9._]", n)}
    if names:
        for m in WORD.finditer(text):
            if (whole := names.get(m[0].lower().rstrip("."))) and free(*m.span()):
                out.append((m.start(), m.start() + len(m[0].rstrip(".")), whole, -1))
    return sorted(out)


#: The feature that stands for all others where they are masked.
MASKED = 1


def features(text: str, a: int, b: int) -> np.ndarray:
    s = text[a:b]
    digits = NOT_DIGIT.sub("", s)
    n = len(digits)
    return np.array([1, 0, "@" in s, 7 <= n <= 15, 16 <= n <= 19, n > 19, n >= 12 and luhn(digits), s[:1] == "+", s.count(".") == 3, s.count(".") > 0, " " in s or "-" in s, "(" in s, n == 0], float)


def likeness(key: str) -> str:
    """What similar nodes share: the local part of an address, the network of an ip, the last seven digits."""
    if "@" in key:
        return key.partition("@")[0]
    return key.rpartition(".")[0] if "." in key else key[-7:]


def linked(keys: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Edges of a document's nodes, by kind."""
    def alike(names: list[str]) -> list[tuple[int, int]]:
        last: dict[str, int] = {}
        out = []
        for i, name in enumerate(names):
            if name in last:
                out.append((last[name], i))
            last[name] = i
        return out

    skip = alike(keys)
    similar = [(i, j) for i, j in alike([likeness(k) for k in keys]) if keys[i] != keys[j]]
    return {"chain": [(i, i + 1) for i in sorted(set(range(len(keys) - 1)) - {i for i, j in skip + similar if j == i + 1})], "skip": skip, "similar": similar}


class Field:
    """Unary weights (features x labels), and log-potentials of agreeing over each kind of edge."""

    def __init__(self, unary: np.ndarray, potentials: dict[str, float]):
        self.unary, self.potentials = unary, potentials

    def marginals(self, x: np.ndarray, observed: np.ndarray, links: dict[str, list[tuple[int, int]]], rounds: int = ROUNDS) -> np.ndarray:
        labels = self.unary.shape[1]
        local = x @ self.unary
        local[observed >= 0] = -30.0
        local[observed >= 0, observed[observed >= 0]] = 30.0
        edges = [(i, j, self.potentials[kind]) for kind, pairs in links.items() for i, j in pairs]
        if edges:
            src = np.array([e[0] for e in edges] + [e[1] for e in edges])
            dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
            bonus = np.exp(np.array([e[2] for e in edges] * 2))[:, None] - 1
            back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
            told = np.zeros((len(src), labels))
            for _ in range(rounds):
                belief = local.copy()
                np.add.at(belief, dst, told)
                out = belief[src] - told[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.maximum(out.sum(1, keepdims=True) + bonus * out, 1e-300))
                new -= new.max(1, keepdims=True)
                if np.abs(new - told).max() < 1e-6:
                    break
                told = new
            np.add.at(local, dst, told)
        p = np.exp(local - local.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def scan(text: str | None, field: Field, sure: float = SURE) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans, by kind."""
    found = base(text) if text else {k: [] for k in KINDS}
    seen = nodes(text, found) if text else []
    observed = np.array([n[3] for n in seen], int)
    every = {k: list(v) for k, v in found.items()}
    if (observed < 0).any():
        p = field.marginals(np.array([features(text, a, b) for a, b, _, _ in seen]), observed, linked([n[2] for n in seen]))
        for i in np.flatnonzero(observed < 0):
            k = int(p[i].argmax())
            if k and p[i, k] > sure:
                every[KINDS[k - 1]].append(seen[i][:2])
    return found, {k: sorted(v) for k, v in every.items()}


def fit(documents: list[tuple[np.ndarray, list[int], dict[str, list[tuple[int, int]]]]], steps: int = 300) -> Field:
    """Pseudo-likelihood of (features, labels, edges) of documents; a label of -1 isn't known, and counts nowhere."""
    width, labels = len(features("", 0, 0)), len(KINDS) + 1
    xs, ys, near = [], [], {k: [] for k in PRIORS}
    for x, y, links in documents:
        y = np.array(y)
        told, known = np.eye(labels)[np.maximum(y, 0)] * (y >= 0)[:, None], y >= 0
        for kind, pairs in links.items():
            n = np.zeros((len(y), labels))
            for i, j in pairs:
                n[i] += told[j]
                n[j] += told[i]
            near[kind] += [n[known], n[known]]
        hidden = np.zeros_like(x)
        hidden[:, MASKED] = 1
        xs += [x[known], hidden[known]]
        ys += [told[known], told[known]]
    w, theta = np.zeros((width, labels)), dict(PRIORS)
    if xs:
        x, y, n = np.concatenate(xs), np.concatenate(ys), {k: np.concatenate(v) for k, v in near.items()}
        for _ in range(steps):
            z = x @ w + sum(theta[k] * n[k] for k in theta)
            p = np.exp(z - z.max(1, keepdims=True))
            slip = y - p / p.sum(1, keepdims=True)
            w += 2.0 * (x.T @ slip / len(x) - 1e-4 * w)
            for k in theta:
                theta[k] += 2.0 * (float((slip * n[k]).sum()) - STRENGTH * 0.05 * (theta[k] - PRIORS[k])) / len(x)
    return Field(w, theta)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = 300) -> Field:
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1_000_000))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("@|[0-9]{3}"))
    near = rows.where(place <= 2_000_000 * (sample_docs + 10) // max(1, docs.count()))  # twice as many as are wanted on average, at least
    documents = []
    for r in near.select(place.alias("place"), F.substring("text", 1, DOC_BYTES).alias("text")).orderBy("place", "text").limit(sample_docs).collect():
        text = r["text"]
        if seen := nodes(text, base(text)):
            held = {n[2] for n in seen if n[3] >= 0}  # what equals an observed node is no example of o
            documents.append((np.array([features(text, a, b) for a, b, _, _ in seen]), [n[3] if n[3] >= 0 else -1 if n[2] in held else 0 for n in seen], linked([n[2] for n in seen])))
    return fit(documents, steps)


def _listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """A row for each document: counts and digest of the base spans, and all spans."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(field or learn(docs))

    def make():
        def step(rows):
            got = [scan(t, sent.value) for t in rows["text"]]
            return (
                {"doc_id": rows["doc_id"]}
                | {f"n_{k}": [len(b[k]) for b, _ in got] for k in KINDS}
                | {"base_sha256": [hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in got], "spans": [_listed(e) for _, e in got], "n_added": [sum(map(len, e.values())) - sum(map(len, b.values())) for b, e in got], "n_spans": [sum(map(len, e.values())) for _, e in got]}
            )

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long", make)


def masked(text: str | None, field: Field) -> str | None:
    """The text with each span, or union of overlapping spans, as the first one's kind in angle brackets."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind in sorted((a, b, k) for k, spans in scan(text, field)[1].items() for a, b in spans):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join(out) + text[last:] if out else text


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All documents and columns, the text masked and n_chars its new length."""
    sent = ready(docs.sparkSession).sparkContext.broadcast(field or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [masked(t, sent.value) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(k, batch.schema.field(k), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return find(table(spark, sf_dir, "documents"))

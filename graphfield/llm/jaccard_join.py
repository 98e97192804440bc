"""N-gram Jaccard self-join with PartEnum signatures: classes, components and numbers of links.

A document's set is that of its word shingles, as 64-bit hashes.  A node is a class of
equal sets, named by a 64-bit digest.  Sets are banded by size; two sets that
may link lie in one band or in two that adjoin, where their difference is at most
``differences`` elements.  The domain of shingles is cut by a hash into ``n1`` parts
of ``n2`` smaller ones, with n1 * 2 above that bound: in some part the two sets differ
in one element at most, so they agree on all its smaller parts but one.  For each
part a signature is made of every choice of n2 - 1 smaller parts, so sets that link
share one.  A signature without elements would be shared by strangers, and is left
out.  n1 is a little larger than it must be, so that d differences leave n1 - d // 2
parts with one at most: if fewer parts of a set have an empty choice, it shares a
signature with elements all the same.  Otherwise it adds those of another cut; a pair
of which neither is safe in a cut has the next one in common (the last keeps all).

Signatures of two nodes or more are buckets: the signatures are summed up to the least
and the greatest node before a shuffle, and joined back, so hot ones can be split.
A set that links with a node shares a known number of signatures with it; a node with
fewer in buckets of more than ``FEW`` nodes meets all its links in small ones, and is
left out of the large ones, which so lose strangers with a passage in common.
The node that most buckets share is a bucket's pivot, and each other node is checked
against it.  Larger buckets that reach each other by common nodes have one pivot for all.  In
buckets of at most ``FEW`` nodes, pairs of different components by then are checked too.  Each node has a sketch, the
number of its elements in each of about half as many cells; the cells' differences
bound the sets' difference from below, so most pairs fall where the bucket is.  In a
larger bucket, pairs of two nodes x and y of which not both link with pivot c are left.
If y alone links with c, x and y differ from c in common elements:
of the differences x ^ c and y ^ c, at least (|x ^ c| + |y ^ c| - q (|x| + |y|)) / 2,
with q = (100 - percent) / (100 + percent).  So, as in a prefix filter, some element
is among the first few of both differences, those that c lacks coming first.  As Jaccard
distances add up, x is at most two links' distance from c.  If neither
links with c, some element is among the first few of both sets, in the same order.  Such
elements are the next buckets, without the pivot.  Each round drops buckets whose nodes
are in one component by now, and takes buckets of up to four times as many nodes pair by
pair as the last one, so rounds grow with the logarithm of the largest bucket.  No link
that joins two components is missed.

Components alone are what the pipeline needs.  ``op6_jaccard`` counts links as well: two
sets that link lie in one component, so the classes of each component are compared with
each other, all of them, in blocks of about ``BLOCK`` shingles.  That grows with the
squares of components.

Words are runs of other than ASCII white space, with A-Z in lower case.  A text of
fewer words than a shingle is one shingle; an empty or null one has none and links
with nothing.  Rows with the same doc_id count as linked, whatever their texts, each
row with its own set; their components are one.  A null doc_id
is compared like others, but names neither class nor component; it has null for all
but n_shingles.  A text may be of any length: it is held once in a task, its set
besides.  Ties (of pivots) go to the greater digest; equality of shingles, sets and
signatures is that of their 64-bit hashes (62 bits for signatures, 128 for classes).  Repeated rows give
a row each.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, _arrow, discard, mixed, per_batch, ready, stored, text_bytes, windows

SHINGLE, PERCENT = 3, 90
CUTS, SPARE, WIDE, FEW = 4, 12, 1.37, 64
#: Shingles of a block, the fewest that a set counts for (which bounds a block's sets), and columns of a product.
BLOCK, LEAST, COLUMNS = 200_000, 200, 4096


def shingles(text: bytes | None, ids: Ids, k: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(ids.of(words), min(k, len(words)), 0x51ED270B + min(k, len(words))))


class Bands:
    """Bands of set sizes, and the signatures of a set, for links at ``percent`` of the union."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.edges = percent, [1]

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * max(WIDE, 101 / self.percent)) + 1))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def groups(self, size: int) -> list[tuple[int, int, int]]:
        """(band, differences of its pairs, differences of this set's pairs) for the set's own band, and the one below if a partner can lie there.

        With a the smaller set, at most the band's last size, and a union of at most
        a * 100 / percent, the difference is at most a * (100 - percent) / percent.
        For sizes a and b it is at most (a + b) * (100 - percent) / (100 + percent).
        """
        own, largest = self.band(size), size * 100 // self.percent
        out = [(own, largest)]
        if own and (self.edges[own] - 1) * 100 >= self.percent * size:
            out.append((own - 1, self.edges[own] - 1))
        bounds = [(b, (self.edges[b + 1] - 1) * (100 - self.percent) // self.percent, (size + other) * (100 - self.percent) // (100 + self.percent)) for b, other in out]
        return [(b, k, min(k, d)) for b, k, d in bounds]

    @staticmethod
    def kept(n1: int, n2: int, d: int) -> int:
        """How many signatures of a cut two sets share at least (empty ones too), if they differ in d elements.

        The first difference in a part spoils the n2 - 1 signatures that hold its smaller
        part, a second one in the part those that are left, one.
        """
        return n1 * n2 - (n2 - 1) * min(d, n1) - max(0, min(d - n1, n1))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        return self.signed(s)[0]

    def signed(self, s: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The signatures, and how many of the first cut's a set that links shares with this one at least: for an even band, and for an odd one.

        The lowest bit of a signature is its band's, the next one is clear for the first cut.
        """
        sure = [0, 0]
        if not len(s):
            return s, sure
        out = []
        for band, k, d in self.groups(len(s)):
            if not k:  # only equal sets link
                continue
            n1, n2 = k // 2 + 1 + k // SPARE, 3 if k <= 15 else 2
            for cut in range(CUTS):
                x = mixed(s ^ np.uint64(0xA24BAED4963EE407 * (cut + 1) & (1 << 64) - 1))
                part = ((x >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
                low = np.bincount(part, (x & np.uint64(0xFFFFFFFF)).astype(float), n1 * n2).astype(np.uint64)
                high = np.bincount(part, (x >> np.uint64(32)).astype(float), n1 * n2).astype(np.uint64)
                sums = (low + (high << np.uint64(32))).reshape(n1, n2)
                count = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
                value = (sums.sum(1, keepdims=True, dtype=np.uint64) - sums).ravel()
                size = (count.sum(1, keepdims=True) - count).ravel()
                place = np.arange(n1 * n2, dtype=np.uint64) + np.uint64((band * CUTS + cut) << 40)
                value = mixed(value ^ mixed(place * np.uint64(2) + np.uint64(1)) ^ size.astype(np.uint64))
                value = value & ~np.uint64(3) | np.uint64(2 * (cut > 0) + band % 2)
                empty = size == 0
                if not cut:
                    sure[band % 2] = max(0, self.kept(n1, n2, d) - int(np.count_nonzero(empty)))
                if cut == CUTS - 1:
                    out.append(value)
                    break
                out.append(value[~empty])
                if np.count_nonzero(empty.reshape(n1, n2).any(1)) < n1 - d // 2:
                    break
        return (np.concatenate(out) if out else s[:0]), sure


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """How many elements lie in each of about half as many cells, a power of two; empty if a number is above a byte."""
    bits = max(3, int(len(s)).bit_length() - 1)
    cells = np.bincount((mixed(s ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return cells.astype(np.uint8).tobytes() if cells.max(initial=0) < 256 else b""


def may_link(na: int, a: bytes, nb: int, b: bytes, percent: int = PERCENT) -> bool:
    """False only for sketches whose sets can't link: the finer one is folded, and the cells' differences are a bound from below."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    apart = int(np.abs(x.reshape(len(y), -1).sum(1) - y).sum())
    return apart * (100 + percent) <= (na + nb) * (100 - percent)


SETS = "doc_id long, mark long, n_shingles long, k1 long, k2 long, sketch binary, signatures array<long>, sure array<int>"


def described(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, a hash of the text (with the doc_id, it names the row), set size, a 128-bit digest of the set, its sketch, its signatures and how many of them links share at least."""

    def make():
        ids, bands = Ids(), Bands(percent)

        def step(rows):
            out = {x: [] for x in ("doc_id", "mark", "n_shingles", "k1", "k2", "sketch", "signatures", "sure")}
            for doc, mark, text in zip(rows["doc_id"], rows["mark"], rows["text"], strict=True):
                s = shingles(text, ids, k)
                k1 = int(mixed(s).sum(dtype=np.uint64).view(np.int64))
                k2 = int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x9E3779B97F4A7C15)), initial=np.uint64(0)).view(np.int64))
                signatures, sure = bands.signed(s)
                for x, v in zip(out, (doc, mark, len(s), k1, k2, sketch(s), signatures.view(np.int64), sure), strict=True):
                    out[x].append(v)
            return out

        return step

    return per_batch(named(docs), SETS, make)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, mark (with the doc_id it names a row) and text."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).select("doc_id", F.xxhash64("text").alias("mark"), "text")


class _Sets(dict):
    """The sets of the nodes of one batch."""

    def __init__(self, ids: Ids, k: int):
        self.ids, self.k = ids, k

    def of(self, node: int, text: bytes) -> np.ndarray:
        if node not in self:
            self[node] = shingles(text, self.ids, self.k)
        return self[node]


def with_both(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) of nodes with those columns of both, as name_a and name_b."""
    a, b = (nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches with as many cells as the smallest has, one in a row."""
    least = min(map(len, sketches))
    return np.array([np.frombuffer(s, np.uint8).reshape(least, -1).sum(1, dtype=np.int32) for s in sketches])


def sifted(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of small buckets that their sketches don't rule out, of different components and of kinds that may link.

    Rows (signature, node, of, all, component, n_shingles, sketch) come sorted by signature;
    a bucket is compared where it is, so pairs that are ruled out never become rows.
    """
    arrow = _arrow(rows.sparkSession, "a long, b long")
    names = ("signature", "node", "of", "all", "component", "n_shingles")

    def pairs(t: pa.Table) -> pa.RecordBatch:
        sig, node, of, every, component, n = (t.column(c).to_numpy() for c in names)
        sketches = t.column("sketch").to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        out: set[tuple[int, int]] = set()
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(sig)], strict=True):
            own = sketches[lo:hi]
            cells = folded(own) if all(own) else None
            for i in range(hi - lo - 1):
                at, rest = lo + i, slice(lo + i + 1, hi)
                good = (component[rest] != component[at]) & (every[at] | (of[rest] != of[at]))
                if cells is not None and good.any():
                    good &= np.abs(cells[i + 1 :] - cells[i]).sum(1) * (100 + percent) <= (n[rest] + n[at]) * (100 - percent)
                out.update((min(int(node[at]), x), max(int(node[at]), x)) for x in node[rest][good].tolist())
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket so far may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column("signature").to_numpy()
            last = int(np.searchsorted(sig, sig[-1]))
            if last or (held and held[-1].column("signature")[-1].as_py() != sig[0]):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return rows.repartition("signature").sortWithinPartitions("signature").select(*names, "sketch").mapInArrow(run, "a long, b long").distinct()


def checked(pairs: DataFrame, nodes: DataFrame, k: int = SHINGLE, percent: int = PERCENT, sketched_already: bool = False) -> DataFrame:
    """The pairs (a, b) that link: by their sketches first, then judged on their whole texts."""

    def sketched():
        def step(rows):
            good = [may_link(*x, percent) for x in zip(rows["n_shingles_a"], rows["sketch_a"], rows["n_shingles_b"], rows["sketch_b"], strict=True)]
            return {x: [v for v, g in zip(rows[x], good, strict=True) if g] for x in ("a", "b")}

        return step

    def whole():
        ids = Ids()

        def step(rows):
            sets = _Sets(ids, k)
            good = [linked(sets.of(a, s), sets.of(b, t), percent) for a, b, s, t in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True)]
            return {x: [v for v, g in zip(rows[x], good, strict=True) if g] for x in ("a", "b")}

        return step

    some = pairs if sketched_already else per_batch(with_both(pairs, nodes, "n_shingles", "sketch"), "a long, b long", sketched)
    return per_batch(with_both(some, nodes, "text"), "a long, b long", whole)


def against_pivots(pairs: DataFrame, nodes: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For pairs (member a, pivot b): whether they link, and the next buckets, for pairs with a member that doesn't and for pairs of two such."""

    def make():
        ids = Ids()

        def step(rows):
            sets, out = _Sets(ids, k), {x: [] for x in ("a", "b", "linked", "near", "far")}
            for a, b, s, t in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
                x, c = sets.of(a, s), sets.of(b, t)
                own, lost = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                apart, n = np.concatenate([np.sort(mixed(own)), np.sort(mixed(lost))]), len(own) + len(lost)
                both = len(x) - len(own)
                link = 100 * both >= percent * (len(x) + len(lost))
                # distances add up: who is further off than two links' distance has no partner that links with the pivot
                close = 100 * both >= (2 * percent - 100) * (len(x) + len(lost))
                # more than half of this many in common, if the partner doesn't link with the pivot
                half = max(1, (n * (100 + percent) + (100 - percent) * (len(c) - len(x))) // (2 * (100 + percent)) + 1)
                least = max(1, -((len(x) * (100 - percent) - n * percent) // percent))
                # two that don't link with the pivot share an element of their first few, those that the pivot lacks coming first
                few = len(x) - -(-len(x) * percent // 100) + 1
                ordered = np.concatenate([apart[: len(own)], np.sort(mixed(np.intersect1d(x, c, assume_unique=True)))]) if not link else own
                name = lambda kind, size, of, b=b: mixed(of[: max(0, size)] ^ mixed(np.array([b], np.int64).view(np.uint64) * np.uint64(2) + np.uint64(kind))).view(np.int64)
                near = name(0, n - half + 1 if link else n - least + 1 if close else 0, apart)
                far = name(1, 0 if link else few, ordered)
                for key, v in zip(out, (a, b, link, near, far), strict=True):
                    out[key].append(v)
            return out

        return step

    return per_batch(with_both(pairs, nodes, "text"), "a long, b long, linked boolean, near array<long>, far array<long>", make)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for each node with a link.

    Each round takes the smallest label next door and then that node's own label, so
    the rounds grow with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("component")))
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.node == near.u, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("low"), F.col("component").alias("was"))
        up = low.select(F.col("node").alias("top"), F.col("low").alias("jump"))
        new = stored(low.join(up, low.low == up.top, "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("component"), "was"))
        discard(labels)
        done = new.where("component < was").isEmpty()
        labels = new.drop("was")
        if done:
            discard(edges)
            return labels


def grouped(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members with the component that their node is in by now."""
    of = labels.select(F.col("node").alias("of_node"), "component")
    return members.join(of.hint("merge"), F.col("node") == F.col("of_node"), "left").drop("of_node").withColumn("component", F.coalesce("component", "node"))


def spared(buckets: DataFrame, sets: DataFrame, few: int = FEW) -> DataFrame:
    """The buckets (signature, node) of two nodes or more, large ones without the nodes that share a small one with whatever links with them.

    A set that links shares so many signatures of the first cut with a node's (``sure``); if
    fewer of the node's lie in large buckets, they share one of a bucket whose pairs are all checked.
    """
    size = buckets.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    counted = stored(buckets.join(size.hint("merge"), "signature"))
    odd, first = F.col("signature").bitwiseAND(F.lit(1)).cast("int").alias("odd"), (F.col("signature").bitwiseAND(F.lit(2)) == 0).cast("int")
    large = counted.where(F.col("n") > few).select("signature", "node", odd, first.alias("first"))
    sure = sets.select(F.col("k1").alias("node"), "sure").dropDuplicates(["node"])
    free = large.groupBy("node", "odd").agg(F.sum("first").alias("large")).join(sure.hint("merge"), "node").where(F.col("large") < F.get("sure", F.col("odd"))).select("node", "odd")
    left = large.join(free.hint("merge"), ["node", "odd"], "left_anti").select("signature", "node")
    out = stored(counted.where(F.col("n") <= few).select("signature", "node").union(left))
    discard(counted)
    return out


def centred(stars: DataFrame, group: DataFrame) -> DataFrame:
    """(a, b): each node of buckets that reach each other by common nodes, and the pivot of most of theirs; stars are (node, pivot of a bucket), group their components."""
    often = stars.groupBy("b").agg(F.count("*").alias("often")).join(group.hint("merge"), F.col("b") == F.col("node"))
    centre = often.groupBy("component").agg(F.max_by("b", F.struct("often", "b")).alias("b"))
    return group.join(centre.hint("merge"), "component").where("node <> b").select(F.col("node").alias("a"), "b")


class Joined:
    """The stored tables of a join, all keyed by node (k1): rows, nodes in buckets with their texts, and labels."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, labels: DataFrame):
        self.rows, self.nodes, self.labels = rows, nodes, labels

    def discard(self) -> None:
        discard(self.rows, self.nodes, self.labels)


def joined(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> Joined:
    """All links that components need, found and followed."""
    sets = stored(described(docs, k, percent))
    each = sets.where("size(signatures) > 0").select(F.explode("signatures").alias("signature"), F.col("k1").alias("node"))
    shared = stored(each.groupBy("signature").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("signature"))
    every = stored(each.join(shared.hint("merge"), "signature").distinct())
    discard(shared)
    buckets = spared(every, sets, FEW)
    discard(every)
    lean = sets.where("n_shingles > 0").groupBy(F.col("k1").alias("node")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = buckets.select("node").distinct().join(lean.hint("merge"), "node").select("node", "row.doc_id", "row.mark", "n_shingles", "sketch")
    t = named(docs).withColumnRenamed("doc_id", "own").withColumnRenamed("mark", "hash")
    nodes = t.join(reps.hint("merge"), (F.col("own").eqNullSafe(F.col("doc_id"))) & (F.col("hash") == F.col("mark"))).dropDuplicates(["own", "hash"])
    nodes = stored(nodes.select("node", "n_shingles", "sketch", "text"))
    rows = stored(sets.select("doc_id", "mark", "n_shingles", "k1", "k2"))
    discard(sets)
    # of: 0 for members that link with the last pivot, 1 for others; a bucket with both has no pairs but of the two kinds
    members = buckets.select("signature", "node", F.lit(1).alias("of"), F.lit(True).alias("all"))
    found, spent, labels, few = [], [buckets], None, FEW
    while True:
        size = members.groupBy("signature").agg(F.count("*").alias("n"), F.sum("of").alias("n1"), F.first("all").alias("both")).where("n > 1 and (both or (n1 > 0 and n1 < n))").select("signature", "n")
        now = members.join(size.hint("merge"), "signature")
        if labels is not None:  # buckets within one component by now have nothing to add
            spent.append(now := stored(now))
            now = grouped(now, labels)
            apart = now.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("signature")
            now = now.join(apart.hint("merge"), "signature").drop("component")
        often = now.groupBy("node").agg(F.count("*").alias("often"))
        pivots = now.join(often.hint("merge"), "node").groupBy("signature").agg(F.max_by("node", F.struct("often", "node")).alias("pivot"))
        now = stored(now.join(pivots.hint("merge"), "signature"))
        discard(*spent)
        stars = stored(now.where("node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max(F.col("n") > few).alias("large")))
        large = stars.where("large").select("a", "b")
        group = components(large)
        seen = stored(against_pivots(centred(large, group), nodes, k, percent))
        discard(group)
        found += [stored(checked(stars.where("not large").select("a", "b"), nodes, k, percent)), stored(seen.where("linked").select("a", "b"))]
        more = not large.isEmpty()
        discard(stars)
        if labels is not None:
            discard(labels)
        labels = components(reduce(DataFrame.union, found))
        rest = grouped(now.where((F.col("n") <= few) & (F.col("node") != F.col("pivot"))), labels)
        apart = rest.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("signature")
        rest = rest.join(apart.hint("merge"), "signature").join(nodes.select(F.col("node"), "n_shingles", "sketch").hint("merge"), "node")
        found.append(stored(checked(sifted(rest, percent), nodes, k, percent, True)))
        discard(now)
        spent, few = [seen], 4 * few
        if not more:
            discard(seen, labels)
            break
        # a pivot's linked members look for partners only if others are close enough to have one
        wanted = seen.where("not linked and size(near) > 0").select(F.col("b").alias("pivot")).distinct()
        near = seen.join(wanted.hint("merge"), seen.b == wanted.pivot, "left_semi")
        near = near.select(F.explode("near").alias("signature"), F.col("a").alias("node"), (~F.col("linked")).cast("int").alias("of"), F.lit(False).alias("all"))
        far = seen.where("not linked").select(F.explode("far").alias("signature"), F.col("a").alias("node"), F.lit(1).alias("of"), F.lit(True).alias("all"))
        members = near.unionByName(far).distinct()
    doubled = rows.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where("least < most").select("doc_id", "least")
    same = rows.where("n_shingles > 0").join(doubled, "doc_id").where("k1 <> least").select(F.col("k1").alias("a"), F.col("least").alias("b"))
    labels = components(reduce(DataFrame.union, [same, *found]))
    discard(*found)
    return Joined(rows, nodes, labels)


def labelled(j: Joined) -> DataFrame:
    """The rows with their group: the least node that links reach; null for an empty set."""
    return j.rows.join(j.labels, j.rows.k1 == j.labels.node, "left").select("doc_id", "mark", "n_shingles", "k1", "k2", F.when(F.col("n_shingles") > 0, F.coalesce("component", "k1")).alias("group"))


def with_components(rows: DataFrame) -> DataFrame:
    """What labelled() gives, with the smallest doc_id of each group as component_id."""
    low = rows.where("group is not null and doc_id is not null").groupBy(F.col("group").alias("of_group")).agg(F.min("doc_id").alias("low"))
    return rows.join(low, F.col("group") == F.col("of_group"), "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))).drop("of_group", "low")


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    j = joined(docs, k, percent)
    out = stored(with_components(labelled(j)).select("doc_id", "n_shingles", "component_id"))
    j.discard()
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of the left shares with each of the right."""
    sizes = [len(s) for s in left + right]
    row = np.repeat(np.arange(len(sizes)), sizes)
    values, col, often = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    some = often > 1  # others are in one set only
    row, col = row[some[col]], (np.cumsum(some) - 1)[col[some[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(some.sum()), COLUMNS):
        at = slice(*np.searchsorted(col, [start, start + COLUMNS]))
        part = np.zeros((len(sizes), COLUMNS), np.float32)
        part[row[at], col[at] - start] = 1
        both += part[: len(left)] @ part[len(left) :].T
    return both.astype(np.int64)


def linked_documents(nodes: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, others): for each node (node, n_shingles, class_size, group, text) of a group, how many documents of other nodes link with it."""
    weight = F.greatest("n_shingles", F.lit(LEAST))
    groups = stored(nodes.groupBy("group").agg(F.count("*").alias("many"), F.sum(weight).alias("weight")).where("many > 1").select("group", F.ceil(F.col("weight") / BLOCK).alias("blocks"), "weight"))
    # groups of one block share tasks
    bundles = 1 + (groups.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0) // BLOCK
    near = nodes.join(groups.select("group", "blocks").hint("merge"), "group").withColumn("block", F.pmod(F.xxhash64("node", F.lit(61)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = near.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    key = F.when(F.col("blocks") == 1, F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(bundles)))).otherwise(F.concat_ws("-", "group", "i", "j"))
    rows = rows.select(key.alias("key"), "group", (F.col("block") == F.col("i")).alias("left"), (F.col("i") == F.col("j")).alias("same"), "node", "class_size", "text")

    def count(table: pa.Table) -> pa.Table:
        ids, out, parts = Ids(), {}, {}
        for group, left, same, node, size, text in zip(*(table[c].to_pylist() for c in ("group", "left", "same", "node", "class_size", "text")), strict=True):
            parts.setdefault(group, (same, [], []))[1 if left else 2].append((node, size, shingles(text, ids, k)))
        for same, a, b in parts.values():
            b = a if same else b
            if not a or not b:
                continue
            both = overlaps([x[2] for x in a], [x[2] for x in b])
            na, nb = (np.array([len(x[2]) for x in side]) for side in (a, b))
            link = 100 * both >= percent * (na[:, None] + nb - both)
            if same:
                np.fill_diagonal(link, False)
            for side, n in ((a, link @ np.array([x[1] for x in b])), *(() if same else ((b, np.array([x[1] for x in a]) @ link),))):
                for x, v in zip(side, n.tolist(), strict=True):
                    out[x[0]] = out.get(x[0], 0) + v
        return pa.table({"node": pa.array(list(out), pa.int64()), "others": pa.array(list(out.values()), pa.int64())})

    return rows.groupBy("key").applyInArrow(count, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, class_size, n_links and component_id of each document.

    A class is the documents with an equal set, by its smallest doc_id; n_links is how many
    other documents link with this row's set, its class's among them.
    """
    j = joined(docs, k, percent)
    rows = stored(with_components(labelled(j)))
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("k1").alias("node"), F.col("k2").alias("also")).agg(F.min("doc_id").alias("class"), F.count_distinct("doc_id").alias("size"), F.first("group").alias("of_group"))
    classes = stored(classes)
    some = j.nodes.join(classes.hint("merge"), "node").join(j.labels.hint("merge"), "node").select("node", "n_shingles", F.col("size").alias("class_size"), F.col("of_group").alias("group"), "text")
    others = stored(linked_documents(some, k, percent))
    j.discard()
    out = rows.join(classes, (rows.k1 == classes.node) & (rows.k2 == classes.also) & (F.col("n_shingles") > 0), "left").drop("node").join(others, F.col("k1") == others.node, "left")
    mine = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    alone = F.when(F.col("n_shingles") > 0, F.col("size") - 1 + F.coalesce("others", F.lit(0))).otherwise(F.lit(0))
    return out.select("doc_id", "n_shingles", mine(F.coalesce("class", "doc_id")).alias("class_id"), mine(F.coalesce("size", F.lit(1))).alias("class_size"), mine(alone).alias("n_links"), "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one row of each component (the smallest doc_id, a null one last), with all their columns.

    Of rows without words, one of each doc_id stays; those with a null doc_id all stay.
    """
    j = joined(docs, k, percent)
    rows = labelled(j)
    row = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("row")
    first = rows.where("group is not null").groupBy("group").agg(row).select("row.doc_id", "row.mark")
    bare = rows.where("group is null and doc_id is not null").groupBy("doc_id").agg(F.min("mark").alias("mark"))
    own = stored(first.union(bare).select(F.col("doc_id").alias("gf_doc"), F.col("mark").alias("gf_mark")))
    j.discard()
    mark, cast = F.xxhash64(F.col("text").cast("string").cast("binary")), F.col("doc_id").cast("long")
    marked = docs.withColumn("gf_text", mark)
    kept = marked.join(own.hint("merge"), cast.eqNullSafe(F.col("gf_doc")) & (F.col("gf_text") == F.col("gf_mark"))).dropDuplicates(["gf_doc", "gf_mark"]).select(*docs.columns)
    return kept.unionByName(docs.where(cast.isNull() & ~F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return links(table(spark, sf_dir, "documents"))

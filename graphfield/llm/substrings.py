"""Substring dedup on the De Bruijn graph of word k-mers.

An edge is a window of ``k`` words, from the node of its first k - 1 words to that of
its last k - 1.  An edge is repeated if it lies in two documents; its source is the
smallest doc_id that has it, and its first place there.

* Only edges that may be repeated are built.  Each window has an anchor, the least of
  the hashed ``anchor``-word windows in it: equal windows have equal anchors, and a
  text has few (about one for every four words).  Anchors of two different texts, or
  more, mark the windows whose edges are made: a row for each stretch of windows with
  one anchor, their 64-bit hashes in a list.  An edge is named by its anchor and its
  hash, 128 bits.
* Edges that follow each other in their source are a run, of at most ``RUN`` edges.
  Runs are cut at branching nodes (more than one repeated edge in or out), which a join
  of nodes and degrees finds, and joined where one's last node, with one edge in and one
  out, is another's first.  Pointer jumping over these links gives each piece its path,
  the compacted nonbranching one, and its place there, in as many rounds of joins as the
  longest chain has binary digits.  In a cycle without a branch, pieces stay apart.
* A document's edges, joined with their sources, make spans that follow one piece of a
  path.  The words at the source's coordinates go with each span to its document, and a
  span counts only if they are the words there.  What spans of earlier sources cover is
  removed.

Documents with equal words (by SHA-256) are folded to the smallest doc_id first; the
others are removed whole if they have a window at all.  Hot edges and runs meet one
small row in joins, which Spark can split; no list grows beyond one document's length.

Words are runs of other than ASCII white space, unchanged.  Null and empty texts have
none.  A text may be of any length; it is held once in a task.  Rows with the same
doc_id don't count against each other, whatever their texts; a null doc_id counts
against none and nothing counts against it.  Of equal places in a source (ties) the
first counts.  Repeated rows give a row each.  Extra columns are ignored.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Ids, _arrow, discard, per_batch, ready, stored, text_bytes, windows

WINDOW, ANCHOR, RUN = 13, 6, 256


def least_in(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive numbers."""
    done = 1
    while done < n:
        step = min(done, n - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def anchors(h: np.ndarray, k: int, anchor: int) -> np.ndarray:
    """The anchor of each k-word window."""
    return least_in(windows(h, anchor, 0xA5A5), k - anchor + 1)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, mark (with the doc_id it names a row) and text."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def outlined(docs: DataFrame, k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, mark, n_words, the digest of all words, its first 64 bits as key, and the distinct anchors of each document."""

    def make():
        ids = Ids()

        def step(rows):
            out = {x: [] for x in ("doc_id", "mark", "n_words", "digest", "key", "anchors")}
            for doc, mark, text in zip(rows["doc_id"], rows["mark"], rows["text"], strict=True):
                words = (text or b"").split()
                found = anchors(ids.of(words), k, anchor) if len(words) >= k else np.zeros(0, np.uint64)
                found = np.unique(found[np.flatnonzero(np.diff(found, prepend=~found[:1]))])  # neighbours are mostly equal
                digest = hashlib.sha256(b" ".join(words)).digest()
                for x, v in zip(out, (doc, mark, len(words), digest, int.from_bytes(digest[:8], "little", signed=True), found.view(np.int64)), strict=True):
                    out[x].append(v)
            return out

        return step

    return per_batch(named(docs), "doc_id long, mark long, n_words long, digest binary, key long, anchors array<long>", make)


def edges(marked: DataFrame, k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, doc_id, nth, first, hashes) of each stretch of windows with one anchor, if that is among the document's repeated ones."""
    schema = "anchor long, doc_id long, nth long, first int, hashes array<long>"
    arrow = _arrow(marked.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        for batch in batches:
            parts = [tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int32, np.int64, np.int64))]
            for doc, nth, text, again in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "nth", "text", "anchors")), strict=True):
                h = ids.of((text or b"").split())
                if len(h) < k:
                    continue
                own = anchors(h, k, anchor)
                pos = np.flatnonzero(np.isin(own, np.array(again, np.int64).view(np.uint64)))
                if not len(pos):
                    continue
                cut = np.concatenate([[True], (np.diff(pos) > 1) | (own[pos[1:]] != own[pos[:-1]])])
                starts = np.flatnonzero(cut)
                parts.append((own[pos[starts]].view(np.int64), np.full(len(starts), doc, np.int64), np.full(len(starts), nth, np.int64), pos[starts].astype(np.int32), np.diff(np.append(starts, len(pos))), windows(h, k, 0x1234567)[pos].view(np.int64)))
            a, doc, nth, first, size, hashes = (np.concatenate(c) for c in zip(*parts, strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(doc), pa.array(nth), pa.array(first), lists.cast(arrow.field("hashes").type)], schema=arrow)

    return marked.mapInArrow(run, schema)


def places(found: DataFrame) -> DataFrame:
    """(anchor, hash, doc_id, nth, pos) of each edge's occurrences."""
    return found.select("anchor", "doc_id", "nth", "first", F.posexplode("hashes").alias("i", "hash")).select("anchor", "hash", "doc_id", "nth", (F.col("first") + F.col("i")).alias("pos"))


def sourced(found: DataFrame, run: int = RUN) -> DataFrame:
    """(anchor, hash, source, of, at, run) of each repeated edge: its first place in its source, and the first edge of its run there."""
    each = places(found).groupBy("anchor", "hash").agg(F.min(F.struct("doc_id", "nth", "pos")).alias("first"), F.max("doc_id").alias("last"))
    each = each.where("first.doc_id < last").select("anchor", "hash", F.col("first.doc_id").alias("source"), F.col("first.nth").alias("of"), F.col("first.pos").alias("at"))
    order = Window.partitionBy("source", "of").orderBy("at")
    begins = F.when(F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(2)) > 1, F.col("at"))
    each = each.withColumn("begin", F.last(begins, ignorenulls=True).over(order))
    return each.select("anchor", "hash", "source", "of", "at", (F.col("begin") + F.lit(run) * F.floor((F.col("at") - F.col("begin")) / run)).cast("int").alias("run"))


def runs(repeated: DataFrame, texts: DataFrame, reps: DataFrame, k: int = WINDOW) -> DataFrame:
    """(source, of, run, n, words, nodes) of each run, read at its coordinates in the source's text: n edges, n + k - 1 words, n + 1 nodes."""
    each = repeated.groupBy("source", "of", "run").agg(F.count("*").cast("int").alias("n")).groupBy("source", "of").agg(F.collect_list(F.struct("run", "n")).alias("runs"))
    rows = reps.join(each.hint("merge"), (reps.doc_id == each.source) & (reps.nth == each["of"])).select("doc_id", "mark", "of", "runs")

    def make():
        ids = Ids()

        def step(batch):
            out = {x: [] for x in ("source", "of", "run", "n", "words", "nodes")}
            for doc, nth, text, parts in zip(batch["doc_id"], batch["of"], batch["text"], batch["runs"], strict=True):
                words = text.split()
                nodes = windows(ids.of(words), k - 1, 0x7654321).view(np.int64)
                for part in parts:
                    a, n = part["run"], part["n"]
                    for x, v in zip(out, (doc, nth, a, n, b" ".join(words[a : a + n + k - 1]), nodes[a : a + n + 1]), strict=True):
                        out[x].append(v)
            return out

        return step

    return per_batch(with_text(texts, rows), "source long, of long, run int, n int, words binary, nodes array<long>", make).dropDuplicates(["source", "of", "run"])


def with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (doc_id, mark, ...) with their texts."""
    own = rows.withColumnsRenamed({"doc_id": "own_doc", "mark": "own_mark"})
    return texts.join(own.hint("merge"), (texts.doc_id == F.col("own_doc")) & (texts.mark == F.col("own_mark"))).drop("own_doc", "own_mark")


def compacted(parts: DataFrame) -> DataFrame:
    """(source, of, run, words, pieces): the pieces of each run between branching nodes, each with its first edge and size, its path (source and first edge of its first piece) and the edges before it there."""
    ends = parts.select("source", "of", "run", "n", F.posexplode("nodes").alias("i", "node"))
    degrees = ends.groupBy("node").agg(F.sum((F.col("i") > 0).cast("int")).alias("ins"), F.sum((F.col("i") < F.col("n")).cast("int")).alias("outs"))
    degrees = stored(degrees)
    branching = degrees.where("ins > 1 or outs > 1").select("node")
    cuts = ends.where("i > 0 and i < n").join(branching.hint("merge"), "node").groupBy(F.col("source").alias("s"), F.col("of").alias("o"), F.col("run").alias("r")).agg(F.collect_list("i").alias("cuts"))
    cut = parts.join(cuts.hint("merge"), (parts.source == F.col("s")) & (parts["of"] == F.col("o")) & (parts.run == F.col("r")), "left").withColumn("c", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array("n")))))
    piece = F.explode(F.transform(F.slice("c", 1, F.size("c") - 1), lambda x, j: F.struct(x.alias("a"), F.get(F.col("c"), j + 1).alias("b"))))
    pieces = cut.select("source", "of", "run", "nodes", piece.alias("p")).select("source", "of", "run", (F.col("run") + F.col("p.a")).alias("first"), (F.col("p.b") - F.col("p.a")).alias("n"), F.get("nodes", F.col("p.a")).alias("head"), F.get("nodes", F.col("p.b")).alias("tail"))
    pieces = stored(pieces.withColumn("piece", F.struct("source", "of", "first")))
    through = degrees.where("ins = 1 and outs = 1").select("node")
    a, b = pieces.select(F.col("tail").alias("node"), F.col("piece").alias("before"), F.col("n").alias("size")), pieces.select(F.col("head").alias("node"), "piece")
    before = a.join(through.hint("merge"), "node").join(b.hint("merge"), "node").where("before <> piece").select("piece", "before", "size")
    # up: a piece further back, itself at a path's first; back: the edges from there
    up = pieces.select("piece").join(before.hint("merge"), "piece", "left").select("piece", F.coalesce("before", "piece").alias("up"), F.coalesce("size", F.lit(0)).cast("long").alias("back"), F.col("before").isNull().alias("done"))
    up = stored(up)
    left, last = up.where("not done").count(), None
    while left and left != last:  # each round ends a piece at least, until all that is left are cycles
        further = up.select(F.col("piece").alias("at"), F.col("up").alias("top"), F.col("back").alias("more"), F.col("done").alias("end"))
        new = stored(up.join(further.hint("merge"), up.up == further["at"]).select("piece", F.col("top").alias("up"), (F.col("back") + F.col("more")).alias("back"), (F.col("done") | F.col("end")).alias("done")))
        discard(up)
        up, left, last = new, new.where("not done").count(), left
    placed = pieces.join(up.hint("merge"), "piece").select("source", "of", "run", F.struct("first", "n", F.when(F.col("done"), F.col("up")).otherwise(F.col("piece")).alias("path"), F.when(F.col("done"), F.col("back")).otherwise(0).alias("offset")).alias("p"))
    out = stored(parts.select("source", "of", "run", "words").join(placed.groupBy("source", "of", "run").agg(F.collect_list("p").alias("pieces")).hint("merge"), ["source", "of", "run"]))
    discard(degrees, pieces, up)
    return out


def spans(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, nth, start, n, source, of, at, run): edges of a document that follow each other, as they do in one run of an earlier source."""
    schema = "doc_id long, nth long, start int, n int, source long, of long, at int, run int"
    arrow = _arrow(found.sparkSession, schema)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, nth, pos, source, of, at, run = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "nth", "pos", "source", "of", "at", "run"))
            if not len(doc):
                continue
            again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (nth[1:] == nth[:-1]) & (pos[1:] == pos[:-1])])  # of rows given twice
            doc, nth, pos, source, of, at, run = (c[~again] for c in (doc, nth, pos, source, of, at, run))
            cut = (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]) | (of[1:] != of[:-1]) | (np.diff(pos) != 1) | (source[1:] != source[:-1]) | (np.diff(at) != 1) | (run[1:] != run[:-1])
            starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
            n = np.diff(np.append(starts, len(doc))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[starts], nth[starts], pos[starts], n, source[starts], of[starts], at[starts], run[starts])], schema=arrow)

    later = places(found).join(repeated.hint("merge"), ["anchor", "hash"]).where("doc_id > source").select("doc_id", "nth", "pos", "source", "of", "at", "run")
    return later.repartition("doc_id", "nth").sortWithinPartitions("doc_id", "nth", "pos").mapInArrow(follow, schema)


def verified(texts: DataFrame, rows: DataFrame, k: int = WINDOW) -> DataFrame:
    """(digest, n_removed, kept, paths) for rows (doc_id, mark, digest, spans): what is left of a text without the spans whose words are the source's."""

    def make():
        def step(batch):
            out = {x: [] for x in ("digest", "n_removed", "kept", "paths")}
            for digest, text, lost in zip(batch["digest"], batch["text"], batch["spans"], strict=True):
                words = text.split()
                gone, paths = np.zeros(len(words) + 1, np.int64), []
                for s in lost:
                    a, b = s["start"], s["start"] + s["n"] + k - 1
                    if b <= len(words) and b" ".join(words[a:b]) == s["words"]:
                        gone[a] += 1
                        gone[b] -= 1
                        paths.append({"first": a, "end": b, "source": s["source"], "path_source": s["path"]["source"], "path_first": s["path"]["first"], "offset": s["offset"]})
                keep = np.cumsum(gone)[:-1] == 0
                left = [w for w, x in zip(words, keep.tolist(), strict=True) if x]
                for x, v in zip(out, (digest, len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), sorted(paths, key=lambda p: (p["first"], p["end"]))), strict=True):
                    out[x].append(v)
            return out

        return step

    schema = "digest binary, n_removed long, kept string, paths array<struct<first:int,end:int,source:long,path_source:long,path_first:int,offset:long>>"
    return per_batch(with_text(texts, rows), schema, make)


def dedupe(docs: DataFrame, k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the removed spans with their paths (empty for whole copies), for each document."""
    texts = named(docs)
    outline = stored(outlined(docs, k, anchor))
    usable = outline.where(f"n_words >= {k} and doc_id is not null")
    each = usable.select("key", F.explode("anchors").alias("anchor"))
    again = stored(each.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("anchor"))
    marks = stored(each.join(again.hint("merge"), "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
    lines = stored(outline.drop("anchors"))
    discard(outline, again)
    classes = lines.where(f"n_words >= {k} and doc_id is not null").groupBy("digest", "key").agg(F.min(F.struct("doc_id", "mark")).alias("row")).select("digest", "key", "row.doc_id", "row.mark")
    # nth tells texts of one doc_id apart: 0 for the first, or else the mark
    low = classes.groupBy(F.col("doc_id").alias("same_doc")).agg(F.min("mark").alias("low"))
    classes = classes.join(low, F.col("doc_id") == F.col("same_doc")).select("digest", "key", "doc_id", "mark", F.when(F.col("mark") == F.col("low"), 0).otherwise(F.col("mark")).alias("nth"))
    classes = stored(classes)
    marked = classes.select("key", "doc_id", "mark", "nth").join(marks.hint("merge"), "key")
    found = stored(edges(with_text(texts, marked.drop("key")), k, anchor))
    repeated = stored(sourced(found))
    discard(marks)
    parts = stored(runs(repeated, texts, classes.select("doc_id", "mark", "nth"), k))
    paths = compacted(parts)
    discard(parts)
    each_span = stored(spans(found, repeated))
    discard(found, repeated)
    # the words of each span as they stand in its source, cut where pieces of paths are
    here = each_span.join(paths.hint("merge"), ["source", "of", "run"]).select("doc_id", "nth", "start", "n", "source", "at", "run", "words", F.explode(F.filter("pieces", lambda p: (p["first"] < F.col("at") + F.col("n")) & (p["first"] + p["n"] > F.col("at")))).alias("p"))
    low, high = F.greatest("at", "p.first"), F.least(F.col("at") + F.col("n"), F.col("p.first") + F.col("p.n"))
    words = F.concat_ws(" ", F.slice(F.split(F.col("words").cast("string"), " "), low - F.col("run") + 1, high - low + (k - 1))).cast("binary")
    span = F.struct((F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("n"), "source", words.alias("words"), "p.path", (F.col("p.offset") + low - F.col("p.first")).alias("offset"))
    listed = here.groupBy("doc_id", "nth").agg(F.collect_list(span).alias("spans"))
    rows = classes.select("digest", "doc_id", "mark", "nth").join(listed.hint("merge"), ["doc_id", "nth"])
    cut = stored(verified(texts, rows, k).dropDuplicates(["digest"]))
    discard(each_span, paths)
    of = classes.select(F.col("digest").alias("same"), F.col("doc_id").alias("of"))
    out = lines.join(of, F.col("digest") == F.col("same"), "left").join(cut.withColumnRenamed("digest", "cut"), F.col("digest") == F.col("cut"), "left")
    copy, own = F.coalesce(F.col("of") < F.col("doc_id"), F.lit(False)), F.coalesce(F.col("of") == F.col("doc_id"), F.lit(False))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce(F.when(own, F.col("kept")), F.lower(F.hex("digest")))).alias("kept_sha256"), F.when(own, F.col("paths")).alias("paths"),
    )


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedupe(table(spark, sf_dir, "documents")).drop("paths")

"""Quality rules as learned decision lists, in Spark's own functions only.

Measures of every whole text are SQL expressions.  For learning, about ``sample``
labelled documents (by a hash of doc_id) have each measure binned at its quantiles,
and Spark counts them by bins, label and fold; only these counts reach the driver.
Sequential covering then grows a conjunction of thresholds by information gain on
two thirds of the counts, prunes it on the other third, keeps it if it is precise
enough on all, takes what it covers away and goes on.  The list is emitted as one
ordered CASE expression.

A null text has no words.  Texts are measured whole, of any length, in time linear in
them but for one sort of their windows' hashes; five-word windows are equal if their
64-bit hashes are.  Conditions of equal gain (ties) go by measure, direction and
threshold, the greatest first.  Labels that are null are ignored; a document labelled
twice counts as its worse label.  With no labels, or an empty table, there are no
rules and the base alone decides.  Repeated rows are judged each.  Extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

SAMPLE, QUANTILES, LEAST_PRECISION, LEAST_COVER, MOST_CONDITIONS, MOST_RULES = 4000, 16, 0.97, 6, 3, 12
SPACE, BLANKS, SYMBOLS = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\x0c\r", "#*$%&|<>"
MEASURES = ("n_words", "word_len", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "caps_share", "mark_share", "end_share")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base's counts, and the measures that rules are made of, for each document."""
    text, words = F.col("t"), F.col("w")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.filter(F.split(text, SPACE), lambda x: x != "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", "w", F.size("w").cast("long").alias("n_words"), (F.length(text) - without(BLANKS)).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("caps"), without("!?").alias("marks"), without(".").alias("ends"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))).alias("h"),
    )
    d = d.drop("w").withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(F.col("s"), j)["h"] == x["h"], F.lit(False))
    d = d.drop("h").withColumn("p", F.array_sort(F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("p"), j + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("word_len"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"), share("caps", "word_chars").alias("caps_share"), share("marks", "n_words").alias("mark_share"), share("ends", "n_words").alias("end_share"),
    )


Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]


def counted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, list[float]], list]:
    """Thresholds for each measure, and how many labelled documents there are by bins, label and fold."""
    near = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(43)), F.lit(1_000_000))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality is not null and doc_id is not null")
    some = known.where(near < 1 + int(1_000_000 * min(1.0, sample / max(1, known.count())))).groupBy("doc_id").agg((F.min("quality") <= 0).alias("bad"))
    # `some` is about `sample` rows at any size of the tables
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.withColumnRenamed("doc_id", "of")), F.col("doc_id") == F.col("of"))
    table = stored(measured(own).join(F.broadcast(some), "doc_id"))
    marks = [(k + 1) / (QUANTILES + 1) for k in range(QUANTILES)]
    row = table.agg(*[F.percentile_approx(m, marks, 100_000).alias(m) for m in MEASURES]).first()
    cuts = {m: sorted(set(row[m] or [])) for m in MEASURES}
    bin_of = lambda m: reduce(lambda a, b: a + b, [(F.col(m) > c).cast("int") for c in cuts[m]], F.lit(0)).alias(m)
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(47)), F.lit(3)) == 0
    cells = table.select(*[bin_of(m) for m in MEASURES], "bad", fold.alias("late")).groupBy(*MEASURES, "bad", "late").count().collect()
    discard(table)
    return cuts, cells


def cover(cuts: dict[str, list[float]], cells: list, least_precision: float = LEAST_PRECISION, least_cover: int = LEAST_COVER) -> list[Rule]:
    """The decision list: rules for documents to reject, in order.  Sets of documents are the bits of an integer."""
    masks: dict[Condition, int] = {}
    bad = late = every = at = 0
    for c in sorted(cells):
        bits = ((1 << c["count"]) - 1) << at
        every |= bits
        bad |= bits * c["bad"]
        late |= bits * c["late"]
        for m in MEASURES:
            for k, cut in enumerate(cuts[m]):
                key = (m, ">", cut) if c[m] > k else (m, "<=", cut)
                masks[key] = masks.get(key, 0) | bits
        at += c["count"]

    def score(mask: int) -> tuple[int, int]:
        return (mask & bad).bit_count(), (mask & ~bad).bit_count()

    def both(rule: Rule, within: int) -> int:
        return reduce(lambda a, c: a & masks[c], rule, within)

    rules: list[Rule] = []
    left = every
    while len(rules) < MOST_RULES and (left & bad & ~late).bit_count() >= least_cover:
        rule: Rule = ()
        now = left & ~late
        while len(rule) < MOST_CONDITIONS and score(now)[1]:
            p0, n0 = score(now)
            gains = [(p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))), c) for c, mask in masks.items() for p, n in [score(now & mask)] if p]
            gain, best = max(gains, key=lambda g: (g[0], g[1]), default=(0, None))
            if gain <= 0:
                break
            rule, now = (*rule, best), now & masks[best]
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1)(*score(both(r, left & late)))
        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule = rule[:-1]
        p, n = score(both(rule, left))
        if not rule or p < least_cover or p < least_precision * (p + n):
            break
        rules.append(rule)
        left &= ~both(rule, left)
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, or null."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = reduce(lambda a, b: a & b, [F.col(m) > c if op == ">" else F.col(m) <= c for m, op, c in rule])
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = measured(docs).withColumn("base_failed", failed).withColumn("rule", rejected(rules))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def op5_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return apply(docs, cover(*counted(docs, table(spark, sf_dir, "labels"))))

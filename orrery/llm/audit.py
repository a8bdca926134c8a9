"""Interaction audit of document filters: what each filter removes in every order in which the filters can be applied.

Documents are judged once. Words are exploded and counted by (document, word), then by document, for totals and distinct words; the
filters that need no words are joined to them. Each part of the table is then counted by the set of filters that its documents fail,
32 sets of five filters, and all that the audit tells of any order are sums over these counts.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import folders, settled, shared_table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: White space between words (fixed value).
SPACES = r"[\x20\x09-\x0D]+"


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


def word_totals(documents: DataFrame, *keys: str, text: str = "text", tasks: int | None = None) -> DataFrame:
    """Rows (keys, n_words, n_distinct) of all texts with a word: words are exploded and counted by (document, word), then by document.

    Each row is a document of its own: rows are dealt to tasks by their number, evenly whatever their keys are, and a document's words
    then meet in its task without being shuffled, those of a word first. Rows with equal keys must have equal texts; they make one row.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), *keys, text)
    dealt = rows.repartition(tasks, "row") if tasks else rows.repartition("row")
    words = dealt.select("row", *keys, F.explode(F.split(F.col(text), SPACES)).alias("word")).where("word <> ''")
    same = [F.max(k).alias(k) for k in keys]
    by_word = words.groupBy("row", "word").agg(F.count("*").alias("n"), *same)
    by_row = by_word.groupBy("row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"), *same)
    return by_row.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def _identity(text: str) -> list[Column]:
    """What tells texts apart: 120 bits of their SHA-256, as two numbers."""
    hex_ = F.sha2(text, 256)
    return [F.conv(F.substring(hex_, 1 + 15 * k, 15), 16, 10).cast("long").alias(c) for k, c in enumerate(IDENTITY)]


IDENTITY = ("d0", "d1")


def failed_filters(documents: DataFrame, part: str, doc: str = "doc_id", text: str = "text", task_bytes: int = 16 << 20) -> DataFrame:
    """Rows (part, doc_id, d0, d1, n, failed): how many rows of a part have a document, by id and content, and bit i of `failed` if it
    fails the filter FILTERS[i].

    A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * A-Z > 5 * code points. D: holds one of #$%&*|. E: a row of a smaller
    doc_id has the same text. Null texts are empty. A task has about `task_bytes` bytes of texts (or one text, if that is longer). A text
    that a third of all rows have is counted before it is shuffled, and what is known of it is written before it is joined.
    """
    spark = documents.sparkSession
    made = len(folders(spark))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = documents.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{doc}`").alias("doc_id"), body.alias("text"))
    base = base.select("part", "doc_id", "text", *_identity("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    marks = F.when(100 * capitals > 5 * F.length("text"), F.lit(4)).otherwise(F.lit(0)) + F.when(F.col("text").rlike(r"[#$%&*|]"), F.lit(8)).otherwise(F.lit(0))
    flags = base.select("part", "doc_id", *IDENTITY, marks.alias("marks"), F.octet_length("text").cast("long").alias("size"))
    rows = shared_table(flags.groupBy("part", "doc_id", *IDENTITY, "marks").agg(F.count("*").alias("n"), F.max("size").alias("size")), "rows")
    total = rows.agg(F.sum(F.col("n") * (F.col("size") + 1))).first()[0] or 0
    counted = shared_table(word_totals(base, "doc_id", *IDENTITY, tasks=max(1, math.ceil(total / task_bytes))), "words")
    owners = rows.groupBy(*IDENTITY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("last") > F.col("first"))
    owners = shared_table(owners.select(*IDENTITY, "first"), "owners")
    # outer: texts without a word have no row among the counted
    judged = rows.join(counted, _same(rows, counted, "doc_id", *IDENTITY), "left").select("part", rows["doc_id"], *[rows[c] for c in IDENTITY], "n", "marks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_distinct")])
    judged = judged.join(owners, [*IDENTITY], "left")
    bit = lambda fails, value: F.when(fails, F.lit(value)).otherwise(F.lit(0))
    words = bit(F.col("n_words") < 50, 1) + bit(100 * F.col("n_distinct") < 65 * F.col("n_words"), 2)
    failed = F.col("marks") + words + bit(F.col("doc_id") > F.col("first"), 16)
    return settled(judged.select("part", "doc_id", *IDENTITY, "n", failed.cast("int").alias("failed")), "failed", made)


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, its documents by the set of filters that they fail: columns n0 .. n31, and of those labelled good and toxic g0 ..
    and t0 .. . A document is good or toxic if any of its labels says so; without a label, or without an id, it is neither."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = failed.join(shared_table(known, "labels"), "doc_id", "left")
    only = lambda label: F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias(label[0])
    by_set = joined.groupBy("part", "failed").agg(F.sum("n").alias("n"), only("good"), only("toxic"))
    return by_set.groupBy("part").agg(*[F.sum(F.when(F.col("failed") == s, F.col(k)).otherwise(0)).alias(f"{k}{s}") for k in "ngt" for s in range(SETS)])


def _orders() -> Column:
    """A row for each order and step: the filter's bit, and the bits of those before it."""
    steps = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        steps += [{"filter_order": "".join(order), "step": k + 1, "bit": bit, "before": sum(bits[:k])} for k, bit in enumerate(bits)]
    return F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>"))


def interactions(counts: DataFrame) -> DataFrame:
    """For each part, order and step of set_counts()'s rows: documents kept after the step, removed in it, redundant (failing its filter
    but removed before), failing its filter alone, good and toxic ones removed in it, and removed by its filter over all orders."""
    arrays = [F.array(*[F.col(f"{k}{s}") for s in range(SETS)]).alias(k) for k in "ngt"]
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))
    each = counts.select("part", *arrays, _orders().alias("o")).select("part", "n", "g", "t", "o.*")
    fails, before = lambda s: s.bitwiseAND(F.col("bit")) != 0, lambda s: s.bitwiseAND(F.col("before")) != 0

    def total(kind: str, picks) -> Column:
        return F.aggregate(F.filter(sets, picks), F.lit(0).cast("long"), lambda sum_, s: sum_ + F.get(F.col(kind), s))

    # whoever fails k filters is removed by each of them in 120 / k of the 120 orders
    share = F.array(*[F.lit(120 // max(1, s.bit_count())) for s in range(SETS)])
    shapley = F.aggregate(F.filter(sets, fails), F.lit(0).cast("long"), lambda sum_, s: sum_ + F.get(F.col("n"), s) * F.get(share, s))
    return each.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda s: ~fails(s) & ~before(s)).alias("kept"),
        total("n", lambda s: fails(s) & ~before(s)).alias("removed"),
        total("n", lambda s: fails(s) & before(s)).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"),
        total("g", lambda s: fails(s) & ~before(s)).alias("good_lost"),
        total("t", lambda s: fails(s) & ~before(s)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over whole documents, by parts. An empty table gives no rows; only the named columns are read."""
    return interactions(shared_table(set_counts(failed_filters(documents, part), labels), "counts"))

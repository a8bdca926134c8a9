"""Set-similarity join by prefix filter, and greedy near-duplicate removal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.graph import ensure_checkpoints

#: Counters of items, by the low bits of their hashes: a table of 2 MB.
COUNTER_BITS = 18
#: Ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Items, and pairs, of the sets that meet in one group to be compared: 4 MB of items, however large the table.
ITEMS_A_GROUP = 500_000
#: Rows whose items are sorted at once.
ROWS_AT_ONCE = 1_000


def _mixer():
    """A function that mixes the bits of 64-bit numbers; made here, as what is sent to tasks must not ask for this package there."""

    def mixed(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return v ^ (v >> np.uint64(32))

    return mixed


def _each(make, size: int):
    """A function over Arrow batches (id, words, ...), words being lists of hashes; a list's set are the mixed distinct runs of `size` of
    them, a shorter list being one run. `make` gets the rows whose set isn't empty, the sets' items one after another, each set sorted,
    and the sets' sizes."""
    mixed = _mixer()

    def sets(words):
        n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        long = np.minimum(n, size)
        row = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n) <= (n - long)[row])
        row = row[at]
        long = long[row]
        run = long.astype(np.uint64)
        for k in range(size):
            run = np.where(k < long, run * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at + k, len(hashes) - 1)], run)
        run = mixed(run).view(np.int64)
        run = run[np.lexsort((run, row))]
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
        return run[new], np.bincount(row[new], minlength=len(n))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(k, ROWS_AT_ONCE)
                items, n = sets(rows.column(1))
                if len(items):
                    yield make(rows.filter(pa.array(n > 0)), items, n[n > 0])

    return run


def _counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often items occur, by the low bits of their hashes."""

    each = _each(lambda rows, items, n: items, size)

    def run(batches):
        total = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for items in each(batches):
            total += np.bincount(items & ((1 << COUNTER_BITS) - 1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    found = rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[found["k"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """Rows (h, id, n, place): the first n - ceil(t n) + 1 items of each set, the rarest first by a table of counters. Items that share a
    counter make the order less good, but it is one order for all sets, so that nothing is lost."""
    counts = rows.sparkSession.sparkContext.broadcast(_counts(rows, size))

    def make(rows, items, n):
        row = np.repeat(np.arange(len(n)), n)
        items = items[np.lexsort((counts.value[items & ((1 << COUNTER_BITS) - 1)], row))]  # stable, so equal counts are in the hashes' order
        place = np.arange(len(items)) - np.repeat(np.cumsum(n) - n, n) + 1
        first = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        keep = place <= first[row]
        return pa.RecordBatch.from_arrays([pa.array(items[keep]), rows.column(0).take(pa.array(row[keep])), pa.array(n[row[keep]]), pa.array(place[keep])], names=["h", "id", "n", "place"])

    return rows.mapInArrow(_each(make, size), f"h long, id {rows.schema['id'].dataType.simpleString()}, n long, place long")


def _digests(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, x, y, n): 128 bits that equal sets share, whatever the order of their items, and their size."""

    mixed = _mixer()

    def make(rows, items, n):
        start, h = np.cumsum(n) - n, items.view(np.uint64)
        x, y = (np.add.reduceat(v, start).view(np.int64) for v in (h, mixed(h)))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(x), pa.array(y), pa.array(n)], names=["id", "x", "y", "n"])

    return rows.mapInArrow(_each(make, size), f"id {rows.schema['id'].dataType.simpleString()}, x long, y long, n long")


def _meeting(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number `at` of a group in which their sets meet, of (a, b, n_a, n_b) with the sets' sizes.

    Pairs are put together by the least key that `a` is in a pair with, which is the same in all pairs of a group of near copies, so that
    a set is moved once for all of them. Many small such groups are one. Of one with more than ITEMS_A_GROUP items or pairs, the sets are
    dealt to parts, and each two parts meet apart from the others.
    """
    least = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a").groupBy("id").agg(F.min("a").alias("near"))
    near = pairs.join(least.withColumnRenamed("id", "a"), "a").checkpoint()
    sets = near.select("near", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("id"), F.col("n_b").alias("n")))).alias("s")).distinct()
    many = sets.groupBy("near").agg(F.sum("s.n").alias("items")).join(near.groupBy("near").agg(F.count("*").alias("rows")), "near")
    parts = many.select("near", "items", "rows", F.greatest(F.ceil(F.col("items") / ITEMS_A_GROUP), F.ceil(F.sqrt(F.col("rows") / ITEMS_A_GROUP))).alias("parts")).checkpoint()
    small = parts.where("parts = 1").agg(F.coalesce(F.sum(F.col("items") + F.col("rows")), F.lit(0))).first()[0]
    part = lambda c: F.pmod(F.xxhash64(F.lit(1), c), "parts")
    at = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("near"), F.lit(-(-small // ITEMS_A_GROUP) or 1))).otherwise(F.xxhash64("near", part("a"), part("b")))
    return near.join(parts.select("near", "parts"), "near").select("a", "b", at.alias("at"))


def _similarities(met: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """Rows (a, b, similarity) of pairs (a, b, at), their sets given as rows (id, words, at)."""
    each = _each(lambda rows, items, n: (rows.column(0).to_pylist(), np.split(items, np.cumsum(n)[:-1])), size)

    def compare(pairs, sets):
        found = {k: v for ids, items in each(sets.to_batches()) for k, v in zip(ids, items, strict=True)}
        out = np.empty(pairs.num_rows)
        for k, (a, b) in enumerate(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)):
            x, y = found[a], found[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out[k] = shared / (len(x) + len(y) - shared)
        return pa.table({"a": pairs["a"], "b": pairs["b"], "similarity": out})

    kind = sets.schema["id"].dataType.simpleString()
    return met.groupBy("at").cogroup(sets.groupBy("at")).applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def similar_classes(df: DataFrame, key: str, sets: Column, threshold: float, run: int = 1) -> tuple[DataFrame, DataFrame]:
    """Members (id, first) of the classes of equal sets, `first` being their least key, and pairs (a, b, similarity) a < b of classes, by
    their first keys, whose sets have a Jaccard similarity of at least `threshold`. `sets` are arrays of strings, of which a row's set are
    the distinct runs of `run` elements, a shorter array being one run. Empty sets are similar to nothing.

    Two such sets share one of the first n - ceil(t n) + 1 items of each in any one order; so only these are moved and joined, and what is
    left of both sets after the shared item, and after all that their prefixes share, must allow the threshold. Items are 64 bits. The sets themselves are larger than the table, so
    they are neither written nor moved: `df` is read for the digests, the counts of items, the prefixes and once more for the rows that are
    in a pair, which alone are moved, each once for a group of near copies. (Write `df` first if it is costly.)
    """
    ensure_checkpoints(df.sparkSession)
    known = df.where(F.col(key).isNotNull())
    words = lambda rows, *more: rows.select(F.col(key).alias("id"), F.transform(sets, lambda x: F.xxhash64(x)).alias("words"), *more)
    same = ["x", "y", "n"]
    told = _digests(words(known), run).checkpoint()
    firsts = told.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("rows")).checkpoint()  # written, so that the join can split a class
    members = told.join(firsts, same).select("id", "first")
    copies = members.where("id != first").checkpoint()
    once = _matched(known, key, copies.select("id"), "left_anti")
    prefix = _prefixes(words(once), run, threshold).repartition("h")
    a, b = (prefix.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place")]) for s in "ab")
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    # what an intersection of `left` items more than the pair's earlier shared ones can reach; the earlier places bound those
    most = F.least(left + F.least("place_a", "place_b"), F.col("n_a"), F.col("n_b"))
    fits = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (most * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9)
    found = a.join(b, "h").where((F.col("id_a") < F.col("id_b")) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b")
    # what two sets share besides their prefixes' common items comes, in one of them, after its prefix, where ceil(t n) - 1 items are
    after = F.greatest(*[F.ceil(threshold * F.col(c) - F.lit(1e-9)) for c in ("n_a", "n_b")]) - 1
    enough = (F.col("c") + after) * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = found.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c")).where(enough).drop("c").checkpoint()
    met = _meeting(pairs).checkpoint()
    moved = met.select(F.explode(F.array("a", "b")).alias("id"), "at").distinct().checkpoint()
    paired = _matched(_matched(known, key, moved.select("id").distinct(), "left_semi"), key, moved, "inner")
    # the rows are moved as they were read, as hashes of their words are larger
    scored = _similarities(met, words(paired.repartition("__at"), F.col("__at").alias("at")), run)
    return copies.unionByName(firsts.where("rows > 1").select(F.col("first").alias("id"), "first")), scored.where(F.col("similarity") >= threshold).checkpoint()


def _matched(df: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose key is (not) among `ids`, with the latter's other columns; they stay where they are if those are few."""
    ids = ids.withColumnsRenamed({c: f"__{c}" for c in ids.columns})
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(key) == F.col("__id"), how).drop("__id")


def similar_pairs(df: DataFrame, key: str, sets: Column, threshold: float, run: int = 1) -> DataFrame:
    """All pairs a < b of keys, with their similarity, of what similar_classes() finds: a class of c equal sets has c (c - 1) / 2."""
    members, pairs = similar_classes(df, key, sets, threshold, run)
    side = lambda c: members.select(F.col("first").alias(c), F.col("id").alias(f"{c}_id"))
    each = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_id", "a").alias("x"), F.coalesce("b_id", "b").alias("y"), "similarity")
    across = each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    within = members.withColumnRenamed("id", "a").join(members.withColumnRenamed("id", "b"), "first").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def greedy_keep(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, kept, kept_by) when rows are taken in rank order and one goes if an earlier kept one is similar; kept_by is the first such.

    Rows are decided as soon as their earlier neighbours are: kept if all of those went, gone if one of them stays. Rounds are
    checkpointed; their number is the longest chain of undecided neighbours.
    """
    ensure_checkpoints(pairs.sparkSession)
    rank = ranks.select("id", "rank")
    ordered = pairs.join(rank.withColumnsRenamed({"id": "a", "rank": "ra"}), "a").join(rank.withColumnsRenamed({"id": "b", "rank": "rb"}), "b")
    edges = ordered.select(F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("first"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("id"), F.least("ra", "rb").alias("first_rank")).checkpoint()
    state = rank.select("id", F.lit(None).cast("boolean").alias("kept"))
    state = state.join(edges.select("id").distinct().withColumn("has", F.lit(True)), "id", "left").select("id", F.when(F.col("has").isNull(), F.lit(True)).alias("kept")).checkpoint()
    while not state.where("kept IS NULL").isEmpty():
        seen = edges.join(state.withColumnsRenamed({"id": "first", "kept": "first_kept"}), "first").groupBy("id").agg(F.bool_or("first_kept").alias("some"), F.bool_and(F.coalesce(~F.col("first_kept"), F.lit(False))).alias("all_gone"))
        state = state.join(seen, "id", "left").select("id", F.coalesce("kept", F.when(F.col("some"), F.lit(False)).when(F.col("all_gone"), F.lit(True))).alias("kept")).checkpoint()
    by = edges.join(state.where("kept").select(F.col("id").alias("first")), "first").groupBy("id").agg(F.min_by("first", "first_rank").alias("kept_by"))
    return state.join(by, "id", "left").select("id", "kept", F.when(~F.col("kept"), F.col("kept_by")).alias("kept_by"))


def greedy_keep_classes(members: DataFrame, pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """greedy_keep() where classes of equal rows (id, first) stand for the pairs within them, and pairs (a, b) are of classes.

    Rows of a class have the same neighbours, so its row of the least rank decides: if that is kept, it is the others' first kept one,
    and if it goes, they go by the same row.
    """
    ensure_checkpoints(pairs.sparkSession)
    best = members.join(ranks.select("id", "rank"), "id").groupBy("first").agg(F.min(F.struct("rank", "id"))["id"].alias("best")).checkpoint()
    others = members.join(best, "first").where("id != best").select("id", "best").checkpoint()
    side = lambda c: best.select(F.col("first").alias(c), F.col("best").alias(f"{c}_best"))
    named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_best", "a").alias("a"), F.coalesce("b_best", "b").alias("b"))
    kept = greedy_keep(named, ranks.join(others.select("id"), "id", "left_anti")).checkpoint()
    gone = others.join(kept.select(F.col("id").alias("best"), "kept_by"), "best").select("id", F.lit(False).alias("kept"), F.coalesce("kept_by", "best").alias("kept_by"))
    return kept.unionByName(gone)

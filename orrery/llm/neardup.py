"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and a check of the full shingle sets.

A document's set of word shingles becomes `m` registers K_i = floor(1 - log_b x_i), where x_i is the least of the exponentially
distributed hashes of its shingles, truncated to 0 .. q + 1. Registers of a union are the maxima of the registers (mergeable),
and equal registers become likelier with similarity. Bands of registers give candidates; the likelihood of the counts of
greater, smaller and equal registers estimates the similarity of a candidate pair; pairs that may reach the threshold are
checked on their full sets.

Components are exact over all candidates though no bucket's pairs are written out: documents with equal sets are one vertex;
each bucket is checked against a pivot, which joins almost all of a group of copies; and the sets of buckets that still hold
several components go through an exact prefix filter, in which pairs that are already connected need no check.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import add_columns, bound_batches, folders, settled, shared_table, tidy, type_of, without
from orrery.llm.graph import components


@dataclass(frozen=True)
class Params:
    """`percent`: least similarity, as 100 * intersection >= percent * union. bands * rows registers; a pair at 0.8 misses all 30
    bands of 5 with probability 7e-6."""

    shingle: int = 4
    percent: int = 80
    bands: int = 30
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    top: int = 65534
    #: A pair is dropped unchecked only if its likelihood at the threshold is e^-slack of the best.
    slack: float = 10.0

    @property
    def m(self) -> int:
        return self.bands * self.rows


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _draw(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Shingler:
    """64-bit hashes of the shingles of many texts at once: each word is hashed as a polynomial over its bytes' random numbers."""

    def __init__(self, width: int):
        self.width = width
        self.byte = _draw(256, 11)
        self.power = self._powers(1 << 16)
        self.place = _draw(max(width, 1), 23)
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        base = 0x5851F42D4C957F2D | 3
        with np.errstate(over="ignore"):
            up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, dtype=np.uint64))])
            down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64))])
        return up, down

    def words(self, data: bytes) -> np.ndarray:
        """A hash of each word of A-Z lowered UTF-8."""
        raw = np.frombuffer(data, dtype=np.uint8)
        if not len(raw):
            return np.zeros(0, dtype=np.uint64)
        if len(raw) >= len(self.power[0]):
            self.power = self._powers(2 * len(raw))
        gap = np.concatenate([[True], self.space[raw], [True]])
        start = np.flatnonzero(gap[:-2] & ~gap[1:-1])
        end = np.flatnonzero(gap[2:] & ~gap[1:-1]) + 1
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(self.byte[raw] * self.power[0][: len(raw)])])
            return _mix((total[end] - total[start]) * self.power[1][start] + (end - start).astype(np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct hashes of a text's shingles, in order; fewer words than the width make one, no words none."""
        w = self.words((text or "").encode("utf-8", "replace").lower())
        k = min(self.width, len(w))
        if not k:
            return w
        n = len(w) - k + 1
        with np.errstate(over="ignore"):
            h = np.full(n, k, dtype=np.uint64)
            for i in range(k):
                h += w[i : i + n] * self.place[i]
            return np.unique(_mix(h))


class Sketcher:
    """Registers and band keys of a set of hashes."""

    def __init__(self, p: Params):
        self.p = p
        self.a, self.c = _draw(p.m, 101)[:, None], _draw(p.m, 211)[:, None]
        self.band = _draw(p.bands * p.rows, 307).reshape(p.bands, p.rows)
        self.salt = _draw(p.bands, 401)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        p = self.p
        least = np.full(p.m, np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), 512):
                np.minimum(least, (self.a * hashes[None, i : i + 512] + self.c).min(axis=1), out=least)
        x = -np.log1p(-np.minimum((least.astype(np.float64) + 1) / 2.0**64, 1 - 2.0**-53)) / p.rate
        return np.clip(np.floor(1 - np.log(x) / np.log(p.base)), 0, p.top + 1).astype("<u2")

    def keys(self, registers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            k = (self.band * (_mix(registers.astype(np.uint64).reshape(self.band.shape) + np.uint64(1)))).sum(axis=1, dtype=np.uint64)
            return _mix(k ^ self.salt).view(np.int64)

    def low(self, registers: np.ndarray) -> np.ndarray:
        """The two low bits of each register, 30 registers a number."""
        two = np.zeros(-(-self.p.m // 30) * 30, dtype=np.int64)
        two[: self.p.m] = registers & 3
        return (two.reshape(-1, 30) << (2 * np.arange(30))).sum(axis=1)


def sketches(documents: DataFrame, p: Params, text: str = "text") -> DataFrame:
    """Add n_shingles, set_a and set_b (a 128-bit digest of the set; null if it is empty), registers, band keys and low bits."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("registers", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("low", T.ArrayType(T.LongType())),
    ]

    def make():
        shingler, sketcher = Shingler(p.shingle), Sketcher(p)

        def work(column: pa.Array) -> list[pa.Array]:
            n, a, b, r, k, low = [], [], [], [], [], []
            for t in (x.as_py() for x in column):
                s = shingler.shingles(t)
                n.append(len(s))
                if not len(s):
                    a.append(None), b.append(None), r.append(None), k.append(None), low.append(None)
                    continue
                with np.errstate(over="ignore"):
                    a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(_mix(s + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
                got = sketcher.registers(s)
                r.append(got.tobytes())
                k.append(sketcher.keys(got))
                low.append(sketcher.low(got))
            return [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(r, pa.binary()), pa.array(k, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))]

        return work

    return add_columns(documents, make, [text], fields)


def likelihood_keeps(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, p: Params) -> np.ndarray:
    """Which pairs of sketches may reach the threshold: the joint likelihood of the register counts, at the threshold against its
    maximum over a grid of similarities. Rows of x and y are registers."""
    up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = p.m - up - down
    u, v = (n_x / (n_x + n_y))[:, None], (n_y / (n_x + n_y))[:, None]
    most = np.minimum(u / v, v / u)  # no similarity is greater than the sizes' ratio
    grid = most * np.linspace(0.0, 1.0, 201)[None, :]
    grid = np.concatenate([grid, np.minimum(most, p.percent / 100.0)], axis=1)
    part = lambda s: -np.log1p(-np.clip(s, 1e-12, 1) * (p.base - 1) / p.base) / np.log(p.base)
    more, less = part(u - v * grid), part(v - u * grid)
    rest = np.maximum(1 - more - less, 1e-12)
    log = up[:, None] * np.log(more) + down[:, None] * np.log(less) + equal[:, None] * np.log(rest)
    best = grid[np.arange(len(grid)), log.argmax(axis=1)]
    return (best >= p.percent / 100.0 - 1e-9) | (log[:, -1] >= log.max(axis=1) - p.slack)


def low_bits_allow(x: str, y: str, p: Params) -> Column:
    """Whether two sets' low bits leave the threshold possible: at similarity s, s + (1 - s) / 4 of the registers agree in them, and
    pairs are ruled out at 5.5 standard deviations below that."""
    s = p.percent / 100.0
    agree = s + (1 - s) / 4
    least = p.m * agree - 5.5 * (p.m * agree * (1 - agree)) ** 0.5
    differ = F.lit(0)
    for i in range(-(-p.m // 30)):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        differ = differ + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x555555555555555)))
    return F.lit(p.m) - differ >= F.lit(least)


def _estimated(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose sketches allow the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    right = sets.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    # sizes alone rule out many: 100 * min >= percent * max
    joined = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb"))
    bound_batches(joined.sparkSession)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, p.m).astype(np.int32)
            size = lambda c: batch.column(c).to_numpy().astype(np.float64)
            keep = pa.array(likelihood_keeps(get("ra"), get("rb"), size("na"), size("nb"), p))
            yield batch.select(["a", "b"]).filter(keep)
        tidy()

    kind = type_of(pairs, "a")
    return joined.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, f"a {kind}, b {kind}")


def exact_set(text: str | None, width: int) -> set:
    """The distinct shingles themselves."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    return set(zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else ({tuple(w)} if w else set())


#: Pairs of one id that a task checks at a time: an id with more has its text sent to more tasks.
PAIRS_A_TASK = 2000


def _verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    The side that has more pairs is the head. Each pair takes the other side's text along; the head's text comes once for some
    thousand pairs, before them in order, so a task holds two sets at a time and no text is repeated for each of its pairs.
    """
    # written, so that the joins' sides are plain exchanges, of which a pivot with many pairs can be split
    count = shared_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "pair_counts")
    counted = pairs.join(count.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(count.withColumnsRenamed({"id": "b", "n": "nb"}), "b")
    swap = F.col("nb") > F.col("na")
    side = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    parts = F.ceil(F.greatest("na", "nb") / F.lit(PAIRS_A_TASK)).cast("int")
    told = counted.select(side("b", "a").alias("head"), side("a", "b").alias("id"), parts.alias("parts"))
    told = shared_table(told.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "heads")
    heads = told.select("head", "part").distinct().join(texts.withColumnRenamed("id", "head"), "head").select("head", "part", F.lit(None).cast(type_of(pairs, "a")).alias("id"), "text")
    tails = told.join(texts, "id").select("head", "part", "id", "text")
    dealt = heads.unionByName(tails).repartition("head", "part").sortWithinPartitions("head", "part", F.asc_nulls_first("id"))

    def run(batches):
        head, own = None, set()
        for batch in batches:
            keep = []
            for h, i, t in zip(*[batch.column(c).to_pylist() for c in ("head", "id", "text")], strict=True):
                if i is None:
                    head, own = h, exact_set(t, p.shingle)
                    keep.append(False)
                    continue
                other = exact_set(t, p.shingle)
                both = len(own & other)
                keep.append(h == head and bool(own) and 100 * both >= p.percent * (len(own) + len(other) - both))
            yield batch.select(["head", "id"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    bound_batches(pairs.sparkSession)
    kind = type_of(pairs, "a")
    linked = dealt.mapInArrow(run, f"head {kind}, id {kind}")
    return linked.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()


def _check(pairs: DataFrame, sets: DataFrame, documents: DataFrame, text: str, p: Params, name: str) -> DataFrame:
    """Candidate pairs (a < b) -> links, with a sketch filter and then full sets; only the texts in question are moved."""
    first = len(folders(pairs.sparkSession))
    may = shared_table(_estimated(pairs, sets, p), f"{name}_may")
    wanted = may.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = documents.select(F.col("doc_id").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    return settled(_verified(may, shared_table(texts, f"{name}_texts"), p), f"{name}_links", first)


def _labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.join(comp, "id", "left").select(*members.columns, F.coalesce("component", "id").alias("comp"))


def _members(every: DataFrame) -> DataFrame:
    """Rows (bucket, id, pivot) of the buckets of several ids.

    The pivot is the member that shares most buckets with most others: of a group of edited copies, the one they come from.
    """
    several = shared_table(every.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("bucket", "n"), "band_buckets")
    kept = shared_table(every.join(several, "bucket").select("bucket", "id", "n"), "band_kept")
    rank = kept.groupBy("id").agg(F.sum("n").alias("shared"))
    pivots = kept.join(rank, "id").groupBy("bucket").agg(F.min(F.struct(-F.col("shared"), F.col("id").alias("id")))["id"].alias("pivot"))
    # written, so that the join's sides are both plain exchanges, of which a hot bucket can be split
    pivots = shared_table(pivots, "band_pivots")
    return shared_table(kept.join(pivots, "bucket").select("bucket", "id", "pivot"), "band_members")


#: Bits of the least and the largest table of shingle frequencies: the largest has 2 MB.
COUNTER_BITS = (12, 18)


def _frequencies(texts: DataFrame, p: Params, bits: int) -> np.ndarray:
    """How often shingles occur, by the low bits of their hashes."""

    def run(batches):
        shingler = Shingler(p.shingle)
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for t in (x.as_py() for x in batch.column("text")):
                np.add.at(total, (shingler.shingles(t) & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(1 << bits, dtype=np.int64)
    counted = texts.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[counted["k"].to_numpy()] = counted["n"].to_numpy()
    return out


def _prefixes(texts: DataFrame, p: Params) -> DataFrame:
    """Rows (bucket, id, place, size) of an exact filter: two sets at the threshold share one of the first items of each.

    All sets are put in one order, the rarest shingles first by a table of counts, whose size follows the input up to a bound (beyond
    it shingles share counters, which makes the order less good but loses nothing); of a set of n, the first
    n - ceil(percent n / 100) + 1 are taken.
    """
    # a shingle has some six characters of text at least
    size = texts.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    bits = int(np.clip(np.ceil(np.log2(max(1, size / 6 * 2))), *COUNTER_BITS))
    counts = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, p, bits).astype(np.uint32 if size < 1 << 32 else np.int64))
    kind = type_of(texts, "id")

    def run(batches):
        shingler = Shingler(p.shingle)
        low = np.uint64((1 << bits) - 1)
        for batch in batches:
            for k, t in enumerate(batch.column("text").to_pylist()):
                s = shingler.shingles(t)
                n = len(s)
                first = n - -(-n * p.percent // 100) + 1
                order = np.lexsort((s, counts.value[(s & low).astype(np.int64)]))[:first]
                ids = batch.column("id").take(pa.array(np.full(len(order), k)))
                yield pa.RecordBatch.from_arrays([pa.array(s[order].view(np.int64)), ids, pa.array(np.arange(1, len(order) + 1)), pa.array(np.full(len(order), n))], names=["bucket", "id", "place", "size"])

    return texts.select("id", "text").mapInArrow(run, f"bucket long, id {kind}, place long, size long")


def _rest(ids: DataFrame, comp: DataFrame, sets: DataFrame, documents: DataFrame, text: str, p: Params) -> DataFrame:
    """Links between the components of some sets, by the prefix filter.

    In each bucket only members outside its largest component are compared with others. A pair must fit by sizes, by its place (what
    is left of both sets after a shared item bounds the intersection) and by the sketches' low bits before it becomes a row.
    """
    first = len(folders(ids.sparkSession))
    texts = shared_table(documents.select(F.col("doc_id").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi"), "rest_texts")
    every = shared_table(_prefixes(texts, p), "rest_prefixes")
    # small tables are written before they are joined with a hot bucket's rows: an aggregate in the join's stage keeps it whole
    several = shared_table(every.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("bucket"), "rest_buckets")
    own = _labelled(every.join(several, "bucket"), comp)
    own = shared_table(own.join(sets.select("id", "low"), "id"), "rest_members")
    sizes = own.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("k")).where("k > 1").select("bucket", "main")
    main = shared_table(main, "rest_main")
    marked = own.join(main, "bucket").withColumn("outside", F.col("comp") != F.col("main"))
    side = lambda df, k: df.select("bucket", *[F.col(c).alias(f"{c}{k}") for c in ("id", "comp", "place", "size", "low", "outside")])
    c = F.col
    apart = (c("compa") != c("compb")) & (~c("outsideb") | (c("ida") < c("idb")))
    left = 1 + F.least(c("sizea") - c("placea"), c("sizeb") - c("placeb"))
    fits = (100 * F.least("sizea", "sizeb") >= p.percent * F.greatest("sizea", "sizeb")) & ((100 + p.percent) * left >= p.percent * (c("sizea") + c("sizeb")))
    pairs = side(marked.where("outside"), "a").join(side(marked, "b"), "bucket").where(apart & fits & low_bits_allow("lowa", "lowb", p))
    pairs = pairs.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    return settled(_check(pairs, sets, documents, text, p, "rest"), "rest", first)


def near_duplicates(documents: DataFrame, text: str = "text", p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row for each row of `documents`: doc_id (of any type that can be compared), n_shingles, component_id and kept.

    component_id is the smallest doc_id that the document is linked with, directly or through others, itself included; kept says
    whether that is its own. Texts without words (null, empty) are linked with nothing. Rows that share a doc_id are one vertex;
    rows whose doc_id is null are linked with nothing, have no component_id and are kept. An empty table gives no rows; other
    columns are not looked at.
    """
    source = documents.select("doc_id", text)
    sketch = shared_table(without(sketches(source, p, text), text), "sketches")
    known = sketch.where(F.col("doc_id").isNotNull() & F.col("set_a").isNotNull())
    sets = shared_table(known.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers"), F.first("bands").alias("bands"), F.first("low").alias("low")), "sets")
    every = sets.select("id", F.explode(F.array_distinct("bands")).alias("bucket"))
    members = _members(every)
    stars = members.where("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = _check(stars, sets, source, text, p, "star")
    comp = components(links)
    own = _labelled(members, comp)
    open_ = shared_table(own.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket"), "open_buckets")
    ids = shared_table(members.join(open_, "bucket").select("id").distinct(), "rest_ids")
    links = links.unionByName(_rest(ids, comp, sets, source, text, p))
    # a document's links: to its set's first document, and among the sets' first documents; a doc_id with several sets joins them
    firsts = sets.select("set_a", "set_b", "n_shingles", F.col("id").alias("first"))
    rows = sketch.join(firsts, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", "first")
    others = rows.where("doc_id != first")
    repeated = others.groupBy("doc_id").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo != hi").select("doc_id", "lo")
    tied = others.join(repeated, "doc_id").where("first != lo").select(F.col("lo").alias("a"), F.col("first").alias("b"))
    tied = tied.unionByName(rows.where("doc_id != first").join(sets.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    comp = components(links.unionByName(tied).distinct())
    found = rows.join(comp.withColumnRenamed("id", "first"), "first", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

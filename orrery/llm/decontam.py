"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other values keeps its template. Windows of template
tokens are hash-joined with the benchmark's, and a match must also be consistent: one value of the benchmark item stands for one
value of the document wherever it occurs in the matched windows of one occurrence.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import bound_batches, shared_table, tidy, type_of

#: Units of measure and money, lower-cased (fixed values).
UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg ton tons oz lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh hz khz mhz ghz w kw kwh v volt volts "
    "amp amps j joule joules cal kcal pa kpa bar kb mb gb tb percent % $ € £ usd eur gbp dollar dollars euro euros cent cents".split()
)
NUMBER, NAME, UNIT = 1, 2, 3
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w$€£%]+$")


@dataclass(frozen=True)
class Params:
    """Windows of `window` tokens; a document holds an item if windows that cover `least` of the item's windows match (all of the
    only window of a shorter item), and at least `agree` of the item's slot values keep one value."""

    window: int = 8
    least: float = 0.4
    agree: float = 0.8
    sparse: int = 8
    filter_bits: int = 29


class _Places(dict):
    """The place of each known word; a new word is added."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, word: str) -> int:
        return self.add(word)


class Canonicaliser:
    """Template hashes and slot values of texts.

    Words' forms stand in arrays, and a word's place there is kept from text to text: up to `kept` words, or as many as one text has.
    """

    def __init__(self, window: int, kept: int = 150_000):
        self.window, self.kept = window, kept
        self.place = (np.arange(1, window + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.known: dict[str, int] = _Places(self._add)
        #: Of each known word: template hash at the start of a sentence and elsewhere, the kind of slot elsewhere, if it ends a sentence.
        self.opening, self.inner = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64)
        self.kind, self.ends = np.zeros(1024, dtype=np.int8), np.zeros(1024, dtype=bool)

    def _add(self, word: str) -> int:
        """The place of a new word's form."""
        at = len(self.known)
        if at == len(self.kind):
            self.opening, self.inner, self.kind, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.opening, self.inner, self.kind, self.ends))
        bare = _EDGE.sub("", word)
        low = bare.lower()
        first, kind = (xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")), 0) if bare else (0, 0)
        if bare and _NUMBER.fullmatch(bare):
            first = kind = NUMBER
        elif low in UNITS and len(low) > 1:
            first = kind = UNIT
        elif bare and bare[0].isupper() and not bare.isupper():
            kind = NAME
        self.opening[at], self.inner[at], self.kind[at], self.ends[at] = first, kind or first, kind, word[-1:] in ".!?" or word[-2:-1] in ".!?"
        self.known[word] = at
        return at

    def windows(self, text: str | None, narrow: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[str], dict[int, np.ndarray]]:
        """Hash of each window of template tokens by place, the slot kind of each token, the tokens, and by width the hashes of the
        windows of the `narrow` widths that are no wider than the text.

        A capitalised word is a name unless it begins a sentence or a line. Words of punctuation alone are no tokens. A text of
        fewer tokens than a window is one window. The first token of a narrow window is taken as the start of a sentence, as it is
        in an item.
        """
        if len(self.known) > self.kept:
            self.known.clear()
        words, counts = [], []
        for line in (text or "").split("\n"):
            own = line.split()
            words += own
            counts.append(len(own))
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        opening = self.opening[at]
        lines = np.repeat(np.arange(len(counts)), counts)
        if not opening.all():  # 0: a word of punctuation alone
            real = np.flatnonzero(opening)
            at, opening, lines, words = at[real], opening[real], lines[real], [words[i] for i in real]
        n = len(at)
        if not n:
            return opening, self.kind[at], words, {}
        start = np.ones(n, dtype=bool)
        start[1:] = self.ends[at[:-1]] | (lines[1:] != lines[:-1])
        h, k = np.where(start, opening, self.inner[at]), self.kind[at]
        k = np.where(start & (k == NAME), np.int8(0), k)
        return self._hashes(h, h, min(n, self.window)), k, words, {w: self._hashes(h, opening, w) for w in narrow if w <= n}

    def _hashes(self, h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the windows of a width, with the first token of each as in `first`."""
        n = len(h)
        with np.errstate(over="ignore"):
            out = np.full(n - width + 1, width, dtype=np.uint64)
            for i in range(width):
                x = (h if i else first)[i : n - width + 1 + i]
                out += ((x ^ (x >> np.uint64(31))) * self.place[i]) ^ (x << np.uint64(7))
            out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(29)
        return out

    def slots(self, at: int, kinds: np.ndarray, words: list[str]) -> list[str]:
        """The slot values of the window at a place, in order."""
        return [_EDGE.sub("", words[i]).lower() for i in range(at, min(len(words), at + self.window)) if kinds[i]]

    def narrow_slots(self, at: int, width: int, kinds: np.ndarray, words: list[str]) -> list[str]:
        """The slot values of a narrow window, whose first token is no name."""
        return [_EDGE.sub("", words[i]).lower() for i in range(at, at + width) if kinds[i] and (i > at or kinds[i] != NAME)]


_WINDOW_TYPE = "hash long, at int, slots array<string>, width int, wordless boolean"


def benchmark_windows(benchmark: DataFrame, p: Params, item: str = "item_id", text: str = "text") -> DataFrame:
    """All windows of the items: item, n_windows, hash, at, slots, width, and if no token of it is a word of the template."""

    def run(batches):
        c = Canonicaliser(p.window)
        for batch in batches:
            schema = pa.schema([("item_id", batch.schema.field("item").type), ("n_windows", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.string())), ("width", pa.int32()), ("wordless", pa.bool_())])
            for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, kinds, words, _ = c.windows(t)
                width = min(len(words), p.window)
                rows = [{"item_id": i, "n_windows": len(h), "hash": int(x.view(np.int64)), "at": k, "slots": c.slots(k, kinds, words), "width": width, "wordless": bool(kinds[k : k + width].all())} for k, x in enumerate(h)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    source = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"item_id {type_of(benchmark, item)}, n_windows int, {_WINDOW_TYPE}")


def _filter(windows: DataFrame, bits: int) -> bytes:
    """A bitmap of 2^bits bits in which the low bits of every benchmark window's hash are set."""
    places = windows.select(F.pmod("hash", F.lit(1 << bits)).alias("k")).distinct()
    packed = places.groupBy(F.expr("k div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(k % 8 AS INT))")).alias("v"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for batch in packed.select(F.col("byte").cast("int"), F.col("v").cast("int")).toPandas().itertuples(index=False):
        out[batch[0]] = batch[1]
    return out.tobytes()


def filter_bits(windows: DataFrame, p: Params) -> int:
    """Bits of the bitmap's size for these windows: `sparse` places a window, so that one window of 2^`sparse` of other texts passes,
    from 2^16 up to 2^`filter_bits` places (of the whole bitmap: 64 MB); beyond that, more windows pass and the join drops them."""
    n = windows.select(F.approx_count_distinct("hash")).first()[0]
    return min(p.filter_bits, max(16, math.ceil(math.log2(max(n, 1))) + p.sparse))


def matching_windows(documents: DataFrame, windows: DataFrame, p: Params, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of the whole texts that the benchmark has too: doc key, digest of the text, place in it, item, n_windows, at (in the
    item), slots of both sides."""
    spark = documents.sparkSession
    narrow = tuple(sorted(r.width for r in windows.where(F.col("width") < p.window).select("width").distinct().collect()))
    bits = filter_bits(windows, p)
    bitmap = spark.sparkContext.broadcast(_filter(windows, bits))
    mask = (1 << bits) - 1
    source = documents.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    bound_batches(spark)

    def run(batches):
        c = Canonicaliser(p.window)
        known = np.frombuffer(bitmap.value, dtype=np.uint8)

        def hits(h):
            low = h & np.uint64(mask)
            return np.flatnonzero((known[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1).tolist()

        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, kinds, words, short = c.windows(t, narrow)
                found = [(h[k], k, c.slots(k, kinds, words)) for k in hits(h)] if len(words) >= p.window else []
                found += [(x[k], k, c.narrow_slots(k, w, kinds, words)) for w, x in short.items() for k in hits(x)]
                if found:
                    row = xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63)
                    rows += [{"doc": i, "row": row, "hash": int(x.view(np.int64)), "place": k, "slots": v} for x, k, v in found]
            schema = pa.schema([("doc", batch.schema.field("doc").type), ("row", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("slots", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        tidy()

    found = source.mapInArrow(run, f"doc {type_of(documents, doc)}, row long, hash long, place int, slots array<string>")
    theirs = windows.select("hash", "item_id", "n_windows", "at", F.col("slots").alias("item_slots"), ((F.col("width") < p.window) & F.col("wordless")).alias("own_only"))
    return found.join(theirs, "hash").where((F.size("slots") == F.size("item_slots")) & (~F.col("own_only") | (F.col("slots") == F.col("item_slots")))).select("doc", "row", "place", "item_id", "n_windows", "at", "slots", "item_slots")


class Evidence:
    """Matched windows of an item, and the document's values of each of its slot values."""

    def __init__(self):
        self.at: set[int] = set()
        self.values: dict[str, str | None] = {}
        self.own: set[str] = set()
        self.consistent = 0

    def add(self, at: int, slots: list[str], item_slots: list[str]) -> None:
        self.at.add(at)
        values = self.values
        for i, d in zip(item_slots, slots, strict=True):
            if i == d:
                self.own.add(i)
            if i not in values:
                values[i] = d
                self.consistent += 1
            elif values[i] is not None and values[i] != d:
                values[i] = None
                self.consistent -= 1

    def verdict(self, n_windows: int, p: Params) -> tuple[bool, int, int, int] | None:
        """exact, n_matched, n_consistent, n_slots if this is enough."""
        n = len(self.values)
        if len(self.at) < max(1, math.ceil(p.least * n_windows)) or self.consistent < p.agree * n:
            return None
        return self.consistent == n == len(self.own), len(self.at), self.consistent, n


def best_occurrence(hits: list[tuple[int, int, list[str], list[str]]], n_windows: int, p: Params) -> tuple[bool, int, int, int] | None:
    """The best verdict of the places of one text where the item may stand; hits are place, at, slots, item_slots.

    Windows of one occurrence have equal place - at, but for words put in or left out. So from each such offset, the nearest others
    are taken in turn, up to half of the item away, for windows of the item that are still without a match.
    """
    lines = defaultdict(list)
    for place, at, slots, item_slots in hits:
        lines[place - at].append((at, slots, item_slots))
    offsets = sorted(lines)
    reach, needed = max(1, (n_windows + p.window - 1) // 2), max(1, math.ceil(p.least * n_windows))
    best, low, high, within = None, 0, 0, 0
    for k, base in enumerate(offsets):
        while high < len(offsets) and offsets[high] <= base + reach:
            within += len(lines[offsets[high]])
            high += 1
        while offsets[low] < base - reach:
            within -= len(lines[offsets[low]])
            low += 1
        if within < needed:
            continue
        e = Evidence()
        for o in sorted(offsets[low:high], key=lambda x: abs(x - base)) if high - low > 1 else offsets[k : k + 1]:
            new = [x for x in lines[o] if x[0] not in e.at]
            if new:
                for x in new:
                    e.add(*x)
                found = e.verdict(n_windows, p)
                if found and (best is None or found > best):
                    best = found
        if best and best[0] and best[1] == n_windows:
            break
    return best


def _judge(p: Params):
    """From hits sorted by doc, item_id, row, place and at to the pairs that hold."""

    def run(batches):
        key, row, last, n_windows, hits, whole, best, out = None, None, None, 0, [], Evidence(), None, []

        def close_row():
            found = best_occurrence(hits, n_windows, p)
            hits.clear()
            return max((x for x in (best, found) if x), default=None)

        def close_pair():
            found = close_row() or whole.verdict(n_windows, p)
            if found:
                exact, n_matched, n_consistent, n_slots = found
                out.append({"doc_id": key[0], "item_id": key[1], "n_matched": n_matched, "n_windows": n_windows, "n_slots": n_slots, "n_consistent": n_consistent, "exact": exact})

        schema = None

        def told():
            got = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return got

        types = lambda batch: pa.schema([("doc_id", batch.schema.field("doc").type), ("item_id", batch.schema.field("item_id").type), ("n_matched", pa.int64()), ("n_windows", pa.int32()), ("n_slots", pa.int64()), ("n_consistent", pa.int64()), ("exact", pa.bool_())])
        for batch in batches:
            schema = types(batch)
            columns = [batch.column(c).to_pylist() for c in ("doc", "item_id", "row", "place", "at", "n_windows", "slots", "item_slots")]
            for d, i, r, place, at, n, slots, item_slots in zip(*columns, strict=True):
                if key != (d, i):
                    if key is not None:
                        close_pair()
                    key, row, last, n_windows, whole, best = (d, i), r, None, n, Evidence(), None
                elif r != row:
                    best, row, last = close_row(), r, None
                n_windows = max(n_windows, n)
                if (place, at, slots, item_slots) != last:
                    last = place, at, slots, item_slots
                    hits.append((place, at, slots, item_slots))
                    whole.add(at, slots, item_slots)
            if out:
                yield told()
        if key is not None:
            close_pair()
            yield told()

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, p: Params = Params(), doc: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Pairs of a document and a benchmark item that it holds, in its own words or with other numbers, names or units.

    Coverage and slots are those of one occurrence in one text: a document may hold the item several times, with several values. If
    none is enough, all matched windows of the document are judged together (an item in distant pieces).

    Columns: doc_id, item_id, n_matched (distinct windows of the item), n_windows, n_slots and n_consistent (of the item's slot
    values in these windows, and how many stand for one value of the document), exact (all slots have the item's own values), all of
    the best occurrence. Null and empty texts and items hold nothing; documents with equal doc_id count as one, and a null doc_id is
    reported as null. Ids may be of any type that can be compared. Empty tables give no rows, very long texts are read whole, other
    columns are not looked at. Items of fewer tokens than a window are found as a whole, anywhere in a text; one
    without any word, of numbers, names and units alone, only with its own values, as its template says nothing.
    """
    windows = shared_table(benchmark_windows(benchmark, p), "benchmark_windows")
    hits = matching_windows(documents, windows, p, doc, text)
    dealt = hits.repartition("doc", "item_id").sortWithinPartitions("doc", "item_id", "row", "place", "at")
    return dealt.mapInArrow(_judge(p), f"doc_id {type_of(documents, doc)}, item_id {type_of(benchmark, 'item_id')}, n_matched long, n_windows int, n_slots long, n_consistent long, exact boolean")

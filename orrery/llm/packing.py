"""Best-fit packing of documents into sequences of a fixed number of tokens.

How many pieces there are of each length is all that the packing depends on, and there are no more lengths than a sequence has tokens.
Over this histogram, a linear program has a variable for each configuration (a multiset of lengths that fits in a sequence) and asks for
the fewest sequences that hold all pieces. It is solved by multiplicative weights: each length has a weight, a knapsack by dynamic
programming finds the configurations that are worth most, these are used and their lengths' weights fall. Whole parts of the solution
are taken, what is left is solved again, and the last pieces, fewer than a bound that doesn't depend on the table's size, go best-fit.
The pieces, numbered within their length by a distributed sort, then find their places in the plan by searches in its tables.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from orrery.llm.bpe import byte_symbols
from orrery.llm.common import Kept, add_columns, bound_batches, placed, shared_table, tidy

#: A configuration: lengths and how often it has each, longest first.
Configuration = tuple[tuple[int, int], ...]


# --- the plan, from a histogram of lengths


@dataclass
class Knapsack:
    """The most value in each capacity up to the largest, any number of each length, and the length that gets it (0: none)."""

    best: np.ndarray
    pick: np.ndarray

    @classmethod
    def solve(cls, value: np.ndarray) -> Knapsack:
        """`value` has a length's at its place; place 0 isn't a length."""
        top = len(value) - 1
        best, pick = np.zeros(top + 1), np.zeros(top + 1, dtype=np.int64)
        lengths = np.flatnonzero(value)
        for c in range(1, top + 1):
            fit = lengths[: np.searchsorted(lengths, c, "right")]
            best[c], pick[c] = best[c - 1], -1
            if len(fit):
                worth = value[fit] + best[c - fit]
                k = len(worth) - 1 - int(worth[::-1].argmax())  # of equals the longest
                if worth[k] > best[c]:
                    best[c], pick[c] = worth[k], fit[k]
        return cls(best, pick)

    def fill(self, capacity: int, most: np.ndarray) -> Counter:
        """The lengths that are worth most in a capacity, none more often than `most` says."""
        out: Counter = Counter()
        while capacity > 0:
            x = int(self.pick[capacity])
            if x > 0 and out[x] < most[x]:
                out[x] += 1
                capacity -= x
            else:
                capacity -= 1
        return out


def fractional(counts: np.ndarray, step: float = 1.0, power: float = 1.02, rounds: int = 48, near: float = 0.003, rate: float = 0.1) -> tuple[dict[Configuration, float], float]:
    """A solution of the program over `counts` (pieces by length) by multiplicative weights, and a lower bound of any packing.

    Weights are prices of lengths: at first their sizes to a power, at which full sequences are worth almost the same, and those with long
    pieces a little more, so that short ones are left for them. Each round solves the knapsack; of
    each length that lacks cover, the best configuration that has it is used if it is worth almost (1 - near) what the best of all is,
    for the share `step` of what its lengths lack. Prices rise with what a length lacks and fall with what it has. What no round finds
    worth using stays uncovered. The bound is that of the prices as a dual solution: no sequence is worth more than the best knapsack.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    used: Counter = Counter()
    lack = counts.astype(float)
    price = np.where(counts > 0, (np.arange(capacity + 1) / capacity) ** power, 0.0)
    bound = 0.0
    for _ in range(rounds):
        knapsack = Knapsack.solve(price)
        bound = max(bound, float((counts * price).sum() / knapsack.best[capacity]))
        worth = price[lengths] + knapsack.best[capacity - lengths]
        for x in lengths[worth >= (1 - near) * knapsack.best[capacity]][::-1].tolist():  # the longest first: they have the fewest partners
            if lack[x] < 1e-9:
                continue
            inside = knapsack.fill(capacity - x, counts)
            inside[x] += 1
            times = step * min(lack[y] / m for y, m in inside.items())
            if times > 1e-9:
                used[tuple(sorted(inside.items(), reverse=True))] += times
                for y, m in inside.items():
                    lack[y] -= times * m
        share = lack[lengths] / counts[lengths]
        price[lengths] *= np.exp(rate * (share - lack.sum() / counts.sum()))
        price /= price.max()
    return dict(used), bound


def best_fit(counts: np.ndarray) -> Counter:
    """Configurations by best-fit decreasing: each piece goes where the least room is left for it.

    Sequences of the same content are handled together: of all that have the same least room for a length, each takes as many pieces of
    it as fit before the next does. So the work depends on the number of lengths, not of pieces.
    """
    capacity = len(counts) - 1
    room: list[int] = []
    open_: dict[int, Counter] = {}
    done: Counter = Counter()

    def put(left: int, content: Configuration, n: int) -> None:
        if not left:
            done[content] += n
            return
        if left not in open_:
            open_[left] = Counter()
            insort(room, left)
        open_[left][content] += n

    for x in range(capacity, 0, -1):
        n = int(counts[x])
        while n > 0:
            i = bisect_left(room, x)
            if i == len(room):
                left, content, there = capacity, (), n
            else:
                left = room[i]
                content, there = open_[left].popitem()
                if not open_[left]:
                    del open_[left], room[i]
            each = left // x
            full = min(there, n // each)
            if full:
                put(left - x * each, (*content, (x, each)), full)
                n -= full * each
                there -= full
            if n and n < each and there:
                put(left - x * n, (*content, (x, n)), 1)
                n, there = 0, there - 1
            if content and there:
                put(left, content, there)
    for contents in open_.values():
        done.update(contents)
    return done


@dataclass
class Plan:
    """Configurations and how many sequences have each; a lower bound of the number of sequences; pieces that went best-fit at the end."""

    sequences: list[tuple[Configuration, int]]
    bound: float
    rest: int

    @property
    def n_sequences(self) -> int:
        return sum(n for _, n in self.sequences)


#: Steps and powers of the first prices with which the program is solved.
SCHEDULES = ((1.0, 1.02), (1.0, 1.1), (0.5, 1.02))


def plan(counts: np.ndarray, schedules: tuple[tuple[float, float], ...] = SCHEDULES, passes: int = 12) -> Plan:
    """Pack pieces of lengths 1 to len(counts) - 1, of which counts[x] have length x: the best plan of those with each schedule.

    Whole parts of a fractional solution are taken, and what they leave is solved anew, until a pass takes less than a tenth; the rest
    goes best-fit. A pass leaves less than one sequence of each configuration that it used, of which there are at most rounds times
    lengths, and what it left uncovered: lengths whose partners are used up.
    """
    return min((_plan(counts, step, power, passes) for step, power in schedules), key=lambda p: p.n_sequences)


def _plan(counts: np.ndarray, step: float, power: float, passes: int) -> Plan:
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bound = float((left * np.arange(capacity + 1)).sum() / capacity)
    taken: Counter = Counter()
    whole = int(left[capacity])  # a piece that fills a sequence has its own
    if whole:
        taken[((capacity, 1),)] = whole
        left[capacity] = 0
    for k in range(passes):
        total = int(left.sum())
        if not total:
            break
        solution, least = fractional(left, step, power)
        if k == 0:
            bound = max(bound, whole + least)
        for config, times in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
            n = min(int(times + 1e-6), *[int(left[x]) // m for x, m in config])
            if n > 0:
                taken[config] += n
                for x, m in config:
                    left[x] -= n * m
        if left.sum() > 0.9 * total:
            break
    rest = int(left.sum())
    taken.update(best_fit(left))
    return Plan(sorted(taken.items(), reverse=True), bound, rest)


def _tables(p: Plan, capacity: int) -> dict[str, np.ndarray]:
    """For each length, in the order of its pieces' numbers, which sequences they go to: starts by length, and for each run the first
    number, the first sequence, pieces in a sequence, and the place of the first in it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: Counter = Counter()
    first = 0
    for config, n in p.sequences:
        place = 0
        for x, m in config:
            runs.setdefault(x, []).append((given[x], first, m, place))
            given[x] += n * m
            place += x * m
        first += n
    begin, rows = np.zeros(capacity + 2, dtype=np.int64), []
    for x in range(1, capacity + 1):
        rows += runs.get(x, [])
        begin[x + 1] = len(rows)
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"begin": begin, "number": table[:, 0].copy(), "first": table[:, 1].copy(), "each": table[:, 2].copy(), "place": table[:, 3].copy()}


def look_up(tables: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place in it of pieces, by their length and number within it."""
    sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
    for x in np.unique(length):
        at = length == x
        lo, hi = tables["begin"][x], tables["begin"][x + 1]
        k = lo + np.searchsorted(tables["number"][lo:hi], number[at], "right") - 1
        within = number[at] - tables["number"][k]
        sequence[at] = tables["first"][k] + within // tables["each"][k]
        offset[at] = tables["place"][k] + within % tables["each"][k] * x
    return sequence, offset


# --- on Spark


def histogram(pieces: DataFrame, capacity: int, length: str = "length") -> np.ndarray:
    """How many pieces have each length; as many rows as a sequence has tokens come to the driver at most."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in pieces.groupBy(length).agg(F.count("*").alias("n")).collect():
        if x is None or not 0 < x <= capacity:
            raise ValueError(f"pieces must have 1 to {capacity} tokens, not {x}")
        counts[x] = n
    return counts


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Add sequence_id and offset: the pieces' places in as few sequences of `capacity` tokens as the plan finds, gapless from 0.

    Pieces of one length are interchangeable: they are numbered by a sort in ranges, so that a length that a third of them have is dealt
    to as many tasks as its size asks for, and each finds its place by a search in the plan's tables, whose size is bounded by the
    capacity and not by the pieces. Equal pieces are packed apart; an empty table gives no rows. Columns of these names are replaced.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = shared_table(pieces.select(*[F.col(f"`{c}`") for c in own], F.monotonically_increasing_id().alias("__row")), "pieces")
    tables = _tables(plan(histogram(rows, capacity, length)), capacity)
    shared = spark.sparkContext.broadcast(tables)  # a row for each length of a configuration

    def make() -> Callable[..., list[pa.Array]]:
        def work(lengths: pa.Array, numbers: pa.Array) -> list[pa.Array]:
            return [pa.array(x) for x in look_up(shared.value, lengths.to_numpy(zero_copy_only=False).astype(np.int64), numbers.to_numpy(zero_copy_only=False))]

        return work

    numbered = placed(rows, [length], ["__row"]).withColumnRenamed("pos", "__pos")
    return add_columns(numbered, make, [length, "__pos"], [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]).select(*[F.col(f"`{c}`") for c in own], "sequence_id", "offset")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """Rows (sequence_id, tokens, ids, doc_ids): the sequences with their tokens, the pieces' in the order of their places. A sequence
    has at most its capacity's tokens, so no group is larger than that."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids"), "doc_id", "piece", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("tokens"), F.aggregate("p", F.lit(b""), lambda b, x: F.concat(b, x["ids"])).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("parts"))


# --- tokens

#: Words kept with their ids in each Python worker (some 200 bytes each), and characters of a text that are encoded at a time.
CACHE_WORDS, SLAB = 150_000, 1 << 16
#: A space before anything but white space: there a byte-level tokenizer's pattern starts a new token.
_CUT = re.compile(r" (?=\S)")
#: Characters beyond the Latin blocks, whose classes may differ between versions of Unicode.
_FAR = re.compile("[^\0-\u024f]")
#: The pattern of byte-level tokenizers (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts by a tokenizer of the library, as little-endian unsigned 32-bit integers.

    The pattern of a byte-level tokenizer starts a new token at each space that something other than white space follows, so texts are
    cut there. Special tokens are taken out first, as the library does. Where merges are in the order of the ids that they make, slabs of
    Latin characters are encoded by tiktoken with the same vocabulary, in a quarter of the time; in all other slabs, words go to the
    library, once while they are remembered. Whole texts do if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, kind, model = spec["added_tokens"], spec["pre_tokenizer"] or {}, spec["model"]
        plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added) and not spec["normalizer"]
        self.by_words = plain and kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]
        self.specials = regex.compile("(" + "|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"]))) + ")") if added else None
        self.latin = self._latin(model, {a["content"] for a in added}) if self.by_words and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") else None
        self.words = Kept(lambda word: self.ids(" " + word), CACHE_WORDS)

    @staticmethod
    def _latin(model: dict, specials: set[str]) -> tiktoken.CoreBPE | None:
        """The same merges for tiktoken, if they are in the order of the ids that they make."""
        ids = model["vocab"]
        made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or any(a >= b for a, b in pairwise(made)):
            return None
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in ids.items() if t not in specials}
        return tiktoken.Encoding("latin", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def ids(self, text: str) -> bytes:
        """The ids of a text by the library."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _slab(self, text: str) -> bytes:
        if self.latin is not None and (text.isascii() or not _FAR.search(text)):
            return array("I", self.latin.encode_ordinary(text)).tobytes()
        first, *words = _CUT.split(text)
        return b"".join([self.ids(first) if first else b"", *map(self.words.__getitem__, words)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.by_words:
            return self.ids(text)
        out = []
        parts = self.specials.split(text) if self.specials and self.specials.search(text) else [text]  # specials at odd places
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.ids(part))
                continue
            at = 0
            while at < len(part):
                cut = _CUT.search(part, at + SLAB)
                end = cut.start() if cut else len(part)
                out.append(self._slab(part[at:end]))
                at = end
        return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(documents: DataFrame, tokenizer: str, end: int, capacity: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids) of all documents: their ids and the id `end` after them, cut into pieces of `capacity`
    tokens if there are more; only the first piece may be shorter. `ids` has 4 bytes a token.

    Null and empty texts are one piece of the end mark alone. Texts are encoded whole, however long they are; repeated rows alike. An
    empty table gives no rows. `tokenizer` is a file that the executors have too.
    """
    bound_batches(documents.sparkSession)
    schema = T.StructType([T.StructField("doc_id", documents.select(F.col(f"`{doc}`")).schema[0].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    mark = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, ids = [], [], [], [], []
            for i, text_ in enumerate(batch.column(1)):
                packed = encoder.encode(text_.as_py() or "") + mark
                n = len(packed) // 4
                at, to = 0, (n - 1) % capacity + 1
                k = 0
                while at < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    ids.append(packed[4 * at : 4 * to])
                    at, to, k = to, to + capacity, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)
        tidy()

    return documents.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)

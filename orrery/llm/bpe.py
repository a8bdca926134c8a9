"""Byte-pair encoding and decoding as streaming transducers of bounded memory.

Encoding reads symbols from left to right. A merge can only be undone by text that follows if a merge of higher priority takes
the end of its right part; the longest chain of such merges bounds how far ahead the encoder must read. Tokens that end that
far behind the last symbol read are stable and leave at once, so the buffer never exceeds a constant, however long a word is.
Decoding feeds the tokens' bytes to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import json
import re
import string
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields
from functools import cached_property, lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from orrery.llm.common import Kept, add_columns

#: Chunks and words kept with their tokens in each Python worker (some 200 bytes each).
CACHE_WORDS = 150_000
#: Characters of a text that are encoded at a time (up to the next space), and tokens that are decoded at a time.
SLAB, TOKENS = 1 << 16, 4096
#: Spaces to str.split() that are no white space to the pattern.
_NO_SPACES = re.compile("[\x1c-\x1f]")
#: Stand-ins of a character for matching alone, by its class: letter, number, other.
_STAND_INS = {"L": "é", "N": "½", "": "†"}


@lru_cache(maxsize=1)
def unicode_notes() -> tuple[dict[int, str], dict[int, str], str]:
    """Where this Python's tables of Unicode and the library's differ: the stand-in of a character whose class differs, the lower
    case of a character that only the library lowers, and the marks that the library doesn't put in order with others.

    Class and lower case can only differ for characters that Python's table doesn't have; these and the marks are asked of the
    library, once in the driver.
    """
    unknown = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"]
    lowers = normalizers.Lowercase()
    lower = {}
    for i in range(0, len(unknown), 4096):
        part = "".join(unknown[i : i + 4096])
        if lowers.normalize_str(part) != part:
            lower |= {ord(c): x for c in part if (x := lowers.normalize_str(c)) != c}
    ours = {c: "L" for c in regex.findall(r"\p{L}", "".join(unknown))} | {c: "N" for c in regex.findall(r"\p{N}", "".join(unknown))}
    theirs = {}
    for kind in "LN":
        split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True)
        for i in range(0, len(unknown), 4096):
            theirs |= {c: kind for x, _ in split.pre_tokenize_str("".join(unknown[i : i + 4096])) for c in x}
    nfc, still = normalizers.NFC(), ""
    for c in map(chr, range(0x110000)):
        if rank := unicodedata.combining(c):
            pair = c + "\u0334" if rank > 1 else "\u0301" + c  # the first ranks after the second
            still += c if nfc.normalize_str(pair) != unicodedata.normalize("NFC", pair) else ""
    return {ord(c): _STAND_INS[theirs.get(c, "")] for c in {*ours, *theirs} if ours.get(c, "") != theirs.get(c, "")}, lower, still


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 characters stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a tokenizer file says: token ids, merges in order of priority, special tokens and the pattern of words."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int]
    pattern: str
    suffix: str
    stand_ins: dict[int, str] = field(default_factory=dict)
    lower: dict[int, str] = field(default_factory=dict)
    still: str = ""

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a tokenizer file of the word-end kind (NFC, lower case, one split pattern, bytes as symbols)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or byte_level["type"] != "ByteLevel":
            raise ValueError("not a lower-casing word tokenizer with bytes as symbols")
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}, split["pattern"]["Regex"], model["end_of_word_suffix"] or "", *unicode_notes())

    def __getstate__(self) -> dict:
        """The fields alone travel, not what was made from them."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def tables(self) -> Tables:
        return Tables.of(self)

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in [*self.ids.items(), *self.specials.items()]}

    @cached_property
    def longest(self) -> int:
        """Symbols in the longest token."""
        return max((len(self.symbols_of(t)) for t in self.ids), default=1)

    def symbols_of(self, token: str) -> list[str]:
        """A token as its symbols; the last may carry the word-end suffix."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    @cached_property
    def lookahead(self) -> int:
        """Symbols that the encoder must have read beyond a token's end before the token is stable.

        reach[x] is how far a merge whose left part is x can depend on what follows x: its right part, and whatever a merge of
        higher priority that starts with an end of the right part depends on. Rules are taken in order of priority, so each
        sees only those that can pre-empt it.
        """
        reach: dict[tuple[str, ...], int] = {}
        most = 0
        for left, right in self.merges:
            x, y = tuple(self.symbols_of(left)), tuple(self.symbols_of(right))
            further = max(reach.get(y[k:], 0) for k in range(len(y)))
            reach[x] = max(reach.get(x, 0), len(y) + further)
            most = max(most, reach[x])
        return most + self.longest


@dataclass
class Tables:
    """What the transducers read, in a few compact tables: this is what travels to the workers, and not the vocabulary.

    pairs: (left id, right id) in one integer -> (rank, id of the whole) in one integer, so that the least is the next merge.
    """

    pairs: dict[int, int]
    inner: list[int]
    final: list[int]
    width: bytes
    written: list[bytes]
    specials: dict[str, int]
    pattern: str
    margin: int
    stand_ins: dict[int, str]
    lower: dict[int, str]
    still: str

    @classmethod
    def of(cls, v: Vocabulary) -> Tables:
        pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(v.merges):
            pairs.setdefault(v.ids[a] << 20 | v.ids[b], rank << 20 | v.ids[a + b])
        most = max(v.tokens) + 1
        width, written = bytearray(most), [b""] * most
        for t, i in v.ids.items():
            width[i] = len(v.symbols_of(t))
        for i, t in v.tokens.items():
            written[i] = t.encode("utf-8")
        symbols = byte_symbols()
        return cls(pairs, [v.ids[s] for s in symbols], [v.ids[s + v.suffix] for s in symbols], bytes(width), written, v.specials, v.pattern, v.lookahead, v.stand_ins, v.lower, v.still)

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def encoder(self) -> Encoder:
        """This process's encoder: it and its cache last from task to task, as long as the broadcast tables."""
        return Encoder(self)

    @cached_property
    def decoder(self) -> Decoder:
        return Decoder(self)


class Encoder:
    """The transducer from text to token ids. Texts go through it in slabs, their words one after another."""

    def __init__(self, tables: Vocabulary | Tables):
        t = tables.tables if isinstance(tables, Vocabulary) else tables
        self.t = t
        self.words = regex.compile(t.pattern.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(t.specials, key=len, reverse=True)) + ")") if t.specials else None
        self.odd = regex.compile("[" + "".join(map(regex.escape, map(chr, sorted(t.stand_ins)))) + "]") if t.stand_ins else None
        self.still = regex.compile(f"([{''.join(map(regex.escape, t.still))}])") if t.still else None
        #: Texts whose characters all come before the first one that the tables tell differently need no second look.
        first = min([*t.stand_ins, *t.lower, *map(ord, t.still)], default=0x10FFFF)
        self.far = re.compile(f"[{chr(first)}-{chr(0x10FFFF)}]")
        self.margin = t.margin
        self.capacity = 2 * self.margin + 64
        self.kept = Kept(self._chunk, CACHE_WORDS)
        #: Words that went through the transducer, and tokens that left it before their word's end was read.
        self.n_words = self.n_early = 0

    def _merge(self, run: list[int]) -> list[int]:
        """All merges of a short run of ids: the best-ranked pair first, the leftmost of equals."""
        get, none = self.t.pairs.get, 1 << 60
        run = list(run)
        open_ = [get(a << 20 | b, none) for a, b in pairwise(run)]
        last = len(open_) - 1
        while last >= 0 and (best := min(open_)) != none:
            i = open_.index(best)
            run[i] = whole = best & 0xFFFFF
            del run[i + 1], open_[i]
            if i < last:
                open_[i] = get(whole << 20 | run[i + 1], none)
            if i:
                open_[i - 1] = get(run[i - 1] << 20 | whole, none)
            last -= 1
        return run

    def stream(self, word: bytes) -> Iterator[int]:
        """Token ids of one word, with a buffer of at most `capacity` symbols: what ends `margin` symbols before the last one read is
        stable and leaves; at the word's end all is, as no merge goes beyond it."""
        inner, width = self.t.inner, self.t.width
        self.n_words += 1
        buffer: list[int] = []
        at, last = 0, len(word) - 1
        while at < last:
            room = min(last - at, self.capacity - len(buffer))
            buffer += [inner[b] for b in word[at : at + room]]
            at += room
            if len(buffer) == self.capacity:
                end = 0
                for t in self._merge(buffer):
                    if end + width[t] > len(buffer) - self.margin:
                        break
                    yield t
                    self.n_early += 1
                    end += width[t]
                del buffer[:end]
        buffer.append(self.t.final[word[last]])
        yield from self._merge(buffer)

    def _word(self, word: str) -> bytes:
        return array("I", self.stream(word.encode("utf-8", "replace"))).tobytes()

    def _split(self, chunk: str) -> list[str]:
        """The words of a chunk; characters whose class differs between the tables are matched by their stand-ins."""
        if self.odd is None or not self.far.search(chunk) or not self.odd.search(chunk):
            return self.words.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.words.finditer(chunk.translate(self.t.stand_ins))]

    def _chunk(self, chunk: str) -> bytes:
        """The ids of text without white space; a word matched within a chunk is matched whole when it stands alone.

        Letters alone are one word, and so are they and the ASCII punctuation after them; the pattern splits all else.
        """
        if chunk.isalpha():
            return self._word(chunk)
        letters = chunk.rstrip(string.punctuation)
        if letters.isalpha():
            return self.kept[letters] + self.kept[chunk[len(letters) :]]
        words = self._split(chunk)
        return self._word(chunk) if words == [chunk] else b"".join(map(self.kept.__getitem__, words))

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, piece by piece, each id as a little-endian unsigned 32-bit integer; special tokens written in it
        become their ids.

        No word spans white space, so texts are cut there into slabs and chunks, and chunks seen before need no matching. A slab
        ends before a space, with which no character composes.
        """
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.t.specials) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield array("I", [self.t.specials[part]]).tobytes()
                continue
            at = 0
            while at < len(part):
                end = part.find(" ", at + SLAB)
                end = len(part) if end < 0 else end
                yield self._slab(part[at:end])
                at = end

    def _slab(self, slab: str) -> bytes:
        if not slab.isascii():
            far = self.far.search(slab) is not None
            if far and self.still and self.still.search(slab):
                slab = "".join(unicodedata.normalize("NFC", x) for x in self.still.split(slab))
            else:
                slab = unicodedata.normalize("NFC", slab)
            slab = slab.replace("Σ", "σ")  # each letter is lowered by itself
            if far and self.t.lower:
                slab = slab.translate(self.t.lower)
        slab = slab.lower()
        chunks = self._split(slab) if _NO_SPACES.search(slab) else slab.split()
        return b"".join(map(self.kept.__getitem__, chunks))

    def pack(self, text: str) -> bytes:
        return b"".join(self.pieces(text))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return np.frombuffer(self.pack(text), dtype="<u4").tolist()


class Decoder:
    """The transducer from ids to text: tokens in their written form, parted by a space, through a UTF-8 state machine."""

    def __init__(self, tables: Vocabulary | Tables):
        self.written = (tables.tables if isinstance(tables, Vocabulary) else tables).written

    def stream(self, ids: Iterable[int], chunk: int = TOKENS) -> Iterator[str]:
        """Text as it becomes certain; ids that no token has are left out."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        written, n = self.written, len(self.written)
        known = (x for i in ids if i < n and (x := written[i]))
        gap = b""
        while pending := list(islice(known, chunk)):
            yield machine.decode(gap + b" ".join(pending))
            gap = b" "
        yield machine.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))

    def unpack(self, packed: bytes) -> str:
        """The text of ids of 4 bytes each; no more than `TOKENS` ids are taken out at a time."""
        ids = np.frombuffer(packed, dtype="<u4")
        return self.decode(i for k in range(0, len(ids), TOKENS) for i in ids[k : k + TOKENS].tolist())


_IDS, _DECODED = T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())


def _add(df: DataFrame, vocabulary: Vocabulary, column: str, what: str, fields: list[T.StructField]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.tables)  # of a tokenizer file: a few MB

    def make():
        tables = shared.value
        ids = lambda x: tables.encoder.pack(x or "")
        text = lambda x: tables.decoder.unpack(x or b"")

        def work(column: pa.Array) -> list[pa.Array]:
            if what == "decode":
                return [pa.array([text(x.as_py()) for x in column], pa.string())]
            packed = [ids(x.as_py()) for x in column]
            encoded = [pa.array(packed, pa.binary())]
            return [*encoded, pa.array(map(text, packed), pa.string())] if what == "both" else encoded

        return work

    return add_columns(df, make, [column], fields)


def encode_documents(documents: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Add token_ids: the ids of the whole text as little-endian unsigned 32-bit integers (binary, 4 bytes an id).

    Null and empty texts have no ids; repeated rows are encoded alike, an empty table gives none. An input column named token_ids is
    replaced, all others are kept.
    """
    return _add(documents, vocabulary, text, "encode", [_IDS])


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids") -> DataFrame:
    """Add decoded: the text of the ids in `ids` (null or empty: empty; ids that no token has are left out). Repeated rows are decoded
    alike, an empty table gives none. A column named decoded is replaced."""
    return _add(encoded, vocabulary, ids, "decode", [_DECODED])


def transcode_documents(documents: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """encode_documents() and decode_documents() in one pass, so that a task needs one Python worker and not two."""
    return _add(documents, vocabulary, text, "both", [_IDS, _DECODED])

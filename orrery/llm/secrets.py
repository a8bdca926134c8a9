"""Secrets in texts, and which of them are live: candidates' hashes are counted by distinct repositories and owners over the corpus.

A credential that many owners or many repositories have is a copied example; one that only its owner has, in few repositories, looks
live. Where a table names no repository, each distinct text is one: copies of a text don't make its secrets better known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import add_columns, shared_table, without

#: Patterns, least lengths and order of the kinds (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "owner")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Tokens that may be credentials though no pattern names them.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A run this long is the only kind of hex run that counts, and finding it directly skips the many short ones.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[int, int, str, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, value) by the patterns alone, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def looks_random(token: str, least_bits: float = 3.5) -> bool:
    """Digits and letters in a mix of at least `least_bits` bits a character."""
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    p = np.array([token.count(c) for c in set(token)]) / len(token)
    return float(-(p * np.log2(p)).sum()) >= least_bits


def candidate_spans(text: str, base: list[Span]) -> list[Span]:
    """Random-looking tokens that no base span touches; both lists are gone through once, by place."""
    out, k, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][0] < e:  # reach: the furthest end of the spans that start before the token's end
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s and looks_random(m[0]):
            out.append((s, e, "owner", m[0]))
    return out


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value_hash", T.LongType())])
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value_hash", pa.int64())]))


def find_candidates(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add base_spans and candidates (arrays of start, end, kind, value_hash; code points, end exclusive) of whole texts."""

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            told = lambda spans: [{"start": s, "end": e, "kind": k, "value_hash": xxhash.xxh3_64_intdigest(v.encode()) - (1 << 63)} for s, e, k, v in spans]
            base, more = [], []
            for t in (x.as_py() or "" for x in column):
                own = base_spans(t)
                base.append(told(own))
                more.append(told(candidate_spans(t, own)))
            return [pa.array(base, _ARROW), pa.array(more, _ARROW)]

        return work

    return add_columns(documents, make, [text], [T.StructField("base_spans", T.ArrayType(SPAN)), T.StructField("candidates", T.ArrayType(SPAN))])


@dataclass(frozen=True)
class Limits:
    """How many owners and repositories a live-looking value has at most, and from which number on it is a copied example."""

    live_owners: int = 1
    live_repositories: int = 3
    example_owners: int = 3
    example_repositories: int = 10

    def live(self) -> Column:
        return (F.col("n_owners") <= self.live_owners) & (F.col("n_repositories") <= self.live_repositories)

    def example(self) -> Column:
        return (F.col("n_owners") >= self.example_owners) | (F.col("n_repositories") >= self.example_repositories)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """For each value hash, base or candidate: in how many documents, distinct repositories and distinct owners it occurs.

    Counts are reduced by (hash, repository, owner) first, so a value that a third of the corpus holds is few rows by then.
    """
    every = found.select(F.explode(F.array_distinct(F.transform(F.concat("base_spans", "candidates"), lambda s: s["value_hash"]))).alias("value_hash"), F.col(repository).alias("r"), F.col(owner).alias("o"))
    pairs = every.groupBy("value_hash", "r", "o").agg(F.count("*").alias("n"))
    return pairs.groupBy("value_hash").agg(F.sum("n").alias("n_documents"), F.count_distinct("r").alias("n_repositories"), F.count_distinct("o").alias("n_owners"))


def scan_secrets(documents: DataFrame, text: str = "text", repository: str | None = None, owner: str = "source", limits: Limits = Limits(), keep_text: bool = True) -> DataFrame:  # noqa: B008
    """Add base_spans, owner_spans (candidates that look live by `limits`) and n_live, n_example: how many of the document's base
    values look live, and how many are copied examples.

    `owner` names the column of who has a document, `repository` that of where it is; without one, a distinct text is a repository.
    Texts are scanned once; the spans are written to the shared folder, with the text only if it is kept. Null texts are empty; a
    null repository or owner counts as none. Repeated rows are told alike, an empty table gives no rows. Input columns with these
    names are replaced, all others kept; keys compare whole values, so rows may repeat a doc_id.
    """
    plain = without(documents, "base_spans", "owner_spans", "candidates", "n_live", "n_example", "__key", "__repository")
    place = F.col(f"`{repository}`") if repository else F.xxhash64(text, F.length(text))
    found = find_candidates(plain.withColumn("__repository", place), text)
    out = [c for c in plain.columns if keep_text or c != text]
    found = shared_table(found.select(*[F.col(f"`{c}`") for c in [*out, "__repository"]], "base_spans", "candidates"), "candidates")
    # rows with the same spans in the same order get the same verdicts, so they need no key of their own
    some = (F.size("candidates") > 0) | (F.size("base_spans") > 0)
    few = found.where(some).withColumn("__key", F.sha2(F.to_json(F.struct("base_spans", "candidates")), 256))
    # both tables are written before they are joined, so that joins can split a value or a text that a third of all rows have
    counts = shared_table(ownership(few, "__repository", owner), "owners")
    keyed = few.select("__key", "base_spans", "candidates").groupBy("__key").agg(F.first("base_spans").alias("b"), F.first("candidates").alias("c"))
    each = keyed.select("__key", F.explode(F.concat("b", "c")).alias("s")).select("__key", "s.*")
    own, base = F.col("kind") == "owner", F.col("kind") != "owner"
    judged = each.join(counts, "value_hash").groupBy("__key").agg(
        F.sort_array(F.collect_list(F.when(own & limits.live(), F.struct("start", "end", "kind", "value_hash")))).alias("owner_spans"),
        F.count_if(base & limits.live()).alias("n_live"),
        F.count_if(base & limits.example()).alias("n_example"),
    )
    judged = shared_table(judged, "judged")
    columns = [*[F.col(f"`{c}`") for c in out], "base_spans", "owner_spans", "n_live", "n_example"]
    none = found.where(~some).withColumns({"owner_spans": F.array().cast(T.ArrayType(SPAN)), "n_live": F.lit(0).cast("long"), "n_example": F.lit(0).cast("long")})
    return few.join(judged, "__key").select(*columns).unionByName(none.select(*columns))


def redact(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace each base and owner span of the text by `mask` (overlapping ones by one); the span columns go.

    Takes the rows of scan_secrets() with their text. Null and empty texts and texts without spans stay as they are; repeated rows are
    masked alike, an empty table gives no rows; other columns are kept.
    """
    spans = F.concat("base_spans", "owner_spans")

    def step(acc, s):
        return (
            F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"), s["end"].alias("at")))
            .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
        )

    cut = F.aggregate(F.sort_array(spans), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    changed = F.when(F.size(spans) > 0, cut).otherwise(F.col(text))
    return scanned.withColumn(text, changed).drop("base_spans", "owner_spans", "n_live", "n_example")

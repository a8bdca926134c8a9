"""Toxic spans by a linear-chain conditional random field over the tokens of whole texts.

Document labels are projected to tokens (a word that is far likelier in toxic than in clean training documents is a toxic
token there), a two-state CRF is trained on these token sequences, and forward-backward marginals give, for each document,
a score between 0 and 1 and the offsets of the offending tokens.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import add_columns

TOKEN = re.compile(r"[^\W\d_]+")
#: Feature ids: 0 is any word outside the vocabulary, 1 the padding between documents.
OTHER, GAP = 0, 1


@dataclass
class Crf:
    """`emit[f]` is the log weight of the toxic over the clean state for feature f; `step[i][j]` that of going from state i to j."""

    vocabulary: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    #: Of the logistic map from document evidence to a score: intercept, log(1 + expected toxic tokens), probability of any.
    link: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 3.0]))


def token_ids(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all tokens of all texts in one array, with one gap after each text, and each text's start."""
    out: list[int] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    get = vocabulary.get
    for i, text in enumerate(texts):
        out.extend([get(w.lower(), OTHER) for w in TOKEN.findall(text or "")])
        out.append(GAP)
        starts[i + 1] = len(out)
    return np.array(out, dtype=np.int64), starts


def _scan(weight: np.ndarray, move: np.ndarray, enter: tuple[float, float], before: bool) -> np.ndarray:
    """The state vectors after each step of a chain that multiplies by `move` and scales the toxic state by the step's weight,
    before or after moving; rows (clean, toxic) with sum 1.

    The sequence is cut into about sqrt(n) lanes. All lanes' products of 2x2 matrices are found side by side, then the lanes are
    joined one after another, so there are sqrt(n) steps on whole arrays instead of n on numbers.
    """
    n = len(weight)
    width = max(1, int(np.sqrt(n)))
    lanes = -(-n // width)
    w = np.ones(lanes * width)
    w[:n] = weight
    w = np.ascontiguousarray(w.reshape(lanes, width).T)
    (m00, m01), (m10, m11) = move
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    made = np.empty((4, width, lanes))
    for k in range(width):
        if before:
            b, d = b * w[k], d * w[k]
        a, b, c, d = a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11
        if not before:
            b, d = b * w[k], d * w[k]
        if k % 4 == 3:
            total = a + b + c + d
            a, b, c, d = a / total, b / total, c / total, d / total
        made[:, k] = a, b, c, d
    x, y = np.empty(lanes), np.empty(lanes)
    u, v = enter
    ends = made[:, -1].tolist()
    for k in range(lanes):
        x[k], y[k] = u, v
        u, v = u * ends[0][k] + v * ends[2][k], u * ends[1][k] + v * ends[3][k]
        u, v = u / (u + v), v / (u + v)
    out = np.stack([(x * made[0] + y * made[2]).T.ravel()[:n], (x * made[1] + y * made[3]).T.ravel()[:n]], axis=1)
    return out / out.sum(axis=1, keepdims=True)


def marginals(ids: np.ndarray, emit: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of being toxic, and the probabilities of each pair of neighbouring states (n-1, 2, 2).

    A gap forces the clean state, so documents don't touch each other.
    """
    weight = np.exp(emit[ids])
    weight[ids == GAP] = 0.0
    move = np.exp(step)
    forward = _scan(weight, move, (1.0, 0.0), before=False)
    back = np.ones((len(ids), 2))
    back[:-1] = _scan(weight[1:][::-1], move.T, (0.5, 0.5), before=True)[::-1]
    both = forward * back
    both /= both.sum(axis=1, keepdims=True)
    ahead = back[1:].copy()
    ahead[:, 1] *= weight[1:]
    pair = forward[:-1, :, None] * move[None] * ahead[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return both[:, 1], pair


def _evidence(p: np.ndarray, pair: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document: log(1 + expected toxic tokens), and the probability that some token is toxic."""
    expected = np.add.reduceat(np.append(p, 0.0), starts[:-1])
    # P(all clean) = product over t of P(clean_t | clean_{t-1}); across gaps the chain starts anew
    stay = np.log(np.maximum(pair[:, 0, 0], 1e-300)) - np.log(np.maximum(pair[:, 0].sum(axis=1), 1e-300))
    stay = np.concatenate([[np.log(max(1e-300, 1 - p[0]))], stay]) if len(p) else np.zeros(0)
    clean = np.add.reduceat(np.append(stay, 0.0), starts[:-1])
    return np.stack([np.log1p(np.maximum(expected, 0)), 1 - np.exp(np.minimum(clean, 0))], axis=1)


def score_batch(texts: list[str | None], model: Crf, slab: int = 400_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, token marginals and token starts of some texts; tokens are handled in slabs of whole documents."""
    ids, starts = token_ids(texts, model.vocabulary)
    parts, evidence, first = [], [], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + slab, side="right")) - 1)
        p, pair = marginals(ids[starts[first] : starts[last]], model.emit, model.step)
        parts.append(p)
        evidence.append(_evidence(p, pair, starts[first : last + 1] - starts[first]))
        first = last
    x = np.concatenate(evidence) if evidence else np.zeros((0, 2))
    z = model.link[0] + x @ model.link[1:]
    return 1 / (1 + np.exp(-z)), np.concatenate(parts) if parts else np.zeros(0), starts


def _distinct(docs: list[list[str]], size: int = 16) -> list[int]:
    """Documents without the copies of earlier ones: two are copies if half of their least `size` word hashes are the same."""
    seen: dict[int, list[int]] = {}
    kept = []
    for i, words in enumerate(docs):
        least = sorted({zlib.crc32(w.encode()) for w in words})[:size]
        shared = Counter(j for h in least for j in seen.get(h, ()))
        if shared and 2 * max(shared.values()) >= len(least):
            continue
        kept.append(i)
        for h in least:
            seen.setdefault(h, []).append(i)
    return kept


def _support(docs: list[list[str]]) -> Counter:
    """In how many documents each word occurs; copies count once."""
    return Counter(w for i in _distinct(docs) for w in set(docs[i]))


def train(texts: list[str | None], toxic: list[int], rounds: int = 40, vocabulary_size: int = 20_000, min_odds: float = 2.2, min_share: float = 0.008) -> Crf:
    """Fit the field to documents labelled 0 or 1.

    Tokens are labelled from the documents' labels: in toxic documents, a word is a toxic token if the log-odds of its support
    there against clean documents reach `min_odds` and its support is at least 6 and `min_share` of the toxic documents' number.
    Without documents of both labels, the field finds nothing toxic.
    """
    words = [[w.lower() for w in TOKEN.findall(t or "")] for t in texts]
    bad, good = [w for w, y in zip(words, toxic, strict=True) if y], [w for w, y in zip(words, toxic, strict=True) if not y]
    in_bad, in_good = _support(bad), _support(good)
    odds = lambda w: np.log((in_bad[w] + 0.5) / (len(bad) + 1)) - np.log((in_good[w] + 0.5) / (len(good) + 1))
    lexicon = {w for w, n in in_bad.items() if n >= max(6, min_share * len(bad)) and odds(w) >= min_odds} if good else set()
    common = Counter({w: in_bad[w] + in_good[w] for w in {*in_bad, *in_good}})
    chosen = sorted(lexicon) + sorted((w for w in common if w not in lexicon and common[w] >= 5), key=lambda w: (-common[w], w))
    vocabulary = {w: i + 2 for i, w in enumerate(chosen[:vocabulary_size])}
    model = Crf(vocabulary, np.full(len(vocabulary) + 2, -4.0), np.zeros((2, 2)))
    if not lexicon:
        model.emit[:] = -20.0
        return model
    ids, starts = token_ids(texts, vocabulary)
    y = np.zeros(len(ids))
    flagged = np.isin(ids, [vocabulary[w] for w in lexicon if w in vocabulary])
    of_bad = np.repeat(np.array(toxic, dtype=bool), np.diff(starts))
    y[flagged & of_bad] = 1
    n = len(model.emit)
    seen = np.bincount(ids, minlength=n).astype(float)
    want = np.bincount(ids, weights=y, minlength=n)
    states = y.astype(int)
    want_pair = np.zeros((2, 2))
    np.add.at(want_pair, (states[:-1], states[1:]), 1)
    theta = np.concatenate([model.emit, model.step.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):  # Adam on the penalised log likelihood, scaled by each feature's own count
        p, pair = marginals(ids, theta[:n], theta[n:].reshape(2, 2))
        slope = np.concatenate([(want - np.bincount(ids, weights=p, minlength=n)) / (seen + 1), ((want_pair - pair.sum(axis=0)) / len(ids)).ravel()])
        slope -= 1e-4 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    model.emit, model.step = theta[:n], theta[n:].reshape(2, 2)
    p, pair = marginals(ids, model.emit, model.step)
    x = np.concatenate([np.ones((len(texts), 1)), _evidence(p, pair, starts)], axis=1)
    target, beta = np.array(toxic, dtype=float), np.zeros(3)
    for _ in range(30):  # Newton steps of the penalised logistic fit
        q = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        beta += np.linalg.solve(hessian, x.T @ (target - q) - 0.1 * beta)
    model.link = beta
    return model


def training_sample(documents: DataFrame, labels: DataFrame, per_label: int = 1200, max_chars: int = 20_000, seed: int = 7) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled training documents: `per_label` of each label, chosen by a seeded hash of doc_id.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are taken; labels that are neither 0 nor 1 are left out, documents with
    two labels count as toxic, of several texts of a doc_id the first in their order counts, and texts over `max_chars` characters are left out of training (never of scoring).
    """
    key = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (key % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    picked = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_label) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= max_chars).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score_toxicity(documents: DataFrame, model: Crf, text: str = "text", span_floor: float = 0.5) -> DataFrame:
    """Add toxic_score (0 to 1) and toxic_spans (start, end, probability: tokens whose marginal is at least `span_floor`).

    Every whole text is scored; null and empty texts get the score of no evidence and no spans. Repeated rows are scored alike.
    Input columns named toxic_score or toxic_spans are replaced; all others are kept.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most vocabulary_size words

    def make():
        crf = shared.value

        def work(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            scores, p, starts = score_batch(texts, crf)
            found = []
            for i, t in enumerate(texts):
                own = p[starts[i] : starts[i + 1] - 1]
                hot = set(np.flatnonzero(own >= span_floor).tolist())
                found.append([{"start": m.start(), "end": m.end(), "p": float(own[k])} for k, m in enumerate(TOKEN.finditer(t)) if k in hot] if hot else [])
            return [pa.array(scores, pa.float64()), pa.array(found, arrow_span)]

        return work

    return add_columns(documents, make, [text], [T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", span)])

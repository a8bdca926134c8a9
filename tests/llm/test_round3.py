"""Merkle manifest, packing and filter audit against brute force, on odd rows, hot groups and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from orrery.llm import audit, common, merkle, packing, queries

ODD = [
    (1, "s", "en", 3, "one"),
    (1, "s", "en", 3, "one"),
    (1, "t", "en", 9, "another text of the same id"),
    (2, None, None, None, None),
    (3, "", "", 0, ""),
    (4, "s", "é", 5, "w " * 3000),
    (None, "s", "en", 1, "lost"),
    (None, "s", "en", 1, "lost"),
    (5, "t", "en", 3, "A# B% " * 40),
    (6, None, "en", 3, "one"),
    (7, "t", "en", 3, "A# B% " * 40),
    *[(100 + i, "hot", "de", 7, "the same text of many rows " * 12) for i in range(150)],
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with odd documents, with columns whose names clash with the operators'."""
    d = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(ODD, "doc_id long, source string, lang string, n_chars long, text string")
    docs.withColumns({c: F.lit("x") for c in ("leaf", "Grp", "pos", "n", "piece", "length", "offset", "part", "digest", "word", "failed", "row", "above", "proof")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 1), (100, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{d}-none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}-none/labels.parquet")
    return d


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tamper=0):
    i, source, lang, n, text = row
    fields = [i, source, lang, n + tamper if n is not None else None, text]
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(nodes):
    """All levels of a binary tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        at >>= 1
    return out


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(groups[lang]):
            proof = way(trees[lang], at) + way(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if tampered else 0)
            for side, other in proof:
                node = H(node) if other is None else H(other, node) if side else H(node, other)
            out.append((str(r[0]), leaf(r), trees[lang][-1][0], top[-1][0], H(*[o for _, o in proof if o]), node, node == top[-1][0]))
    return sorted(out)


def test_manifest_against_brute_force(spark, odd):
    got = queries.op11_merkle_manifest(spark, odd)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted((str(r[0]), *r[1:]) for r in got.collect())
    assert rows == brute_manifest(ODD)
    assert {r[-1] for r in rows} == {True, False}
    assert queries.op11_merkle_manifest(spark, f"{odd}-none").collect() == []


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 4097])
def test_manifest_of_any_size(spark, n):
    rows = [(i, "s", "en" if i % 5 else "fr", i, f"t{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    manifest = merkle.build_manifest(leaves, "lang", "doc_id")
    want = {r[0]: (r[1], r[4]) for r in brute_manifest(rows)}
    for made in (manifest, merkle.open_manifest(spark, manifest.path)):
        got = merkle.proofs(made).select("doc_id", "leaf", merkle.proof_digest(F.col("proof")).alias("p"), (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
        assert {str(r[0]): (r[1], r[2]) for r in got} == want and all(r["ok"] for r in got)
    changed = leaves.withColumn("leaf", F.when(F.col("doc_id") == 0, F.lit("0" * 64)).otherwise(F.col("leaf")))
    assert sorted((r["doc_id"], r["side"], r["n"]) for r in merkle.changed_rows(manifest, changed, "doc_id").collect()) == [(0, "added", 1), (0, "missing", 1)]
    assert merkle.changed_rows(manifest, leaves, "doc_id").isEmpty()


def test_places_of_a_hot_group(spark):
    df = common.shared_table(spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("a")).otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"), "id"), "t")
    by = defaultdict(list)
    for r in common.placed(df, ["g"], ["id"]).collect():
        by[r["g"]].append((r["id"], r["pos"], r["n"]))
    assert len(by) == 1002
    for rows in by.values():
        rows.sort()
        assert [p for _, p, _ in rows] == list(range(len(rows))) and {n for _, _, n in rows} == {len(rows)}


# packing
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(packing, "SLAB", 8)
    encoder = packing.Encoder(PATH)
    rng = random.Random(5)
    texts = ["", " ", "a  b", "a \n b\n\n c <|endoftext|> d  <|endoftext|>\te", "\x1c x\x1f y \x85 z", "it's  we'll 'S x'd 12 345 $%& €  ", "a　b c​ d", " lead", "trail ", "x,, y.. z!!!! (q) 'll", "a" * 5000]
    texts += ["".join(rng.choice("ab é \x85\x1c\x1f\n\t ,.'sS019ßÅʼñŋɐ 中 漢  ") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), 32])) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_of_another_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, other = packing.Encoder(path), tokenizers.Tokenizer.from_file(path)
    assert not encoder.by_words
    assert np.frombuffer(encoder.encode("Some words, here"), "<u4").tolist() == other.encode("Some words, here", add_special_tokens=False).ids


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query_against_the_library(spark, odd, library):
    rows = queries.op12_best_fit_packing(spark, odd).collect()
    want = Counter()
    for i, *_, text in ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at, to = 0, (len(ids) - 1) % 1024 + 1
        for k in range(len(ids)):
            if at == len(ids):
                break
            want[(i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes()))] += 1
            at, to = to, to + 1024
    assert Counter(tuple(r)[:5] for r in rows) == want
    counts = np.bincount([r["length"] for r in rows], minlength=1025)
    n = check_packing(rows, 1024)
    assert n <= sum(packing.best_fit(counts).values()) and n == packing.plan(counts).n_sequences
    assert queries.op12_best_fit_packing(spark, f"{odd}-none").collect() == []


def test_packing_of_real_tables(spark):
    rows = queries.op12_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    counts = np.bincount([r["length"] for r in rows], minlength=1025)
    assert check_packing(rows, 1024) <= 1.01 * packing.plan(counts).bound + 1


def test_sequences_hold_their_tokens(spark, odd, library):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    packed = common.shared_table(packing.pack(packing.token_pieces(docs, PATH, 2, 256), 256), "packed")
    text = {t or "" for *_, t in ODD}
    known = {t: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in text}
    joined = Counter()
    for r in packing.sequences(packed).collect():
        assert 0 < r["tokens"] <= 256 and len(r["ids"]) == 4 * r["tokens"] and len(r["parts"]) > 0
        joined[bytes(r["ids"])] += 1
    assert sum(len(b) * n for b, n in joined.items()) == sum(len(known[t or ""]) for *_, t in ODD)


@pytest.mark.parametrize("kind", ["uniform", "skewed", "one", "ones", "pairs", "none"])
def test_plans(kind):
    rng = np.random.default_rng(2)
    lengths = {"uniform": rng.integers(1, 65, 4000), "skewed": np.clip(rng.lognormal(2.5, 0.6, 4000).astype(int), 1, 64), "one": [64], "ones": [1] * 1000, "pairs": [40] * 500 + [24] * 500, "none": []}[kind]
    counts = np.bincount(np.array(lengths, dtype=int), minlength=65)
    p = packing.plan(counts)
    used = Counter()
    for config, n in p.sequences:
        assert n > 0 and sum(x * m for x, m in config) <= 64
        for x, m in config:
            used[x] += n * m
    assert used == Counter({x: int(n) for x, n in enumerate(counts) if n})
    assert p.bound - 1e-6 <= p.n_sequences <= max(np.ceil(p.bound), 1.01 * p.bound + 1)
    assert p.n_sequences <= 1.002 * sum(packing.best_fit(counts).values())


def test_the_program_does_better_than_best_fit_alone():
    """Lengths around a third of a sequence, of which best-fit decreasing puts the long ones together."""
    counts = np.bincount(np.clip(np.random.default_rng(0).lognormal(5.8, 0.5, 30_000).astype(int), 1, 1024), minlength=1025)
    p = packing.plan(counts)
    assert p.n_sequences < 0.999 * sum(packing.best_fit(counts).values()) and p.n_sequences < 1.003 * p.bound


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(0, 60))), reverse=True)
        rooms = []
        for x in lengths:
            fit = [r for r in rooms if r >= x]
            r = min(fit, default=20)
            if fit:
                rooms.remove(r)
            rooms.append(r - x)
        assert sum(packing.best_fit(np.bincount(lengths, minlength=21)).values()) == len(rooms)


def test_plan_does_not_grow_with_the_table():
    counts = np.bincount(np.random.default_rng(3).integers(1, 65, 5000), minlength=65)
    assert len(packing.plan(counts * 10**7).sequences) < 2000


def test_pieces_out_of_range(spark):
    with pytest.raises(ValueError, match="1 to 8 tokens"):
        packing.pack(spark.createDataFrame([(9,)], "length long"), 8)


# filter audit
def test_audit_against_brute_force(spark, odd):
    labels = defaultdict(lambda: (False, False))
    for i, q, t in [(1, 1, 0), (1, 0, 1), (5, 0, 1), (100, 1, None)]:
        labels[i] = (labels[i][0] or q == 1, labels[i][1] or t == 1)
    first = {}
    for i, *_, text in ODD:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    judged = []
    for i, source, _, _, text in ODD:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        judged.append((source or "", {f for f in fails if fails[f]}, *labels[i]))
    want = {}
    for part in {j[0] for j in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out = [j for j in left if f in j[0]]
                left = [j for j in left if f not in j[0]]
                shapley[f] += len(out)
                redundant = sum(f in j[0] for j in mine) - len(out)
                want[part, "".join(order), step] = [len(left), len(out), redundant, sum(j[0] == {f} for j in mine), sum(j[1] for j in out), sum(j[2] for j in out)]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    got = queries.op13_filter_audit(spark, odd)
    assert {t for _, t in got.dtypes[3:]} == {"bigint"} and got.dtypes[2] == ("step", "int")
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()} == want
    assert queries.op13_filter_audit(spark, f"{odd}-none").collect() == []


def test_word_totals(spark):
    docs = spark.createDataFrame([(1, "a b a\x0bc\x0c\td\r\n"), (2, " \t"), (3, "x\x1cy x y")], "id long, text string")
    assert sorted(map(tuple, audit.word_totals(docs, "id").collect())) == [(1, 5, 4), (3, 2, 2)]

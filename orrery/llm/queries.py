"""One query for each operator, over its whole table with production parameters, and DuckDB SQL where SQL can express it.

All return one row for each row of their table (op10: for each pair found), repeated rows alike, however long a text is; an empty table
gives no rows; other columns are not read, so their names can't clash. What nulls and empty texts give is told by each.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import audit, bpe, decontam, htmltext, merkle, neardup, packing, quality, secrets, sharding, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the field trained on documents that aren't held out. Null and empty texts have the score of no evidence; a null doc_id is
    not held out. Without labels, nothing is toxic."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(*toxicity.training_sample(documents, _table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(documents, model)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.concat_ws(",", F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("offsets"),
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with the label of the document that the path names by its number, which is the document on the page: blocked if it is of
    low quality or toxic."""
    number = F.nullif(F.regexp_extract("url", r"://[^/?#]*/[a-z]+/(\d{1,18})", 1), F.lit("")).cast("long")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("blocked"))
    return pages.select("url", number.alias("doc_id")).join(known, "doc_id").select("url", "blocked")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by the fixed rules, else by mined ones, else allow. Null and malformed URLs have empty host and path."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = urlfilter.mine_rules(labelled_urls(pages, _table(spark, sf_dir, "labels")), QUERY_RULES)
    judged = urlfilter.judge_urls(pages, rules, QUERY_RULES)
    first = F.get("mined", F.lit(0))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("mined").cast("long").alias("n_mined"), F.array_join(first["tokens"], " ").alias("mined_rule"), first["confidence"].alias("mined_confidence"))


#: Precision first: a rule that blocks must be right more often than not.
QUERY_RULES = urlfilter.Params(confidence=0.5)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by doc_id; null ids share a shard, null texts have size 1 and the checksum of nothing; equal texts and rows are told
    apart by slot alone."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = sharding.shard_documents(documents, shards=8)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return sharded.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts; null and empty pages and those without an article have an empty one."""
    found = htmltext.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _span_list(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed, comma-joined."""
    rank = lambda kind: F.array_position(F.array(*[F.lit(k) for k in secrets.KINDS]), kind)
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("r"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and their verdicts; null and empty texts have none, a null source is no owner."""
    scanned = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_span_list(F.col("base_spans")), 256).alias("base_sha256"),
        _span_list(F.concat("base_spans", "owner_spans")).alias("spans"),
        F.col("n_live").cast("long").alias("n_live"),
        F.col("n_example").cast("long").alias("n_example"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts from the stored ledger; null and empty texts have no words and fail."""
    ledger = quality.stored_ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.apply_policy(ledger, quality.STANDARD)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes(quality.BASE)).alias("base_failed"), "kept", "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone and with others."""
    return quality.ablations(quality.stored_ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")), [quality.BASE, quality.STANDARD])


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of whole texts and what they decode to; null and empty texts have none, and the digests of nothing."""
    vocabulary = bpe.Vocabulary.load(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(bpe.transcode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), "doc_id")


def token_digests(decoded: DataFrame, *columns: str) -> DataFrame:
    return decoded.select(*columns, F.shiftright(F.octet_length("token_ids"), 2).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates; null and empty texts are linked with nothing, rows without doc_id have no component and are kept,
    rows that share a doc_id are one vertex."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written and read back; a null page is an empty payload, null ids come before all others when payloads tie."""
    back = warc.archive_round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they hold; null and empty texts and items hold nothing, a null doc_id is told as null."""
    return decontam.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves by language with their proofs, and what tampered rows lead to. Null fields are a dash in the leaf; rows without a doc_id come
    first in their language and aren't tampered with; equal rows are leaves of their own."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n_chars: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = documents.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("tampered_leaf"))
    manifest = merkle.build_manifest(leaves, "lang", "doc_id")
    proven = merkle.proofs(manifest).withColumn("folded_root", merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    subroots = manifest.subroots()
    joined = proven.join(subroots, proven["lang"].eqNullSafe(subroots["grp"]))
    return joined.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens. Null and empty texts are one piece of the end mark alone;
    repeated rows and rows without a doc_id are packed like all others."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(documents, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end=2, capacity=1024)
    packed = packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in each order of the five, by source. Null texts are empty, and equal to each other; a null source is the
    empty one; a row without a doc_id is nobody's copy and has no label; repeated rows count as often as they are there."""
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), part="source")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_sharding, op4_html_extraction, op5_secret_scan, op6_quality_rules, op7_bpe, op8_near_dedup, op9_warc, op10_decontamination, op11_merkle_manifest, op12_best_fit_packing, op13_filter_audit, pipeline, quality_ablations)}


_WORDS = r"[^\x20\x09-\x0D]+"

_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{_WORDS}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT row, i, [words[i], words[i + 1], words[i + 2]] AS g
            FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_exclaims
      FROM w LEFT JOIN covered USING (row)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END)
        + (CASE WHEN 2 * n_exclaims > n_words THEN 32 ELSE 0 END) AS bits FROM m)
"""
_LEDGER = _OP6
_OP6 += "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits FROM f"

_POLICIES = ", ".join(f"('{p.version}', '{r}', {p.mask}, {1 << quality.RULES[r]})" for p in (quality.BASE, quality.STANDARD) for r in p.rules)
_ABLATIONS = f"""{_LEDGER}
SELECT policy, rule, count(*) AS n_rows, count(*) FILTER (bits & mask <> 0) AS n_rejected, count(*) FILTER (bits & mask & bit <> 0) AS n_failing_rule, count(*) FILTER (bits & mask = bit) AS n_by_rule_alone
FROM f, (VALUES {_POLICIES}) v(policy, rule, mask, bit) GROUP BY 1, 2
"""

_OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS g FROM d),
n AS (SELECT doc_id, count(DISTINCT g) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(root) AS component_id FROM r GROUP BY id) c USING (doc_id)
"""

_OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM q
"""




def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: CRC-32 of a decimal number's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295)"""

_OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({_CRC}) % 7 = 0 THEN {_leaf('n_chars + 1')} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (SELECT lang, 0 AS level, pos, n, leaf AS h FROM l
       UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over_ AS (SELECT 0 AS level, pos, n, subroot AS h FROM s
          UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY level, pos // 2, n),
ways AS (SELECT u.lang, u.level, u.pos, u.n, o.h AS other FROM up u LEFT JOIN up o ON o.lang IS NOT DISTINCT FROM u.lang AND o.level = u.level AND o.pos = xor(u.pos, 1)
         UNION ALL SELECT s.lang, 1000 + u.level, u.pos, u.n, o.h FROM s JOIN over_ u ON u.pos = s.pos >> u.level LEFT JOIN over_ o ON o.level = u.level AND o.pos = xor(u.pos, 1)),
steps AS (SELECT l.doc_id, l.leaf, l.lang, l.pos AS place, w.level, w.pos % 2 AS side, w.other,
                 row_number() OVER (PARTITION BY l.lang, l.pos ORDER BY w.level) AS k
          FROM l JOIN ways w ON w.lang IS NOT DISTINCT FROM l.lang AND w.n > 1 AND (w.level >= 1000 OR w.pos = l.pos >> w.level)),
folds AS (SELECT lang, pos AS place, 0 AS k, coalesce(tampered, leaf) AS h FROM l
          UNION ALL SELECT f.lang, f.place, f.k + 1, sha256(CASE WHEN x.other IS NULL THEN f.h WHEN x.side = 1 THEN x.other || f.h ELSE f.h || x.other END)
          FROM folds f JOIN steps x ON x.lang IS NOT DISTINCT FROM f.lang AND x.place = f.place AND x.k = f.k + 1),
folded AS (SELECT lang, place, arg_max(h, k) AS folded_root FROM folds GROUP BY lang, place),
proofs AS (SELECT lang, place, string_agg(other, '' ORDER BY k) AS proof FROM steps GROUP BY lang, place)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM over_ WHERE n = 1) r ON true
JOIN folded f ON f.lang IS NOT DISTINCT FROM l.lang AND f.place = l.pos LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.pos
"""

_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(audit.FILTERS))
_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '{_WORDS}') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        {{'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)}} AS fails
      FROM w LEFT JOIN k USING (doc_id)),
c AS (SELECT part, (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) || (CASE WHEN fails.C THEN 'C' ELSE '' END) || (CASE WHEN fails.D THEN 'D' ELSE '' END)
        || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good) AS g, sum(toxic) AS t FROM f GROUP BY ALL),
o AS (SELECT o AS filter_order, step, substr(o, step, 1) AS filter, substr(o, 1, step - 1) AS before FROM (VALUES {_ORDERS}) v(o), (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT *, contains(failed, filter) AS hit, len(translate(failed, before, '')) < len(failed) AS gone FROM c, o),
r AS (SELECT part, filter_order, step, filter, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
        sum(n) FILTER (failed = filter) AS unique_fails, sum(g) FILTER (hit AND NOT gone) AS good_lost, sum(t) FILTER (hit AND NOT gone) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _OP11, "op13_filter_audit": _OP13, "op6_quality_rules": _OP6, "quality_ablations": _ABLATIONS, "op8_near_dedup": _OP8, "op9_warc": _OP9}

"""Text, extraction and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import extract, text, values
from orrery.operators import aggregate
from orrery.plans.registry import query, table

#: Words of the corpus that stand for lexicon entries.
SUBJECTS, ACTIONS = ["thatin", "ononst", "inoran"], ["hehely", "thing", "ation"]


@query("normalize_text", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '#[^#\\s]+#?|\\[[^\\[\\]]{1,12}\\]', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("h"))


@query("keyword_two_dim_filter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)thatin|ononst|inoran') AND regexp_matches(text, '(?i)hehely|thing|ation')")
def keyword_two_dim_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(text.two_dimensional_match(F.col("text"), SUBJECTS, ACTIONS)).select("doc_id")


@query("matched_keywords", "SELECT doc_id, array_to_string(list_filter(['thatin', 'ononst', 'inoran'], lambda k: contains(lower(text), k)), ',') AS words FROM documents")
def matched_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.matched_words(F.col("text"), SUBJECTS), ",").alias("words"))


@query("three_way_funnel", "SELECT doc_id, CASE WHEN regexp_matches(text, 'thatin|ononst') THEN 'relevant' WHEN regexp_matches(text, 'License|%%%') THEN 'irrelevant' ELSE 'unknown' END AS relevance FROM documents WHERE NOT regexp_matches(text, '!!') AND (regexp_matches(text, 'thatin|ononst|License|%%%') OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))")
def three_way_funnel(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "documents").where(~F.col("text").rlike("!!")).select("doc_id", text.relevance(F.col("text"), "thatin|ononst", "License|%%%").alias("relevance"))
    blocked = table(spark, d, "labels").where("quality = 0").select("doc_id")
    unknown = seen.where("relevance = 'unknown'").join(blocked, "doc_id", "left_anti")
    return seen.where("relevance != 'unknown'").unionByName(unknown)


@query("url_domain_parse", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def url_domain_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.try_element_at(text.url_parameters(F.col("url")), F.lit("ref")), F.lit("")).alias("ref"))


@query("html_to_text", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g'))) AS h FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("h"))


@query("outline_headings", "SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS n, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def outline_headings(spark: SparkSession, d: str) -> DataFrame:
    heads = F.regexp_replace(F.regexp_replace("html", r"<h([1-6])[^>]*>", "\n# "), r"</h[1-6]>", "\n")
    return table(spark, d, "pages").select("page_id", F.size(text.outline(heads)["headings"]).cast("bigint").alias("n"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("reference_mining", "SELECT page_id, ref FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([A-Za-z]{3,20})\"', 1))) AS ref FROM pages) WHERE lower(ref) NOT IN ('about', 'login')")
def reference_mining(spark: SparkSession, d: str) -> DataFrame:
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([A-Za-z]{3,20})"'), 1))
    return table(spark, d, "pages").select("page_id", F.explode(F.filter(refs, lambda x: ~F.lower(x).isin("about", "login"))).alias("ref"))


@query("ngram_freq", "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(text) - k + 2), lambda i: substr(text, i, k))) AS gram FROM documents, (VALUES (2), (3), (4)) v(k)) WHERE regexp_matches(gram, '\\p{L}') AND NOT regexp_matches(gram, '\\s') GROUP BY 1 HAVING count(*) >= 2")
def ngram_freq(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.ngrams(table(spark, d, "documents"), "text", keep=r"\p{L}")


@query("word_freq_topk", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) WHERE word <> '' AND word NOT IN ('the', 'of') GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def word_freq_topk(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.word_frequencies(table(spark, d, "documents"), "text", ("the", "of"))


_SCORE = """WITH h AS (SELECT doc_id, list_filter([CASE WHEN contains(lower(text), 'thatin') THEN 30 END, CASE WHEN contains(lower(text), 'ononst') THEN 20 END, CASE WHEN contains(lower(text), 'thing') THEN 10 END], lambda x: x IS NOT NULL) AS w,
  len(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) AS contacts, regexp_matches(text, '\\d') AS price, length(text) - length(replace(text, '|', '')) AS inq,
  CASE WHEN contains(text, 'stupid') THEN 1 ELSE 0 END AS scam, CASE WHEN contains(text, 'hehely') THEN 1 ELSE 0 END AS jar FROM documents),
s AS (SELECT doc_id, w, contacts, price, coalesce(list_max(w), 0)::DOUBLE + 0.4::DOUBLE * (coalesce(list_sum(w), 0) - coalesce(list_max(w), 0)) + least(contacts, 3) * 6 + CASE WHEN price THEN 8 ELSE 0 END + least(inq, 10) * 2 + scam * 5 + least(jar, 5) * 2 AS t FROM h)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    weights = F.transform(text.matched_words(t, ["thatin", "ononst", "thing"]), lambda k: F.when(k == "thatin", 30).when(k == "ononst", 20).otherwise(10))
    parts = table(spark, d, "documents").select("doc_id", weights.alias("w"), F.size(F.regexp_extract_all(t, F.lit("([A-Za-z0-9.]+@[A-Za-z0-9.]+)"))).alias("contacts"), t.rlike(r"\d").alias("price"), (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).alias("inq"), t.contains("stupid").cast("int").alias("scam"), t.contains("hehely").cast("int").alias("jar"))
    return parts.withColumn("risk", values.risk_score(F.col("w"), F.col("contacts"), F.col("price"), F.col("inq"), F.col("scam"), F.col("jar")))


@query("risk_score", _SCORE + " SELECT doc_id, CAST(least(round_even(2.2::DOUBLE * t, 0), 100) AS INTEGER) AS risk FROM s")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "risk")


@query("risk_tags", _SCORE + " SELECT doc_id, array_to_string(list_filter([CASE WHEN len(w) > 0 THEN 'category' END, CASE WHEN contacts > 0 THEN 'contact' END, CASE WHEN price THEN 'price' END], lambda x: x IS NOT NULL), ',') AS tags FROM s")
def risk_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = values.labels_of({"category": F.size("w") > 0, "contact": F.col("contacts") > 0, "price": F.col("price")})
    return _scored(spark, d).select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("risk_buckets", _SCORE + " SELECT CASE WHEN r >= 70 THEN 'high' WHEN r >= 40 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM (SELECT least(round_even(2.2::DOUBLE * t, 0), 100) AS r FROM s) GROUP BY 1")
def risk_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy(values.risk_level(F.col("risk")).alias("level")).agg(F.count("*").alias("n"))


@query("category_match", "SELECT doc_id, c AS category FROM documents, (VALUES ('a', 'thatin'), ('a', 'ononst'), ('b', 'thing')) v(c, k) WHERE contains(lower(text), k) GROUP BY ALL")
def category_match(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    found = F.array_compact(F.array(*[F.when(text.contains_any(t, w), F.lit(c)) for c, w in {"a": ["thatin", "ononst"], "b": ["thing"]}.items()]))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("category"))


@query("topk_terms", "SELECT term, count(*) AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS platforms FROM (SELECT doc_id, lang, unnest(list_filter(['thatin', 'ononst', 'thing', 'x'], lambda k: contains(lower(text), k))) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1")
def topk_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = docs.select(F.col("doc_id").alias("record_id"), F.col("lang").alias("platform"), F.col("source").alias("category"), F.explode(text.matched_words(F.col("text"), ["thatin", "ononst", "thing", "x"])).alias("term"), "text").withColumns({"type": F.lit("word"), "excerpt": text.excerpt(F.lower("text"), F.col("term"))}).drop("text")
    return aggregate.term_roll_up(hits).select("term", "n", F.array_join("platforms", ",").alias("platforms"))


@query("phone_email_extract", "SELECT doc_id, m AS email FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z.]+[a-z]'))) AS m FROM documents)")
def phone_email_extract(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z.]+[a-z])"), 1))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("email"))


_PRICED = "p_name || ' ¥' || p_size || ' per box and ' || p_brand || ' 12元 a unit'"


@query("price_unit_proximity", "SELECT p_partkey, unnest([CAST(p_size AS DOUBLE), 12.0::DOUBLE]) AS amount, unnest(['box', CASE WHEN 9 + length(p_brand) <= 25 THEN 'box' ELSE 'unit' END]) AS near_unit FROM part")
def price_unit_proximity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(extract.prices(F.expr(_PRICED), ["unit", "box"])).alias("p")).select("p_partkey", "p.*")


@query("truncated_middle", "SELECT doc_id, md5(CASE WHEN n <= 500 THEN text ELSE left(text, k // 2) || chr(10) || '... [middle truncated: ' || (n - k) || ' chars skipped] ...' || chr(10) || right(text, k - k // 2) END) AS h FROM (SELECT *, 500 - length(chr(10) || '... [middle truncated: ' || n || ' chars skipped] ...' || chr(10)) AS k FROM (SELECT *, length(text) AS n FROM documents))")
def truncated_middle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncated_middle(F.col("text"), 500)).alias("h"))


@query("truncated_head", "SELECT doc_id, md5(CASE WHEN n <= 300 THEN text ELSE left(text, k) || chr(10) || '... [truncated: showing first ' || k || ' of ' || n || ' chars. Use start_line/end_line to read a specific range] ...' END) AS h FROM (SELECT *, 300 - length(chr(10) || '... [truncated: showing first ' || n || ' of ' || n || ' chars. Use start_line/end_line to read a specific range] ...') AS k FROM (SELECT *, length(text) AS n FROM documents))")
def truncated_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncated_head(F.col("text"), 300)).alias("h"))


@query("reply_arrays", "SELECT doc_id, doc_id AS id FROM documents")
def reply_arrays(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit('```json\nHere it is: [{"id": '), F.col("doc_id").cast("string"), F.lit('}, "x]"] done\n```'))
    found = F.from_json(text.first_array(reply), "array<string>")
    return table(spark, d, "documents").select("doc_id", F.get_json_object(found[0], "$.id").cast("long").alias("id"))


@query(
    "contact_window",
    """WITH p AS (SELECT doc_id, text, string_split_regex(text, '(?i)token') AS s FROM documents),
       w AS (SELECT doc_id, unnest(list_transform(range(1, len(s)), lambda i: regexp_extract(substr(text, 1 + CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) AS BIGINT) + 5 * i, 40), '[0-9a-f]{16,}'))) AS value FROM p WHERE len(s) > 1)
       SELECT DISTINCT doc_id, 'token' AS type, value FROM w WHERE value <> '' UNION ALL SELECT DISTINCT doc_id, 'mail', unnest(regexp_extract_all(text, '[A-Za-z0-9_.]+@[A-Za-z0-9_.]+')) FROM documents""",
)
def contact_window(spark: SparkSession, d: str) -> DataFrame:
    found = extract.contacts(F.col("text"), {"token": (["token"], r"[0-9a-f]{16,}"), "mail": ([], r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+")})
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


@query("identifier_and_cells", "SELECT page_id, CASE WHEN regexp_matches(n, '^\\d') THEN 't_' || n ELSE n END AS name, replace(url, '|', '\\|') AS cell FROM (SELECT page_id, url, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS n FROM pages)")
def identifier_and_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.sanitize_identifier(F.col("url")).alias("name"), text.markdown_cell(F.col("url")).alias("cell"))


@query("epoch_and_iso", "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def epoch_and_iso(spark: SparkSession, d: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", values.epoch_text(millis).alias("at"))


@query("tag_index", "SELECT tag, n, CAST(rank AS INTEGER) AS rank, post FROM (SELECT lang AS tag, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rank, doc_id AS post FROM documents)")
def tag_index(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "documents").select("doc_id", F.array("lang").alias("tags"))
    return aggregate.tag_index(posts, "tags", "doc_id", "doc_id")

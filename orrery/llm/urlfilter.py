"""URL verdicts: fixed host and path rules first, then association rules that FP-growth mines from labelled URLs.

A rule says that URLs with some tokens are blocked, or that they are allowed. Rules are pruned by support, confidence and redundancy,
and matched through an inverted index from each rule's rarest token; of those that match, the most confident decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared_table, without

#: Host and path rules (fixed values).
FIXED_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: The items that stand for the label in a transaction, by verdict; no token starts so.
LABELS = {"block": "= block", "allow": "= allow"}


@dataclass(frozen=True)
class Params:
    """Least share and least number of the labelled URLs that hold a rule's tokens and its label; least confidence of a rule that blocks;
    by how much a rule's confidence must exceed the share of its label (times `lift` for rules that block); and a rule's most tokens.
    Up to `literal_rules` rules become one literal index, more are joined."""

    support: float = 0.002
    least_urls: int = 25
    confidence: float = 0.3
    lift: float = 1.5
    most_tokens: int = 4
    literal_rules: int = 2000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path, both empty without `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    after = F.when(F.instr(text, "://") > 0, F.regexp_extract(text, r"(?s)://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = FIXED_RULES) -> Column:
    """The longest rule that fits (struct of rule and verdict), or null."""
    chosen = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels and their words, path words, file endings, names in the query; numbers are
    one token each kind of place."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    number = lambda c: F.regexp_replace(c, r"\d+", "0")
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), number(x)))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            tag("scheme", F.array(F.regexp_extract(text, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
            tag("host", F.split(host, r"[.:]")),
            tag("word", F.flatten(F.transform(F.filter(F.split(host, r"[.:]"), lambda x: x.rlike("[_-]")), lambda x: F.split(x, "[_-]")))),
            tag("path", F.split(F.lower(path), "/")),
            tag("ending", F.array(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))),
            tag("query", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))),
            tag("fragment", F.array(F.when(text.contains("#"), F.lit("any")).otherwise(F.lit("")))),
        )
    )


def _tokenised(pages: DataFrame, url: str) -> DataFrame:
    host, path = url_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    return parts.withColumn("__tokens", url_tokens(F.col(url), F.col("host"), F.col("path")))


RULE = "tokens array<string>, verdict string, confidence double, support double"


def mine_rules(labelled: DataFrame, p: Params = Params(), url: str = "url", label: str = "blocked") -> DataFrame:  # noqa: B008
    """Rules (tokens, verdict, confidence, support) from URLs labelled true (block) or false (allow).

    A rule that blocks must reach `confidence` and `lift` times the share of blocked URLs; one that allows, more than the share of the
    others. A rule is dropped if another of the same verdict with some of its tokens is at least as confident. Null labels are left
    out, repeated rows count as often as they are there, null URLs have no tokens; no labelled rows: no rules.
    """
    known = without(labelled, "host", "path", "__tokens").where(F.col(label).isNotNull())
    rows = _tokenised(known.select(F.col(url).alias("url"), F.col(label).cast("boolean").alias("blocked")), "url")
    verdict = F.when(F.col("blocked"), F.lit(LABELS["block"])).otherwise(F.lit(LABELS["allow"]))
    items = shared_table(rows.select(F.monotonically_increasing_id().alias("row"), "__tokens", verdict.alias("label"), "blocked"), "transactions")
    total, blocked = items.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0))).first()
    if not total:
        return items.sparkSession.createDataFrame([], RULE)
    least = max(p.support, p.least_urls / total)
    classes = shared_table(_classes(items, least * total), "token_classes")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=min(max(p.confidence, p.lift * blocked / total), 1 - blocked / total, 1.0)).fit(_merged(items, classes))
    told = F.when(F.col("consequent")[0] == LABELS["block"], "block").when(F.col("consequent")[0] == LABELS["allow"], "allow")
    rules = model.associationRules.select(F.array_sort("antecedent").alias("tokens"), told.alias("verdict"), "confidence", "support").where("verdict IS NOT NULL")
    good = ((F.col("verdict") == "block") & (F.col("confidence") >= max(p.confidence, p.lift * blocked / total))) | ((F.col("verdict") == "allow") & (F.col("confidence") > 1 - blocked / total))
    labels = F.array(*[F.lit(x) for x in LABELS.values()])
    plain = (F.size("tokens") <= p.most_tokens) & ~F.arrays_overlap("tokens", labels) & (F.col("support") >= least)
    rules = shared_table(rules.where(good & plain), "rules")
    # only a rule that holds one of its tokens can be within another, so the pairs meet on tokens
    each = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("t"))
    inside = (
        each.alias("l")
        .join(rules.select("tokens", "verdict", "confidence", F.col("tokens")[0].alias("t")).alias("s"), ["t", "verdict"])
        .where((F.size("s.tokens") < F.size("l.tokens")) & (F.size(F.array_except("s.tokens", "l.tokens")) == 0) & (F.col("s.confidence") >= F.col("l.confidence")))
        .select(F.col("l.tokens").alias("tokens"), "verdict")
        .distinct()
    )
    kept = rules.join(inside, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")
    return shared_table(_expanded(kept, classes, p.most_tokens), "pruned_rules")


def _classes(items: DataFrame, least: float) -> DataFrame:
    """(t, rep): the tokens of at least so many URLs, each with the first of those that stand in exactly the same URLs.

    Tokens of one class tell the same, so the mining sees one of them: a part of a path that always brings others along would else double
    the itemsets with each.
    """
    row = lambda seed: F.bit_xor(F.xxhash64("row", F.lit(seed)))
    covers = items.select("row", F.explode("__tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), row(1).alias("x"), row(2).alias("y")).where(F.col("n") >= least)
    first = covers.groupBy("n", "x", "y").agg(F.min("t").alias("rep"))
    return covers.join(first, ["n", "x", "y"]).select("t", "rep")


def _merged(items: DataFrame, classes: DataFrame) -> DataFrame:
    """The transactions: of each URL the first tokens of its frequent tokens' classes, and its label."""
    found = items.select("row", F.explode("__tokens").alias("t")).join(classes.where("t = rep"), "t").groupBy("row").agg(F.collect_set("rep").alias("reps"))
    return items.join(found, "row", "left").select(F.concat(F.coalesce("reps", F.array().cast("array<string>")), F.array("label")).alias("items"))


def _expanded(rules: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The rules with each token of a class in its first one's place: those that mining all tokens gives, as of two tokens of a class one
    is always enough."""
    members = classes.groupBy("rep").agg(F.collect_list("t").alias("members"))
    out = rules.withColumn("whole", F.array().cast("array<string>"))
    for k in range(most):
        own = members.withColumnsRenamed({"rep": f"rep{k}", "members": f"members{k}"})
        out = out.join(own, F.get("tokens", F.lit(k)) == F.col(f"rep{k}"), "left").withColumn("t", F.explode_outer(f"members{k}"))
        out = out.withColumn("whole", F.when(F.col("t").isNull(), F.col("whole")).otherwise(F.array_append("whole", F.col("t")))).drop("t", f"rep{k}", f"members{k}")
    return out.select(F.array_sort("whole").alias("tokens"), "verdict", "confidence", "support")


def _index(rules: DataFrame) -> DataFrame:
    """key -> rules: each rule under the token of it that the fewest rules have."""
    uses = rules.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    whole = F.struct("tokens", "verdict", "confidence", "support")
    keyed = rules.select(whole.alias("rule"), F.explode("tokens").alias("t")).join(uses, "t").groupBy("rule").agg(F.min(F.struct("n", "t"))["t"].alias("key"))
    return keyed.groupBy("key").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def judge_urls(pages: DataFrame, rules: DataFrame, p: Params = Params(), url: str = "url") -> DataFrame:  # noqa: B008
    """Add host, path, rule (the fixed rule that decides, else null), mined (the mined rules that match, the one that decides first) and
    verdict.

    Without a fixed rule, the most confident mined rule decides (of equals that of more support, then one that blocks); without any,
    a URL is allowed. Null and malformed URLs have empty host and path and no tokens but their own parts. Repeated rows are judged
    alike, an empty table gives no rows; columns with these names are replaced, all others kept.
    """
    base = without(pages, "host", "path", "rule", "mined", "verdict", "__tokens", "__row")
    rows = _tokenised(base, url)
    matches = lambda found: F.filter(found, lambda r: F.size(F.array_except(r["tokens"], F.col("__tokens"))) == 0)
    none = F.array().cast(f"array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>")
    index = shared_table(_index(rules), "rule_index")
    size = index.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]
    if size <= p.literal_rules:
        held = {r["key"]: r["rules"] for r in index.collect()}
        if held:
            literal = lambda r: F.struct(F.array(*[F.lit(t) for t in r["tokens"]]).alias("tokens"), F.lit(r["verdict"]).alias("verdict"), F.lit(r["confidence"]).alias("confidence"), F.lit(r["support"]).alias("support"))
            table = F.create_map(*[x for k, v in sorted(held.items()) for x in (F.lit(k), F.array(*[literal(r) for r in v]))])
            found = F.flatten(F.transform("__tokens", lambda t: F.coalesce(table[t], none)))
        else:
            found = none
        rows = rows.withColumn("mined", matches(found))
    else:
        rows = shared_table(rows.withColumn("__row", F.monotonically_increasing_id()), "tokenised")
        hits = rows.select("__row", "__tokens", F.explode("__tokens").alias("key")).join(index, "key").withColumn("hit", matches(F.col("rules"))).where(F.size("hit") > 0)
        rows = rows.join(hits.groupBy("__row").agg(F.flatten(F.collect_list("hit")).alias("mined")), "__row", "left").withColumn("mined", F.coalesce("mined", none))
    # by confidence, support and verdict, from the greatest down
    ranked = F.sort_array(F.transform("mined", lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), r["verdict"].alias("verdict"), r["tokens"].alias("tokens"))), asc=False)
    rows = rows.withColumns({"mined": ranked, "__rule": fixed_rule(F.col("host"), F.col("path"))})
    verdict = F.coalesce(F.col("__rule.verdict"), F.get("mined", F.lit(0))["verdict"], F.lit("allow"))
    return rows.select(*[F.col(f"`{c}`") for c in base.columns], "host", "path", F.col("__rule.rule").alias("rule"), "mined", verdict.alias("verdict"))

"""Facts of reports: counters, groups, merged terms, sellers, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import values
from orrery.operators import aggregate, graph

#: What a term that only a model found is, until something better is known (fixed value).
MODEL_TERM = "模型提取黑话"
#: What records without a platform or group are listed under (fixed values).
NO_PLATFORM, NO_GROUP = "unknown", "(未知来源)"


def counters(records: DataFrame, lists: dict[str, Column], top: dict[str, int] = {}) -> DataFrame:  # noqa: B006
    """(kind, value, n): how many records have each value of each kind, given as arrays; blanks are left out. One pass counts all
    kinds; those in `top` are cut to their most frequent values."""
    of = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))
    pairs = [F.transform(F.array_distinct(each), of(kind)) for kind, each in lists.items()]
    counts = records.select(F.explode(F.concat(*pairs)).alias("e")).select("e.*").where("value != ''").groupBy("kind", "value").agg(F.count("*").alias("n"))
    if not top:
        return counts
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in top.items()])
    return counts.withColumn("__r", rank).where(most.isNull() | (F.col("__r") <= most)).drop("__r")


def overview(records: DataFrame) -> DataFrame:
    """The counters of a collection (categories as a map, platforms, ip, keyword, risk, time as text): by category, platform, ip (ten),
    keyword, risk level and day."""
    one = lambda c: F.array(F.coalesce(c, F.lit("")))
    return counters(
        records,
        {"category": F.map_keys("categories"), "platform": F.col("platforms"), "ip": one(F.col("ip")), "keyword": one(F.col("keyword")), "risk": one(values.risk_level(F.col("risk"))), "day": one(F.left("time", F.lit(10)))},
        {"ip": 10},
    )


def report_groups(records: DataFrame, order: str) -> DataFrame:
    """Records (source_platform, source_group, source_group_url, risk_level) by platform and group: the first web address that isn't
    blank, counts by level and in all, groups with most of high risk first."""
    name = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    level = F.lower("risk_level")
    url = F.when(F.coalesce(F.col("source_group_url"), F.lit("")) != "", F.struct(F.col(order), F.col("source_group_url").alias("u")))
    groups = records.groupBy(name("source_platform", NO_PLATFORM).alias("platform"), name("source_group", NO_GROUP).alias("name")).agg(
        F.coalesce(F.min(url)["u"], F.lit("")).alias("group_url"), *[F.count_if(level == x).alias(x) for x in ("high", "medium", "low")], F.count("*").alias("n")
    )
    return groups.orderBy(F.desc("high"), F.desc("n"), "platform", "name")


def report_facts(records: DataFrame, k: int = 20, first: str | None = None, last: str | None = None, platform: str | None = None) -> dict[str, DataFrame]:
    """The frames of a report over records (day, source_platform, source_group, risk_type, risk_level, entities as JSON), of some days
    and one platform: trends, top groups, heat by type, top entities."""
    rows = aggregate.between_days(records, "day", first, last, source_platform=platform)
    return {
        "trends": aggregate.trends(rows, ("day", "risk_level"), ("day",), ("risk_level",)),
        "top_groups": aggregate.top_groups(rows, "source_group", F.lower("risk_level") == "high", k),
        "keyword_heat": rows.groupBy("risk_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "risk_type").limit(k),
        "top_entities": aggregate.entity_top(rows, "entities", ["accounts", "contacts", "links", "tools", "prices"], k),
    }


def merge_terms(known: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """The roll-up (term, n, type, platforms, categories) with terms that a model found (position, term, type, note_id) in records
    (note_id, platforms, categories): each adds one, and its record's platforms and categories. A type that only says that a model
    found the term gives way to the first other one. Terms of one character are left out; most frequent first, then by categories."""
    each = found.withColumn("term", F.trim("term")).where(F.length("term") >= 2).join(records.select("note_id", "platforms", "categories"), "note_id", "left")
    better = F.when(F.coalesce(F.col("type"), F.lit("")).isin("", MODEL_TERM), None).otherwise(F.struct("position", F.col("type").alias("t")))
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    new = each.groupBy("term").agg(F.count("*").alias("m"), F.min(better)["t"].alias("u"), union("platforms").alias("ps"), union("categories").alias("cs"))
    kind = F.when(F.col("type").isNull() | (F.col("type") == MODEL_TERM), F.coalesce("u", "type", F.lit(MODEL_TERM))).otherwise(F.col("type"))
    none = F.array().cast("array<string>")
    merged = lambda a, b: F.sort_array(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))).alias(a)
    out = known.join(new, "term", "full").select("term", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), kind.alias("type"), merged("platforms", "ps"), merged("categories", "cs"))
    return out.orderBy(F.desc("n"), F.desc(F.size("categories")), "term")


def seller_features(listings: DataFrame, order: str, segments: int = 8, least: int = 6) -> DataFrame:
    """Of each seller (rows seller, area, segment as an array, image_fp, template, title, link): how many listings, the most frequent
    area, image and template (of at least `least` letters), the first segments, all templates, the first title and link."""
    rows = listings.where(F.coalesce(F.trim("seller"), F.lit("")) != "")
    long = rows.withColumn("template", F.when(F.length("template") >= least, F.col("template"))).withColumn("image_fp", F.nullif("image_fp", F.lit("")))
    first = F.min(F.struct(order, "title", "link"))
    own = long.groupBy("seller").agg(
        F.count("*").alias("n"),
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("segment")))), 1, segments).alias("segments"),
        F.sort_array(F.collect_set("template")).alias("templates"),
        F.left(first["title"], F.lit(80)).alias("first_title"),
        first["link"].alias("first_link"),
    )
    for c in ("area", "image_fp", "template"):
        own = own.join(graph.modal(long, "seller", c), "seller", "left")
    return own


def super_groups(members: DataFrame, group: str, component: str, name: str, size: str, names: int = 8) -> DataFrame:
    """Of each component of groups: how many groups, the sum of their sizes, the first names, the largest first."""
    out = members.groupBy(component).agg(F.count(group).alias("n_groups"), F.sum(size).alias("members"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct(group, F.col(name).alias("x")))), lambda s: s["x"]), 1, names).alias("names"))
    return out.orderBy(F.desc("n_groups"), component)


def funnel(stages: DataFrame) -> DataFrame:
    """Stages (position, stage, n) with their share of the first and of the one before, in per cent."""
    w = Window.orderBy("position")
    return stages.select("position", "stage", "n", values.percentage(F.col("n"), F.first("n").over(w)).alias("of_first"), F.when(F.lag("n").over(w).isNotNull(), values.percentage(F.col("n"), F.lag("n").over(w))).alias("of_before"))


def demand_signals(comments: Column, words: list[str], samples: int = 5) -> Column:
    """How many comments (structs with content) hold a word, and the first of them."""
    listed = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    hits = F.filter(comments, lambda c: F.exists(listed, lambda w: F.coalesce(c["content"].contains(w), F.lit(False))))
    return F.struct(F.when(hits.isNull(), 0).otherwise(F.size(hits)).alias("inquiries"), F.slice(hits, 1, samples).alias("samples"))


#: Categories that are of high risk by themselves, and the names of the tags (fixed values).
HIGH_CATEGORIES = ("资金洗钱", "赌博诈骗", "违规技术")
TAGS = ("已露出联系方式", "明码标价", "反诈伪装话术", "高需求热度", "评论区导流", "高危业务类目", "批量铺量")


def risk_tags(contacts: Column, prices: Column, scams: Column, inquiries: Column, categories: Column, near_duplicates: Column) -> Column:
    """The tags that hold of a record, in their order; counts are numbers, categories an array."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    n = F.coalesce(inquiries, F.lit(0))
    high = F.coalesce(F.arrays_overlap(categories, F.array(*[F.lit(c) for c in HIGH_CATEGORIES])), F.lit(False))
    return values.labels_of(dict(zip(TAGS, (some(contacts), some(prices), some(scams), n >= 5, n >= 3, high, some(near_duplicates)), strict=True)))

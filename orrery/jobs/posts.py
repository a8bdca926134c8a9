"""The job over collected posts: load, clean, extract by a lexicon, cluster, report.

Every step is a DataFrame kept by steps.run_job(), so that a job that was cut short, or that gets another threshold, makes only what
depends on it. Counts of all steps make one funnel.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import extract, text, values
from orrery.jobs.steps import Result, Step, files_key, read_text, run_job, write_text
from orrery.operators import aggregate, graph, reports, similarity
from orrery.sources import files, sinks

#: The fields of a post as collected (fixed names); others are not read.
POST = (
    "note_id string, platform string, source_keyword string, publish_time string, link string, author struct<user_id:string,nickname:string,ip_location:string>, "
    "content struct<title:string,`desc`:string>, stats struct<liked_count:string,collected_count:string,comment_count:string,share_count:string>, "
    "comments array<struct<user:string,content:string,like_count:string>>, involved_user_ids array<string>, _source_files array<string>"
)
STATS = ("liked_count", "collected_count", "comment_count", "share_count")


@dataclass(frozen=True)
class Lexicon:
    """Word lists and patterns of the extraction. Patterns must mean the same to Java; an amount is a money pattern's first group."""

    replacements: dict[str, str]
    categories: dict[str, tuple[float, list[str]]]
    platforms: dict[str, list[str]]
    jargon: list[str]
    money: str
    unit: str
    contacts: dict[str, tuple[list[str], str]]
    demand: list[str]
    disguise: list[str]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lexicon:
        """Read a lexicon in JSON; entries named _comment are left out."""
        told = read_text(spark, path)
        if told is None:
            raise ValueError(f"no lexicon at {path}")
        d = json.loads(told)
        own = lambda k: {n: v for n, v in d.get(k, {}).items() if n != "_comment"}
        prices = own("price_patterns")
        return cls(
            own("obfuscation_map"),
            {n: (float(c["weight"]), list(c["keywords"])) for n, c in own("business_categories").items()},
            own("platforms"),
            list(d.get("platform_jargon", [])),
            prices.get("money_regex", "(?!)()"),
            prices.get("unit_regex", "(?!)"),
            {n: ([] if n == "phone" else list(c["trigger_words"]), c["id_regex"]) for n, c in own("contact_patterns").items()},
            list(own("demand_signal_keywords").get("keywords", [])),
            list(own("scam_disguise_keywords").get("keywords", [])),
        )


def load(spark: SparkSession, path: str) -> DataFrame:
    """Posts of all JSON files below a path, with row (their number), cleaned title, desc and full_text, and engagement."""
    raw = files.json_documents(spark, path, spark.createDataFrame([], POST).schema)
    title, desc = F.coalesce(F.col("content.title"), F.lit("")), F.coalesce(F.col("content.desc"), F.lit(""))
    engagement = sum((text.count_zeros(F.regexp_replace(F.coalesce(F.col(f"stats.{c}"), F.lit("0")), r"\+", "")) for c in STATS), F.lit(0).cast("long"))
    return raw.select(
        F.monotonically_increasing_id().alias("row"),
        *[c for c in raw.columns if c not in ("source_file", "_source_files")],
        F.coalesce("_source_files", F.array("source_file")).alias("source_files"),
        text.normalize_text(title).alias("title"),
        text.normalize_text(desc).alias("desc"),
        text.normalize_text(F.concat(title, F.lit(" "), desc)).alias("full_text"),
        engagement.alias("engagement"),
    )


def once(posts: DataFrame) -> DataFrame:
    """The post of each note_id with the most engagement (of equals the first), with the files of all; posts without an id stay."""
    named = posts.where(F.coalesce("note_id", F.lit("")) != "")
    sources = named.groupBy("note_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("source_files")))).alias("source_files"))
    best = named.groupBy("note_id").agg(F.min(F.struct((-F.col("engagement")).alias("e"), "row"))["row"].alias("row"))
    kept = named.drop("source_files", "note_id").join(best, "row").join(sources, "note_id").select(*posts.columns)
    return kept.unionByName(posts.where(F.coalesce("note_id", F.lit("")) == ""))


def clean(posts: DataFrame, similarity_least: float) -> DataFrame:
    """Each post once, and of posts with similar texts that with the most engagement, with the ids of those that it stands for.

    Texts are compared by their character 3-grams; a post goes if one that stays, with more engagement (or read before it), is similar.
    """
    single = once(posts)
    key = F.coalesce(F.nullif("full_text", F.lit("")), F.col("content.desc"), F.lit(""))
    graph.ensure_checkpoints(posts.sparkSession)
    texts = single.select("row", key.alias("text")).checkpoint()  # they are read several times
    pairs = similarity.similar_pairs(texts, "row", text.fingerprint(F.col("text")), similarity_least)
    told = similarity.greedy_keep(pairs, single.select(F.col("row").alias("id"), F.struct((-F.col("engagement")).alias("e"), "row").alias("rank")))
    gone = told.where(~F.col("kept")).join(single.select(F.col("row").alias("id"), "note_id"), "id")
    copies = gone.groupBy(F.col("kept_by").alias("row")).agg(F.sort_array(F.collect_list("note_id")).alias("near_duplicates"), F.count("*").alias("near_duplicate_count"))
    kept = single.join(told.where("kept").select(F.col("id").alias("row")), "row")
    return kept.join(copies, "row", "left").withColumns({"near_duplicates": F.coalesce("near_duplicates", F.array().cast("array<string>")), "near_duplicate_count": F.coalesce("near_duplicate_count", F.lit(0).cast("long"))})


def clean_counts(posts: DataFrame, kept: DataFrame) -> dict[str, int]:
    raw = posts.agg(F.count("*").alias("raw"), F.count_distinct(F.nullif("source_keyword", F.lit(""))).alias("k"), F.count_distinct(F.nullif("note_id", F.lit(""))).alias("ids"), F.count_if(F.coalesce("note_id", F.lit("")) == "").alias("none")).first()
    n, removed = kept.agg(F.count("*"), F.coalesce(F.sum("near_duplicate_count"), F.lit(0))).first()
    return {"raw": raw["raw"], "after_id_dedup": raw["ids"] + raw["none"], "near_dup_removed": removed, "kept": n, "dedup_removed": raw["raw"] - n, "source_keywords": raw["k"]}


def extract_records(posts: DataFrame, lexicon: dict) -> DataFrame:
    """Records of the posts with a category: categories, platforms, jargon, prices, contacts, demand, disguise, risk and its tags."""
    lex = Lexicon(**lexicon)
    comments = F.coalesce("comments", F.expr("array()").cast("array<struct<user:string,content:string,like_count:string>>"))
    said = F.filter(F.transform(comments, lambda c: c["content"]), lambda x: F.coalesce(x, F.lit("")) != "")
    whole = F.array_join(F.filter(F.concat(F.array("full_text"), said), lambda x: x != ""), "\n")
    df = posts.withColumn("body", text.fold_replacements(whole, lex.replacements))
    body = F.col("body")
    words = lambda listed, ignore_case=True: F.sort_array(F.array_distinct(text.matched_words(body, listed, ignore_case)))
    each = [F.struct(F.lit(n).alias("category"), F.lit(float(w)).alias("weight"), words(ws).alias("matched")) for n, (w, ws) in lex.categories.items()]
    none = "array<struct<category:string,weight:double,matched:array<string>>>"
    categories = F.filter(F.array(*each), lambda c: F.size(c["matched"]) > 0) if each else F.array().cast(none)
    platforms = F.sort_array(F.array_compact(F.array(*[F.when(text.contains_any(body, ws), F.lit(n)) for n, ws in lex.platforms.items()]))) if lex.platforms else F.array().cast("array<string>")
    df = df.withColumn("found", categories).where(F.size("found") > 0)
    df = df.withColumns(
        {
            "biz_categories": F.map_from_entries(F.transform("found", lambda c: F.struct(c["category"], F.struct(c["weight"].alias("weight"), c["matched"].alias("matched"))))),
            "target_platforms": platforms,
            "prices": extract.amounts_near(body, lex.money, lex.unit),
            "contacts": extract.contacts(body, lex.contacts),
            "jargon_hits": words(lex.jargon, False),
            "scam_disguise": text.matched_words(body, lex.disguise, False),
            "demand_signals": reports.demand_signals(comments, lex.demand),
        }
    )
    n = lambda c: F.size(c)
    inquiries = F.col("demand_signals.inquiries")
    risk = values.risk_score(F.transform("found", lambda c: c["weight"]), n("contacts"), n("prices") > 0, inquiries, n("scam_disguise"), n("jargon_hits"))
    tags = reports.risk_tags(n("contacts"), n("prices"), n("scam_disguise"), inquiries, F.map_keys("biz_categories"), F.col("near_duplicate_count"))
    scaled = lambda c: text.count_scaled(F.col(f"stats.{c}")).alias(c.removesuffix("_count"))
    return df.select(
        "row", "note_id", "platform", "source_keyword", "publish_time", "link", "author", "title", F.left("desc", F.lit(160)).alias("desc_excerpt"), "biz_categories", "target_platforms", "prices",
        "contacts", "jargon_hits", "demand_signals", "scam_disguise", "near_duplicate_count", F.struct(*[scaled(c) for c in STATS]).alias("engagement"), "involved_user_ids", risk.alias("risk_score"), tags.alias("risk_tags"),
    )


def members(records: DataFrame, min_risk: int) -> DataFrame:
    """Records above `min_risk` (0: all) with their component: they share an author, a contact or an involved user.

    Each shared value links its records to the first of them, so that a value which a third of all records have makes as many links as
    it has records, and no pairs.
    """
    kept = records.where(F.col("risk_score") > min_risk) if min_risk > 0 else records
    value = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    author = F.when(F.coalesce("author.user_id", F.lit("")) != "", F.array(value("a", F.col("author.user_id")))).otherwise(F.array().cast("array<string>"))
    shared = F.concat(author, F.transform("contacts", lambda c: value("c", F.concat_ws(":", c["type"], c["value"]))), F.transform(F.coalesce("involved_user_ids", F.array().cast("array<string>")), lambda u: value("u", u)))
    each = kept.select("row", F.explode(F.array_distinct(shared)).alias("v")).where("v IS NOT NULL")
    first = each.groupBy("v").agg(F.min("row").alias("a"), F.max("row").alias("z")).where("a < z").select("v", "a")
    edges = each.join(first, "v").where("row <> a").select("a", F.col("row").alias("b")).distinct()
    found = graph.connected_components(edges).select(F.col("id").alias("row"), "component")
    return kept.join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))


def first_values(df: DataFrame, group: str, value: Column, most: int, name: str) -> DataFrame:
    """The first `most` distinct values of each group in their order, and how many there are (n_ and the name). Each task passes on no
    more than that of a group, so that a group of a third of all rows is never in one row."""
    each = df.select(group, value.alias(name)).where(F.coalesce(name, F.lit("")) != "").distinct()
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(name))).where(F.col("r") <= most)
    told = ranked.groupBy(group).agg(F.sort_array(F.collect_list(name)).alias(name))
    return told.join(each.groupBy(group).agg(F.count("*").alias(f"n_{name}")), group)


def clusters(found: DataFrame, min_peak_risk: int, top: int = 3, most: int = 50) -> DataFrame:
    """Clusters whose greatest risk is above `min_peak_risk`, numbered G001, ... from the one of most posts (of equals the most risky),
    with their most frequent categories and the first `most` of their authors, locations and contacts. Their posts are detail()'s."""
    own = found.groupBy("component").agg(F.count("*").alias("note_count"), F.max("risk_score").alias("max_risk"), F.sum("demand_signals.inquiries").alias("total_demand"))
    own = own.where(F.col("max_risk") > min_peak_risk)
    by = found.select("component", F.explode(F.map_keys("biz_categories")).alias("category")).groupBy("component", "category").agg(F.count("*").alias("n"))
    ranked = by.groupBy("component").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "category", "n"))), 1, top).alias("t"))
    own = own.join(ranked.select("component", F.transform("t", lambda t: F.struct(t["category"], t["n"])).alias("top_categories")), "component", "left")
    contact = found.select("component", F.explode("contacts").alias("c")).select("component", F.concat_ws(":", "c.type", "c.value").alias("c"))
    for name, values_of, value in (("authors", found, F.col("author.nickname")), ("ip_locations", found, F.col("author.ip_location")), ("shared_contacts", contact, F.col("c"))):
        own = own.join(first_values(values_of, "component", value, most, name), "component", "left")
        own = own.withColumns({name: F.coalesce(name, F.array().cast("array<string>")), f"n_{name}": F.coalesce(f"n_{name}", F.lit(0).cast("long"))})
    places = aggregate.places(own.withColumn("order", F.struct("note_count", "max_risk")), "order", "component")
    number = F.col("place").cast("string")
    return own.join(places, "component").withColumn("gang_id", F.concat(F.lit("G"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))).drop("place")


def detail(found: DataFrame, kept: DataFrame) -> DataFrame:
    """The records of the clusters that stay, with their cluster's number."""
    return found.join(kept.select("component", "gang_id"), "component")


def summary(records: DataFrame, gangs: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """What a report tells: levels of risk, categories, platforms, tags, keywords, places, prices' units, terms, clusters, riskiest posts."""
    top = lambda c: records.select(F.explode(c).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
    count = lambda c: records.where(F.coalesce(c, F.lit("")) != "").groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
    level = values.risk_level(F.col("risk_score"))
    return {
        "Risk levels": records.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 1).alias("mean_risk")).orderBy(F.desc("mean_risk")),
        "Categories": top(F.map_keys("biz_categories")),
        "Platforms": top(F.col("target_platforms")),
        "Tags": top(F.col("risk_tags")),
        "Jargon": top(F.col("jargon_hits")),
        "Contacts": top(F.transform("contacts", lambda c: c["type"])),
        "Keywords": count(F.col("source_keyword")),
        "Locations": count(F.col("author.ip_location")),
        "Clusters": gangs.select("gang_id", "note_count", "max_risk", "total_demand", "top_categories").orderBy("gang_id").limit(k),
        "Riskiest posts": records.select("note_id", "title", "risk_score", "gang_id").orderBy(F.desc("risk_score"), "note_id").limit(k),
    }


def steps(spark: SparkSession, lexicon: Lexicon, similarity_least: float = 0.92, min_risk: int = 50, min_peak_risk: int = 60) -> list[Step]:
    told = lambda name: lambda *tables: {name: tables[-1].count()}
    intel = lambda posts, records: {"input": posts.count(), "intel": records.count(), "noise_filtered": posts.count() - records.count()}
    return [
        Step("load", lambda raw: raw, ("files",), counts=told("raw")),
        Step("clean", clean, ("load",), {"similarity_least": similarity_least}, clean_counts),
        Step("extract", extract_records, ("clean",), {"lexicon": asdict(lexicon)}, intel),
        Step("members", members, ("extract",), {"min_risk": min_risk}, told("records")),
        Step("clusters", clusters, ("members",), {"min_peak_risk": min_peak_risk}, told("gangs")),
        Step("records", detail, ("members", "clusters"), {}, told("records")),
    ]


def funnel(results: dict[str, Result]) -> dict[str, int]:
    """The counts of all steps in one, as the report and its side-car have them."""
    c = {n: r.counts for n, r in results.items()}
    return {**c["clean"], "intel": c["extract"]["intel"], "noise_filtered": c["extract"]["noise_filtered"], "above_risk": c["members"]["records"], "gangs": c["clusters"]["gangs"], "records": c["records"]["records"]}


def run(spark: SparkSession, path: str, lexicon_path: str, out: str, similarity_least: float = 0.92, min_risk: int = 50, min_peak_risk: int = 60) -> tuple[dict[str, Result], dict[str, int]]:
    """Run the job over all JSON files below `path`; results, a report in Markdown, a page with the data and counts.json go below `out`."""
    lexicon = Lexicon.load(spark, lexicon_path)
    sources = {"files": (files_key(spark, path, "*.json"), lambda: load(spark, path))}
    results = run_job(spark, steps(spark, lexicon, similarity_least, min_risk, min_peak_risk), sources, f"{out}/steps")
    counts = funnel(results)
    told = summary(results["records"].table, results["clusters"].table)
    stages = spark.createDataFrame([(i, n, counts[n]) for i, n in enumerate(("raw", "after_id_dedup", "kept", "intel", "above_risk", "records"))], "position int, stage string, n long")
    told = {"Funnel": reports.funnel(stages), **told}
    write_text(spark, f"{out}/analysis_report.md", sinks.markdown_report("Posts", told))
    write_text(spark, f"{out}/dashboard.html", sinks.html_report("Posts", told))
    write_text(spark, f"{out}/counts.json", json.dumps(counts, ensure_ascii=False, indent=2))
    return results, counts

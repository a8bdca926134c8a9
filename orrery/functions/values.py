"""Column functions over times, JSON, scores and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_text(c: Column) -> Column:
    """Seconds or milliseconds since 1970 (over 10^12: milliseconds) as yyyy-MM-dd HH:mm:ss in the session's zone."""
    return F.date_format(F.timestamp_seconds(F.when(c > 10**12, F.floor(c / 1000)).otherwise(c)), "yyyy-MM-dd HH:mm:ss")


def coerce_iso(c: Column) -> Column:
    """A time in text, epoch seconds or ISO, as ISO in UTC; what can't be read stays."""
    as_time = F.when(c.rlike(r"^\d{10}(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double"))).otherwise(c.try_cast("timestamp"))
    return F.coalesce(F.date_format(as_time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


def mail_time(c: Column) -> Column:
    """A time like `Wed Oct 10 20:19:24 +0000 2018`, or an ISO one."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")), c.try_cast("timestamp"))


def day_of(name: Column, record_time: Column) -> Column:
    """The day in a file's name, else that of the record, else unknown."""
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(F.regexp_extract(record_time, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("unknown"))


def json_matches(document: Column, key: str, value: object) -> Column:
    """Whether a JSON object's key has a value of the same type: null only if it is there and null, true and false apart from
    numbers, a float also for whole numbers, a whole number only for whole numbers, text only for text."""
    if not key.replace("_", "").replace("-", "").isalnum():
        raise ValueError(f"not a plain key: {key}")
    at = F.variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    kind = F.schema_of_variant(at)
    whole, number = kind.isin("BIGINT"), kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    if value is None:
        out = kind == "VOID"
    elif isinstance(value, bool):
        out = (kind == "BOOLEAN") & (F.try_variant_get(F.try_parse_json(document), f"$.{key}", "boolean") == value)
    elif isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError("beyond 64 bits")
        out = whole & (F.try_variant_get(F.try_parse_json(document), f"$.{key}", "bigint") == value)
    elif isinstance(value, float):
        out = number & (F.try_variant_get(F.try_parse_json(document), f"$.{key}", "double") == value)
    elif not isinstance(value, str):
        raise TypeError(f"not a value of JSON: {type(value).__name__}")
    else:
        out = (kind == "STRING") & (F.try_variant_get(F.try_parse_json(document), f"$.{key}", "string") == str(value))
    return F.coalesce(out, F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0, default: float = 0.0) -> Column:
    """A number within bounds; null and what isn't a number become the default."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def percentage(part: Column, whole: Column) -> Column:
    """Per cent to one decimal; 0 of nothing."""
    return F.when(whole > 0, F.round(100 * part / whole, 1)).otherwise(F.lit(0.0))


def risk_score(weights: Column, contacts: Column, has_price: Column, inquiries: Column, scams: Column, jargon: Column) -> Column:
    """0 to 100: the greatest category weight and 0.4 of the others, contacts, prices, inquiries, scam words and jargon, each capped,
    times 2.2, rounded half to even."""
    ordered = F.sort_array(weights, asc=False)
    top = F.coalesce(F.get(ordered, F.lit(0)).cast("double"), F.lit(0.0))
    rest = F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), F.lit(0.0), lambda s, w: s + w * F.lit(0.4))
    total = top + rest + F.least(contacts, F.lit(3)) * 6 + F.when(has_price, 8).otherwise(0) + F.least(inquiries, F.lit(10)) * 2 + scams * 5 + F.least(jargon, F.lit(5)) * 2
    return F.least(F.bround(F.lit(2.2) * total, 0), F.lit(100.0)).cast("int")


def risk_level(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 40, "medium").otherwise("low")


def labels_of(conditions: dict[str, Column]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))


def ladder(level: Column, steps: Column) -> Column:
    """A level of high, medium, low, so many steps lower, at lowest low; unknown levels count as low."""
    at = F.when(level == "high", 1).when(level == "medium", 2).otherwise(3)
    return F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low")]), F.least(at + steps, F.lit(3)).cast("int"))


def probe_class(status: Column, previews: Column, key: Column) -> Column:
    """What a probe's reply says of a key: error, empty_reply, direct_hit (a preview's channel is it), indirect_hit, no_results."""
    return (
        F.when(status == "error", "error")
        .when(status == "empty", "empty_reply")
        .when(F.coalesce(F.exists(previews, lambda p: F.lower(p) == F.lower(key)), F.lit(False)), "direct_hit")
        .when(F.coalesce(F.size(previews), F.lit(0)) > 0, "indirect_hit")
        .otherwise("no_results")
    )


def needs_review(count: Column, reviewed_count: Column, reviewed_at: Column, now: Column, stale_days: int = 30, force: bool = False) -> Column:
    """Whether a candidate is to be reviewed: never was, is forced, is seen more than twice as often, or was long ago."""
    return F.lit(force) | reviewed_at.isNull() | (count > reviewed_count * 2) | (reviewed_at < now - F.make_dt_interval(F.lit(stale_days)))


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps' entries, the right ones winning; an empty right map clears; null leaves the left."""
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.when(right.isNull(), left).when(F.size(right) == 0, right).when(left.isNull(), right).otherwise(F.map_concat(kept, right))


def ordered_union(left: Column, right: Column) -> Column:
    """Items of both lists, each where it first is."""
    return F.array_distinct(F.concat(F.coalesce(left, F.array()), F.coalesce(right, F.array())))


#: Fields of a repository's summary and where its description has them (fixed values).
REPOSITORY = {
    "name": "full_name", "description": "description", "url": "html_url", "stars": "stargazers_count", "forks": "forks_count", "open_issues": "open_issues_count", "language": "language",
    "license": "license.spdx_id", "created_at": "created_at", "updated_at": "updated_at", "pushed_at": "pushed_at", "default_branch": "default_branch",
}


def repository_summary(info: Column, languages: Column, contributors: Column, releases: Column) -> Column:
    """A repository's summary from four JSON documents: its description, its languages, its contributors (how many) and its releases
    (the first is the latest)."""
    take = lambda c, k: F.get_json_object(c, f"$.{k}")
    numbers = ("stars", "forks", "open_issues")
    fields = [(take(info, at).try_cast("bigint") if name in numbers else take(info, at)).alias(name) for name, at in REPOSITORY.items()]
    first = lambda k: F.get_json_object(releases, f"$[0].{k}")
    latest = F.when(F.get_json_object(releases, "$[0]").isNotNull(), F.struct(first("tag_name").alias("tag"), first("name").alias("name"), first("published_at").alias("date")))
    return F.struct(
        *fields,
        F.coalesce(F.from_json(take(info, "topics"), "array<string>"), F.array().cast("array<string>")).alias("topics"),
        F.coalesce(F.from_json(languages, "map<string,bigint>"), F.create_map().cast("map<string,bigint>")).alias("languages"),
        F.json_array_length(contributors).alias("contributors"),
        latest.alias("latest_release"),
    )

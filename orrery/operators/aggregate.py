"""Summaries, roll-ups and rankings. Ties are always broken by value, ascending."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a bracket of values that one task sorts.
BRACKET = 100_000


@dataclass
class _Rank:
    """A rank (from 0) that is sought in a column: the open interval of values that holds it (None: no end), and how many of the column's
    rows lie before and in it."""

    column: int
    rank: int
    low: float | None
    high: float | None
    before: int
    rows: int

    def inside(self) -> Column:
        v = F.col(f"v{self.column}")
        out = v.isNotNull()
        for bound in [v > self.low] * (self.low is not None) + [v < self.high] * (self.high is not None):
            out &= bound
        return out


def _narrowed(values: DataFrame, ranks: list[_Rank], accuracy: int) -> dict[int, float]:
    """Narrow the intervals of the ranks by a sketch of what they hold; returns the values of those whose rank is at an end, by place.

    The sketch's values around the rank are the new ends. Rows below, at and between them are counted, so that a sketch which is off
    costs a further round and no more; the ends themselves leave the interval, so that each round makes it smaller.
    """
    margin = 2.0 / accuracy
    share = lambda r, k: F.lit(min(1.0, max(0.0, (r.rank - r.before + k) / r.rows + (2 * k - 1) * margin)))
    edges = values.agg(*[F.percentile_approx(F.when(r.inside(), F.col(f"v{r.column}")), F.array(share(r, 0), share(r, 1)), accuracy).alias(f"e{i}") for i, r in enumerate(ranks)]).first()
    counts = []
    for r, (low, high) in zip(ranks, edges, strict=True):
        v = F.col(f"v{r.column}")
        counts += [F.count_if(c & r.inside()) for c in (v < low, v == low, (v > low) & (v < high), (v == high) & (v > low))]
    told = values.agg(*counts).first()
    found = {}
    for i, (r, (low, high)) in enumerate(zip(ranks, edges, strict=True)):
        under, at_low, between, at_high = told[4 * i : 4 * i + 4]
        place = r.rank - r.before
        if place < under:
            r.high, r.rows = low, under
        elif place < under + at_low:
            found[i] = low
        elif place < under + at_low + between:
            r.low, r.high, r.before, r.rows = low, high, r.before + under + at_low, between
        elif place < under + at_low + between + at_high:
            found[i] = high
        else:
            r.low, r.before, r.rows = high, r.before + under + at_low + between + at_high, r.rows - under - at_low - between - at_high
    return found


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], most: int = BRACKET, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """The exact quantiles of numeric columns, interpolated between neighbours, by rank selection.

    Each rank that is sought has an interval of values, which sketches and counts narrow until it has `most` rows at most; one task then
    sorts those. So rows are read a few times, and no task holds more of a column than that, whatever the table's size and however its
    values are spread or repeated. Nulls are left out; a column without values has null quantiles. Values are compared as doubles.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    n = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    neighbours = lambda i, s: (int((n[i] - 1) * s), min(n[i] - 1, int((n[i] - 1) * s) + 1))
    ranks = [_Rank(i, k, None, None, 0, n[i]) for i in range(len(columns)) if n[i] for k in sorted({k for s in shares for k in neighbours(i, s)})]
    found: dict[tuple[int, int], float] = {}
    while wide := [r for r in ranks if r.rows > most]:
        ended = _narrowed(values, wide, accuracy)
        found |= {(wide[k].column, wide[k].rank): v for k, v in ended.items()}
        ranks = [r for r in ranks if (r.column, r.rank) not in found]
    if ranks:
        each = F.array_compact(F.array(*[F.when(r.inside(), F.struct(F.lit(j).alias("j"), F.col(f"v{r.column}").alias("v"))) for j, r in enumerate(ranks)]))
        by_value = values.select(F.explode(each).alias("x")).groupBy("x.j", "x.v").agg(F.count("*").alias("n"))
        place = F.element_at(F.array(*[F.lit(r.rank - r.before) for r in ranks]), F.col("j") + 1)
        up_to = by_value.withColumn("up_to", F.sum("n").over(Window.partitionBy("j").orderBy("v")))
        for r in up_to.where((F.col("up_to") > place) & (F.col("up_to") - F.col("n") <= place)).select("j", "v").collect():  # a row for each rank
            found[ranks[r["j"]].column, ranks[r["j"]].rank] = r["v"]

    def quantile(i: int, s: float) -> float | None:
        if not n[i]:
            return None
        low, high = (found[i, k] for k in neighbours(i, s))
        return low if low == high else low + (high - low) * ((n[i] - 1) * s - int((n[i] - 1) * s))

    return {c: [quantile(i, s) for s in shares] for i, c in enumerate(columns)}


def numeric_summary(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """One row for each column: count, nulls, mean, sample deviation, least, quartiles, greatest.

    Quartiles are exact, by rank selection (see exact_quantiles(): two or three more passes); with an `accuracy`, they come from a
    sketch in the same pass that is at most 1 / accuracy of the rows off in rank.
    """
    thirds = [0.25, 0.5, 0.75]
    exact = exact_quantiles(df, columns, thirds) if accuracy is None else {}

    def quartiles(c: str) -> Column:
        if accuracy is None:
            return F.array(*[F.lit(x).cast("double") for x in exact[c]])
        return F.percentile_approx(F.col(f"`{c}`").cast("double"), F.array(*map(F.lit, thirds)), accuracy)

    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(f"`{c}`").alias("n"),
            F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"),
            F.avg(f"`{c}`").alias("mean"),
            F.stddev_samp(f"`{c}`").alias("std"),
            F.min(F.col(f"`{c}`").cast("double")).alias("min"),
            quartiles(c).alias("q"),
            F.max(F.col(f"`{c}`").cast("double")).alias("max"),
        )
        for c in columns
    ]
    rows = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return rows.select("column", "n", "nulls", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")


def categorical_summary(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The most frequent values with their share of all rows (nulls counted in), and the column's distinct and null counts."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    best = counts.where(F.col("value").isNotNull()).orderBy(F.desc("n"), "value").limit(top)
    return best.join(F.broadcast(totals)).select(F.lit(column).alias("column"), "value", "n", F.round(100 * F.col("n") / F.col("n_rows"), 1).alias("percent"), "n_distinct", "nulls")


def non_null_counts(df: DataFrame) -> DataFrame:
    """Rows and non-null values of each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("non_null"), F.count("*").alias("n_rows")) for c in df.columns])
    return df.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def inspect(df: DataFrame, sample: int = 5) -> dict[str, object]:
    """Columns and types, counts and the first rows of a table."""
    counts = {r["column"]: (r["n_rows"], r["non_null"]) for r in non_null_counts(df).collect()}
    return {"columns": [{"name": n, "type": t, "non_null": counts[n][1]} for n, t in df.dtypes], "rows": next(iter(counts.values()), (0, 0))[0], "sample": [r.asDict(True) for r in df.limit(sample).collect()]}


def between_days(df: DataFrame, day: str, first: str | None = None, last: str | None = None, **equal: object) -> DataFrame:
    """Rows from day to day, both included, and equal in the columns named; what is None doesn't restrict."""
    conditions = [F.col(day) >= first] * (first is not None) + [F.col(day) <= last] * (last is not None) + [F.col(k) == v for k, v in equal.items() if v is not None]
    for c in conditions:
        df = df.where(c)
    return df


def trends(df: DataFrame, *dimensions: tuple[str, ...]) -> DataFrame:
    """Counts by several sets of columns and in all, in one pass with grouping sets; columns not in a set are null."""
    every = list(dict.fromkeys(c for d in dimensions for c in d))
    return df.groupingSets([[F.col(c) for c in d] for d in (*dimensions, ())], *every).agg(F.grouping_id().alias("set_id"), F.count("*").alias("n"))


def top_groups(df: DataFrame, group: str, condition: Column, limit: int) -> DataFrame:
    """Groups by how many rows meet a condition, then by rows."""
    return df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(condition).alias("n_met")).orderBy(F.desc("n_met"), F.desc("total"), group).limit(limit)


def top_per_group(df: DataFrame, group: list[str], value: str, k: int, n: str = "n") -> DataFrame:
    """The k most frequent values of each group, with their rank."""
    w = Window.partitionBy(*group).orderBy(F.desc(n), value)
    return df.groupBy(*group, value).agg(F.count("*").alias(n)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def entity_top(df: DataFrame, entities: str, buckets: list[str], k: int) -> DataFrame:
    """The most frequent entities in each bucket of a JSON object of values or lists of values; blanks and unreadable JSON are left out."""
    value = lambda b: F.get_json_object(entities, f"$.{b}")
    listed = lambda b: F.when(value(b).startswith("["), F.from_json(value(b), "array<string>")).otherwise(F.array(value(b)))
    each = df.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), listed(b).alias("v")) for b in buckets])).alias("e")).select("e.bucket", F.explode("e.v").alias("v")).select("bucket", F.trim("v").alias("value"))
    return top_per_group(each.where("value != ''"), ["bucket"], "value", k)


def roll_up_tokens(runs: DataFrame, statuses: list[str]) -> DataFrame:
    """Tokens and runs by model (null: unknown) and in all (model null), of runs in some statuses."""
    known = runs.where(F.col("status").isin(statuses)).withColumn("model", F.coalesce("model_name", F.lit("unknown")))
    return known.rollup("model").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("runs"))


def distinct_usage(events: DataFrame) -> DataFrame:
    """Token sums by kind of caller, each source run counted once; a missing total is input plus output."""
    once = events.dropDuplicates(["source_run_id"])
    caller = F.when(F.col("caller").startswith("subagent:"), "subagent").when(F.col("caller").startswith("middleware:"), "middleware").otherwise("lead")
    total = F.coalesce(F.nullif("total_tokens", F.lit(0)), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return once.groupBy(caller.alias("caller")).agg(F.sum(total).alias("tokens"))


def term_roll_up(hits: DataFrame, k: int = 3) -> DataFrame:
    """From hits (term, type, record_id, platform, category, excerpt): records, first type, platforms, categories and k excerpts a term;
    terms of one character are left out. Excerpts are ranked before they are gathered, so no term gathers more than k."""
    hits = hits.where(F.length("term") >= 2)
    counts = hits.groupBy("term").agg(F.count_distinct("record_id").alias("n"), F.min_by("type", "record_id").alias("type"), F.sort_array(F.collect_set("platform")).alias("platforms"), F.sort_array(F.collect_set("category")).alias("categories"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("record_id", "excerpt"))).where(F.col("r") <= k)
    return counts.join(ranked.groupBy("term").agg(F.sort_array(F.collect_list("excerpt")).alias("excerpts")), "term")


def reputation(records: DataFrame, group: str = "source_group", level: str = "risk_level") -> DataFrame:
    """High, medium and all records of each group; levels without regard to case, records without a group left out."""
    at = F.lower(level)
    return records.where(F.coalesce(F.col(group), F.lit("")) != "").groupBy(group).agg(F.count_if(at == "high").alias("high"), F.count_if(at == "medium").alias("medium"), F.count("*").alias("total"))


def merge_candidates(seen: DataFrame, known: DataFrame | None = None, sources: int = 3) -> DataFrame:
    """Candidates (key) from sightings (key, seen_at, source): count, first and last time, first sources; a known status stays."""
    order = Window.partitionBy("key").orderBy("seen_at", "source")
    first = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sources).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "source"))), lambda x: x["source"]).alias("sources"))
    new = seen.groupBy("key").agg(F.count("*").alias("count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")).join(first, "key").withColumn("status", F.lit("pending"))
    if known is None:
        return new
    a, b = new.alias("a"), known.alias("b")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    return a.join(b, "key", "full").select(
        "key",
        (F.coalesce("a.count", F.lit(0)) + F.coalesce("b.count", F.lit(0))).alias("count"),
        F.least("a.first_seen", "b.first_seen").alias("first_seen"),
        F.greatest("a.last_seen", "b.last_seen").alias("last_seen"),
        F.slice(F.concat(F.coalesce("b.sources", F.array().cast("array<string>")), F.coalesce("a.sources", F.array().cast("array<string>"))), 1, sources).alias("sources"),
        pick("status").alias("status"),
    )


def bench_stats(runs: DataFrame, config: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for one run), least and greatest of each configuration, to four decimals."""
    return runs.groupBy(config).agg(F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("stddev"), F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str], stratum: str | None = None) -> DataFrame:
    """Counts by row and column value, and each row's total; with a stratum, for each of its values and for all (null) in one pass."""
    groups = df.groupBy(row) if stratum is None else df.groupingSets([[F.col(stratum), F.col(row)], [F.col(row)]], stratum, row)
    return groups.agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def ngrams(df: DataFrame, text: str, sizes: tuple[int, ...] = (2, 3, 4), keep: str = r"[\x{4e00}-\x{9fff}]", least: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """Frequent character n-grams that a pattern is found in and no white space.

    So they lie within words: these are counted first, and a word is cut once, however often it is there. Of a place in a word only the
    longest gram is counted, as the shorter ones are its starts.
    """
    words = df.select(F.explode(F.split(text, r"\s")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    # each character and what follows it; as it is consumed, no place is within a character of two code units
    places = F.regexp_extract_all("word", F.lit(rf"(?s)(?=(.{{1,{max(sizes)}}}))."), 1)
    longest = words.select(F.explode(places).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    starts = F.array(*[F.when(F.length("gram") >= k, F.left("gram", F.lit(k))) for k in sizes])
    found = longest.select(F.explode(F.array_compact(starts)).alias("gram"), "n")
    counts = found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counts.where(F.col("gram").rlike(f"(?s)^.*{keep}.*$") & ~F.col("gram").isin(*stop, ""))


def variant_families(counts: DataFrame, top: int = 200, prefix: int = 2, members: int = 3) -> DataFrame:
    """Of the most frequent grams, the families that share a start and have enough members."""
    best = counts.orderBy(F.desc("n"), "gram").limit(top)
    return best.groupBy(F.left("gram", F.lit(prefix)).alias("stem")).agg(F.sort_array(F.collect_list("gram")).alias("members")).where(F.size("members") >= members)


def word_frequencies(df: DataFrame, text: str, stop: tuple[str, ...] = (), top: int = 20) -> DataFrame:
    words = df.select(F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word")).where((F.col("word") != "") & ~F.col("word").isin(*stop, ""))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def involved(df: DataFrame, *ids: Column) -> DataFrame:
    """Adds involved: all ids of some arrays, sorted, each once."""
    return df.withColumn("involved", F.sort_array(F.array_compact(F.array_distinct(F.concat(*ids)))))


def best_of(df: DataFrame, key: str, order: list[Column], merge: str | None = None) -> DataFrame:
    """The first row of each key by an order, with the union of an array column over the key's rows; rows without a key stay."""
    w = Window.partitionBy(key).orderBy(*order)
    keyed = df.where(F.col(key).isNotNull())
    ranked = keyed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    if merge:
        sets = keyed.select(key, F.explode_outer(merge).alias("x")).groupBy(key).agg(F.sort_array(F.collect_set("x")).alias(merge))
        ranked = ranked.drop(merge).join(sets, key).select(*df.columns)
    return ranked.unionByName(df.where(F.col(key).isNull()))


def tag_index(posts: DataFrame, tags: str, day: str, post: str, most: int | None = None) -> DataFrame:
    """(tag, n, rank, post): each tag's number of posts and its posts from the newest on, a row each; all, or the `most` newest."""
    each = posts.select(F.explode(F.array_distinct(tags)).alias("tag"), F.col(day).alias("__day"), F.col(post).alias("post"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("__day"), F.desc("post")))
    ranked = each.withColumn("rank", rank)
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return each.groupBy("tag").agg(F.count("*").alias("n")).join(ranked.drop("__day"), "tag").select("tag", "n", "rank", "post")


def places(df: DataFrame, by: str, key: str) -> DataFrame:
    """Adds place: 1, 2, ... by a column downwards, of equal values by key. Each value's rows are counted first, and only the values
    are ranked in one task; the column should have few of them, as scores have."""
    counts = df.groupBy(by).agg(F.count("*").alias("__n"))
    start = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    return ranked.join(counts.select(by, start.alias("__s")), by).select(key, (F.col("__s") + F.col("__r")).cast("int").alias("place"))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def summarise(df: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """The numeric summary of the numeric columns, and a categorical one for each other atomic column."""
    numbers = [f.name for f in df.schema if is_numeric(f.dataType)]
    others = [f.name for f in df.schema if not is_numeric(f.dataType) and not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType)]
    return numeric_summary(df, numbers) if numbers else None, [categorical_summary(df, c) for c in others]

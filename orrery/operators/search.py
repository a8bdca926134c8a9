"""Searches over stored rows: owners, typed metadata, states, catalogues, verdicts and thresholds."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text, values

#: Most entries that a catalogue search returns (fixed value).
CATALOGUE_ROWS = 5
#: Ranks of confidence (fixed values).
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def search_threads(threads: DataFrame, user: object = None, status: str | None = None, metadata: dict[str, object] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of threads (thread_id, user_id, status, metadata as JSON, updated_at), the last changed first, then by thread_id downwards.

    Without a user, all owners' threads are searched. A metadata key that isn't plain, or whose value has no JSON type, is left out
    with a warning; if that leaves none, ValueError names the keys.
    """
    if user is not None:
        threads = threads.where(F.col("user_id") == user)
    if status:
        threads = threads.where(F.col("status") == status)
    if metadata:
        applied = 0
        for key, value in metadata.items():
            try:
                threads = threads.where(values.json_matches(F.col("metadata"), key, value))
                applied += 1
            except (ValueError, TypeError) as e:
                warnings.warn(f"metadata filter {key!r} left out: {e}", stacklevel=2)
        if not applied:
            raise ValueError("no metadata key can be searched: " + ", ".join(sorted(map(str, metadata))))
    return threads.orderBy(F.desc("updated_at"), F.desc("thread_id")).offset(offset).limit(limit)


def check_access(requests: DataFrame, threads: DataFrame, must_exist: bool = False) -> DataFrame:
    """Requests (thread_id, user_id, ...) with allowed: the thread is the user's or nobody's; an unknown thread is allowed unless it
    must exist."""
    known = threads.select("thread_id", F.col("user_id").alias("__owner"), F.lit(True).alias("__known"))
    found = requests.join(known, "thread_id", "left")
    allowed = F.when(F.col("__known").isNull(), F.lit(not must_exist)).otherwise(F.col("__owner").isNull() | F.coalesce(F.col("__owner") == F.col("user_id"), F.lit(False)))
    return found.withColumn("allowed", allowed).select(*requests.columns, "allowed")


def in_states(runs: DataFrame, states: list[str], before: object, at: str = "created_at", status: str = "status") -> DataFrame:
    """Runs in some states that were made up to a time, the oldest first (pending: one state; in flight: pending and running)."""
    return runs.where(F.col(status).isin(states) & (F.col(at) <= F.lit(before))).orderBy(F.asc(at))


def run_events(events: DataFrame, thread: object, run: object, types: list[str] | None = None, limit: int = 500) -> DataFrame:
    """The first events of a run by seq, of some types if any are named."""
    rows = events.where((F.col("thread_id") == thread) & (F.col("run_id") == run))
    return (rows.where(F.col("event_type").isin(types)) if types else rows).orderBy("seq").limit(limit)


def recent(rows: DataFrame, at: str, key: str, limit: int = 100, newest: bool = True) -> DataFrame:
    """The newest rows (runs) or the oldest (feedback) by a time; of equal times by key."""
    return rows.orderBy(F.desc(at) if newest else F.asc(at), key).limit(limit)


def search_catalogue(catalogue: DataFrame, query: str, order: str = "position", most: int = CATALOGUE_ROWS) -> DataFrame:
    """Entries (name, description, and their order) that a query asks for: `select:a,b` by name; `+word rest`: the word in the name,
    most matches of the rest first; else a pattern in name or description, names first. A pattern that isn't valid is taken literally;
    blank queries find nothing."""
    query = query.strip()
    whole = F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))
    none = catalogue.limit(0)
    if query.startswith("select:"):
        return catalogue.where(F.col("name").isin([n.strip() for n in query[7:].split(",")])).orderBy(order).limit(most)
    if query.startswith("+"):
        word, *rest = query[1:].split(None, 1) or [""]
        if not word:
            return none
        found = catalogue.where(F.lower("name").contains(word.lower()))
        matches = F.size(F.regexp_extract_all(whole, F.lit(f"(?i){text.safe_pattern(rest[0])}"), 0)) if rest else F.lit(0)
        return found.withColumn("__score", matches).orderBy(F.desc("__score"), order).limit(most).drop("__score")
    if not query:
        return none
    pattern = f"(?i){text.safe_pattern(query)}"
    return catalogue.where(whole.rlike(pattern)).orderBy(F.desc(F.col("name").rlike(pattern)), order).limit(most)


def filter_records(records: DataFrame, query: str = "", **equal: str | None) -> DataFrame:
    """Records whose column `text` or group holds the query without regard to case, and that equal what is given; blanks don't filter."""
    q = query.strip().lower()
    if q:
        held = lambda c: F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
        records = records.where(held("text") | held("group"))
    for column, value in equal.items():
        if value:
            records = records.where(F.col(column) == value)
    return records


def browse_records(records: DataFrame, query: str = "", category: str | None = None, sort: str = "risk") -> DataFrame:
    """Records (title, excerpt, author, jargon, categories as a map, risk, inquiries, liked, comments) whose words hold the query and
    that are in a category, by risk, demand or engagement from the greatest down."""
    words = F.lower(F.concat_ws(" ", "title", "excerpt", "author", F.array_join("jargon", " ")))
    found = records.where(words.contains(query.lower())) if query else records
    if category:
        found = found.where(F.map_contains_key("categories", category))
    key = {"demand": F.col("inquiries"), "engage": F.col("liked") + F.col("comments")}.get(sort, F.col("risk"))
    return found.orderBy(key.desc())


def verdicts(replies: DataFrame, batch: str, reply: str) -> DataFrame:
    """(batch, index, verdict) from replies of lines `index: 0 or 1` with either colon; the last of an index counts."""
    pairs = F.regexp_extract_all(reply, F.lit(r"(\d+\s*[:：]\s*[01])"), 1)
    each = replies.select(batch, F.posexplode(pairs).alias("p", "x"))
    told = each.select(batch, "p", F.regexp_extract("x", r"^(\d+)", 1).cast("int").alias("index"), F.right("x", F.lit(1)).cast("int").alias("verdict"))
    return told.groupBy(batch, "index").agg(F.max_by("verdict", "p").alias("verdict"))


def apply_verdicts(items: DataFrame, told: DataFrame, batch: str, index: str = "index", default: int = 1) -> DataFrame:
    """Items with the verdict of their place in the batch; those without one are kept (1)."""
    return items.join(told, [batch, index], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def above_risk(records: DataFrame, risk: str, least: float) -> DataFrame:
    """Records above a risk, which isn't enough itself; 0 and less filter nothing."""
    return records if least <= 0 else records.where(F.coalesce(F.col(risk), F.lit(0)) > least)


def groups_above(members: DataFrame, group: str, risk: str, least: float) -> DataFrame:
    """All members of the groups whose greatest risk is above `least`."""
    return members.join(members.groupBy(group).agg(F.max(risk).alias("__peak")).where(F.col("__peak") > least).select(group), group, "left_semi")


def confidence_rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(0))


def confident(rows: DataFrame, confidence: str, least: str) -> DataFrame:
    """Rows whose confidence (high, medium, low; anything else is less) reaches a level."""
    return rows.where(confidence_rank(F.col(confidence)) >= CONFIDENCE[least])


def live_entries(cache: DataFrame, now: Column, pattern: str = "*") -> DataFrame:
    """Cache entries (key, value, expires_at; null: never) that haven't expired and whose key fits a pattern with * for anything."""
    like = "^" + ".*".join(rf"\Q{p}\E" for p in pattern.split("*")) + "$"
    return cache.where((F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.col("key").rlike(like))


def with_reputation(candidates: DataFrame, reputation: DataFrame) -> DataFrame:
    """(key, group, high, medium, total) of each candidate's sources; groups without a record have zeros, candidates without sources a
    null group."""
    each = candidates.select("key", F.explode_outer("sources").alias("s")).select("key", "s.group")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return each.join(reputation.select("group", "high", "medium", "total"), "group", "left").select("key", "group", zero("high"), zero("medium"), zero("total"))


def with_raw_text(candidates: DataFrame, raw: DataFrame, most: int = 3) -> DataFrame:
    """(key, position, group, msg_id, text) of each candidate's first sources; text is null where the message isn't stored."""
    each = candidates.select("key", F.posexplode(F.slice("sources", 1, most)).alias("position", "s")).select("key", "position", "s.group", "s.msg_id")
    return each.join(raw.select("group", "msg_id", "text"), ["group", "msg_id"], "left").select("key", "position", "group", "msg_id", "text")


def best_candidates(candidates: DataFrame, reputation: DataFrame, limit: int) -> DataFrame:
    """Candidates with sources by score: how often they were seen, times the most high-risk records of a source (1 at least)."""
    high = with_reputation(candidates.where(F.size("sources") > 0), reputation).groupBy("key").agg(F.max("high").alias("__high"))
    scored = candidates.join(high, "key").withColumn("score", F.col("count") * F.greatest(F.col("__high"), F.lit(1)))
    return scored.drop("__high").orderBy(F.desc("score"), "key").limit(limit)

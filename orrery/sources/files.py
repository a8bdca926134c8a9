"""Scans of nested JSON, event logs, feeds and folders."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.values import day_of


def json_documents(spark: SparkSession, path: str, element: T.DataType, wrapper: str = "notes", pattern: str = "*.json") -> DataFrame:
    """Records of whole-file JSON below a folder in three layouts (a list, an object with a list under `wrapper`, one object), with
    source_file. Files that can't be read give no rows."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    text = F.trim("value")
    as_list, wrapped, single = F.from_json(text, T.ArrayType(element)), F.from_json(text, T.StructType([T.StructField(wrapper, T.ArrayType(element))])), F.from_json(text, element)
    rows = F.when(F.get_json_object(text, "$").isNull(), None).when(text.startswith("["), as_list).when(wrapped[wrapper].isNotNull(), wrapped[wrapper]).otherwise(F.array(single))
    return whole.select(F.col("_metadata.file_name").alias("source_file"), F.explode(rows).alias("r")).where("r IS NOT NULL").select("source_file", "r.*")


def dated_records(spark: SparkSession, path: str, element: T.StructType, time: str, wrapper: str = "records") -> DataFrame:
    """Records of JSON files of an earlier layout with their day: that in the file's name, else that of the record, else unknown."""
    df = json_documents(spark, path, element, wrapper)
    return df.withColumn("day", day_of(F.col("source_file"), F.col(time)))


def listing_files(spark: SparkSession, path: str, item: T.StructType, excluded: str = "_detail_") -> DataFrame:
    """Items of {keyword, items[]} files; the keyword defaults to the file's stem, names with `excluded` are skipped."""
    shape = T.StructType([T.StructField("keyword", T.StringType()), T.StructField("items", T.ArrayType(item))])
    df = spark.read.schema(shape).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("source_file", F.col("_metadata.file_name"))
    df = df.where(~F.col("source_file").contains(excluded))
    return df.select(F.coalesce(F.nullif("keyword", F.lit("")), F.regexp_replace("source_file", r"\.json$", "")).alias("keyword"), "source_file", F.explode("items").alias("i")).select("keyword", "source_file", "i.*")


def incremental_files(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, target: str) -> None:
    """Append the files that earlier calls haven't seen to a Parquet table; the checkpoint remembers them."""
    stream = spark.readStream.schema(schema).json(path)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Run events in JSON lines, malformed lines skipped, by thread and seq."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).orderBy("thread_id", "seq")


def last_texts(spark: SparkSession, df: DataFrame, order: Column) -> DataFrame:
    """(group, msg_id) -> text, the last writer winning."""
    return df.groupBy("group", "msg_id").agg(F.max_by("text", order).alias("text"))


def evaluation_tree(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Results below eval-N/CONFIG/run-M/ with these three from the path."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    at = F.col("_metadata.file_path")
    take = lambda p: F.regexp_extract(at, p, 1)
    return df.select(take(r"/eval-(\d+)/").cast("int").alias("eval_id"), take(r"/eval-\d+/([^/]+)/").alias("config"), take(r"/run-(\d+)/").cast("int").alias("run_number"), "*")


#: Names of files and folders that aren't listed, * standing for anything (fixed values).
IGNORED = (
    ".git", ".svn", ".hg", ".bzr", "node_modules", "__pycache__", ".venv", "venv", ".env", "env", ".tox", ".nox", ".eggs", "*.egg-info", "site-packages", "dist", "build", ".next",
    ".nuxt", ".output", ".turbo", "target", "out", ".idea", ".vscode", "*.swp", "*.swo", "*~", ".project", ".classpath", ".settings", ".DS_Store", "Thumbs.db", "desktop.ini", "*.lnk",
    "*.log", "*.tmp", "*.temp", "*.bak", "*.cache", ".cache", "logs", ".coverage", "coverage", ".nyc_output", "htmlcov", ".pytest_cache", ".mypy_cache", ".ruff_cache",
)


def ignored_path(path: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    """Whether a part of a path below some folder has an ignored name."""
    names = "|".join(".*".join(re.escape(x) for x in p.split("*")).replace(".*", "[^/]*") for p in ignored) or "(?!)"
    return path.rlike(f"(?:^|/)(?:{names})(?:/|$)")


def list_files(spark: SparkSession, path: str, pattern: str = "*", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Files below a folder: path, name, size, ending, modification time, by name."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    out = df.select("path", name.alias("name"), F.col("length").alias("size"), F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("ending"), F.col("modificationTime").alias("modified"))
    below = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(path.removeprefix("file:").strip("/")) + "/", "")
    return out.where(~ignored_path(below, ignored)).orderBy("name", "path")


def grep(spark: SparkSession, path: str, pattern: str, most: int = 100, max_bytes: int = 1_000_000, max_line: int = 2000) -> tuple[DataFrame, bool]:
    """Lines that a pattern is found in, and whether there are more than `most`; large and binary files and ends of long lines are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= max_bytes)
    text = files.select("path", F.col("content").cast("string").alias("t")).where(~F.col("t").contains("\x00"))
    lines = text.select("path", F.posexplode(F.split("t", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_number"), F.left("line", F.lit(max_line)).alias("line")).where(F.col("line").rlike(pattern))
    found = lines.orderBy("path", "line_number")
    return found.limit(most), len(found.limit(most + 1).take(most + 1)) > most


def needs_fallback(text: Column, pages: Column, least: int = 50) -> Column:
    """Whether a converted document holds too little text for its pages."""
    return F.length(F.coalesce(text, F.lit(""))) < pages * least


def atom_entries(df: DataFrame, xml: str) -> DataFrame:
    """Papers of Atom feeds: id without version, title, authors, categories, day, summary; white space collapsed."""
    entries = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<entry>(.*?)</entry>"), 1)
    e = df.select(F.explode(entries).alias("e"))
    one = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    return e.select(
        F.regexp_replace(F.regexp_extract("e", r"(?s)<id>\s*(?:https?://[^<]*?/abs/)?([^<\s]+?)\s*</id>", 1), r"v\d+$", "").alias("id"),
        one("title").alias("title"),
        F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), 1), lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))).alias("authors"),
        F.regexp_extract_all("e", F.lit(r'<category[^>]*\bterm="([^"]*)"'), 1).alias("categories"),
        F.left(one("published"), F.lit(10)).alias("day"),
        one("summary").alias("summary"),
    )


#: The columns of posts.
POST = (
    "tweet_id string, user_id string, screen_name string, user_name string, text string, date string, lang string, reply_count long, retweet_count long, favorite_count long, quote_count long, "
    "view_count long, is_retweet boolean, in_reply_to string, source_keyword string, url string, media_urls array<string>"
)


def _objects(x):
    """All objects anywhere in nested JSON, outer ones first."""
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)


def _number(x) -> int:
    try:
        return int(x or 0)
    except (TypeError, ValueError):
        return 0


def _media(post: dict) -> list[str]:
    """Addresses of a post's pictures and previews, each once."""
    own = post.get("media") if isinstance(post.get("media"), dict) else {}
    listed = [m for kind in ("photo", "video", "animated_gif") for m in own.get(kind) or []]
    found = [m.get("media_url_https") or m.get("media_url") for m in listed]
    entities = post.get("entities") if isinstance(post.get("entities"), dict) else {}
    found += [m.get("media_url_https") or m.get("media_url") or m.get("expanded_url") for m in entities.get("media") or []]
    return list(dict.fromkeys(u for u in found if u))


def _posts(payload, keyword: str) -> list[dict]:
    """Posts of a payload: first the flat items, then the nested ones whose id isn't there yet."""
    every = list(_objects(payload))
    people = {}
    for o in every:
        if "id_str" in o and ("screen_name" in o or "name" in o):
            people.setdefault(o["id_str"], o)
    out: dict[str, dict] = {}
    for o in every:
        if o.get("type") == "tweet" and "tweet_id" in o and "text" in o and (key := str(o["tweet_id"] or "")) and key not in out:
            counts = dict(reply_count="replies", retweet_count="retweets", favorite_count="favorites", quote_count="quotes", view_count="views")
            who = {"user_id": str(o.get("user_id") or ""), "screen_name": o.get("screen_name") or "", "user_name": o.get("user_name") or o.get("name") or ""}
            out[key] = who | {"text": o.get("text") or "", "is_retweet": bool(o.get("retweeted")), "in_reply_to": str(o.get("in_reply_to_status_id") or ""), "__o": o} | {n: _number(o.get(c)) for n, c in counts.items()}
    for o in every:
        if "full_text" in o and ("created_at" in o or "user_id_str" in o) and (key := str(o.get("id_str") or o.get("id") or "")) and key not in out:
            user = str(o.get("user_id_str") or o.get("user_id") or "")
            person = people.get(user, {})
            counts = {n: _number(o.get(n)) for n in ("reply_count", "retweet_count", "favorite_count", "quote_count")}
            out[key] = {"user_id": user, "screen_name": person.get("screen_name") or "", "user_name": person.get("name") or "", "text": o.get("full_text") or o.get("text") or "", "view_count": _number(o.get("views_count") or o.get("view_count"))} | counts
            out[key] |= {"is_retweet": bool(o.get("retweeted_status_id_str") or o.get("retweeted")), "in_reply_to": str(o.get("in_reply_to_status_id_str") or ""), "__o": o}
    rows = []
    for key, post in out.items():
        o = post.pop("__o")
        url = f"https://twitter.com/{post['screen_name']}/status/{key}" if post["screen_name"] else ""
        rows.append(post | {"tweet_id": key, "date": o.get("created_at"), "lang": o.get("lang") or "", "source_keyword": keyword, "url": url, "media_urls": _media(o)})
    return rows


def tweets(df: DataFrame, payload: str, keyword: str | None = None) -> DataFrame:
    """Posts anywhere in nested JSON payloads, in two shapes (flat items of type tweet; objects with full_text, whose author stands
    elsewhere in the payload), each id once per payload, with the keyword that was searched for. Unreadable payloads give none."""
    names = [c.split()[0] for c in POST.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for p, k in zip(frame["p"], frame["k"], strict=True):
                try:
                    rows += _posts(json.loads(p), k or "")
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(payload).alias("p"), (F.col(keyword) if keyword else F.lit("")).alias("k")).mapInPandas(run, POST)


def next_cursor(payload: Column) -> Column:
    """The value of the bottom cursor in a nested payload."""
    return F.coalesce(F.nullif(F.regexp_extract(payload, r'"cursorType"\s*:\s*"Bottom"[^{}]*"value"\s*:\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract(payload, r'"value"\s*:\s*"([^"]+)"[^{}]*"cursorType"\s*:\s*"Bottom"', 1), F.lit("")), F.nullif(F.regexp_extract(payload, r'"next_cursor"\s*:\s*"([^"]+)"', 1), F.lit("")))

"""Exports and side outputs."""

from __future__ import annotations

import csv
import html
import json
import os

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    """Bytes as hex, times in ISO, nested values as JSON."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def export(df: DataFrame, path: str) -> None:
    """Write by the path's ending: .csv and .jsonl (lines) as folders of parts, written where the rows are; .json (one array) and .md as
    one file, to which all rows come through the driver, a partition at a time."""
    if path.endswith(".csv"):
        _flat(df).write.mode("overwrite").csv(path, header=True, escape='"')
    elif path.endswith(".jsonl"):
        _flat(df).write.mode("overwrite").json(path)
    elif path.endswith((".json", ".md")):
        export_file(df, path)
    else:
        raise ValueError(f"unsupported ending: {path}")


def export_file(df: DataFrame, path: str) -> int:
    """Write all rows into one local file by its ending (.csv, .json, .md), a partition at a time; returns their number."""
    ending = os.path.splitext(path)[1].lower()
    if ending not in (".csv", ".json", ".md"):
        raise ValueError(f"Unsupported output format: {ending}. Use .csv, .json, or .md")
    if os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        if ending == ".csv":
            out.writerow(df.columns)
        elif ending == ".md":
            f.write(_markdown_row(df.columns) + _markdown_row(["---"] * len(df.columns)))
        else:
            f.write("[")
        for r in _flat(df).toLocalIterator():
            if ending == ".csv":
                out.writerow(r)
            elif ending == ".md":
                f.write(_markdown_row([str(v) for v in r]))
            else:
                body = json.dumps(r.asDict(), indent=2, ensure_ascii=False, default=str).replace("\n", "\n  ")
                f.write((",\n  " if n else "\n  ") + body)
            n += 1
        if ending == ".json":
            f.write("\n]" if n else "]")
    return n


def _markdown_row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", r"\|").replace("\n", " ") for c in cells) + " |\n"


def console_table(df: DataFrame, width: int = 40) -> str:
    """All rows of a result that is meant to be read as a plain table, cells cut at `width` characters, and their number."""
    rows = [[str(v) for v in r] for r in df.collect()]
    if not rows:
        return "Query returned 0 rows."
    sizes = [min(width, max(len(r[i]) for r in [df.columns, *rows])) for i in range(len(df.columns))]
    line = lambda r: " | ".join(x[:width].ljust(n) for x, n in zip(r, sizes, strict=True))
    head = " | ".join(x.ljust(n) for x, n in zip(df.columns, sizes, strict=True))
    return "\n".join([head, "-+-".join("-" * n for n in sizes), *map(line, rows), f"\n({len(rows)} rows)"])


def dual_write(df: DataFrame, folder: str) -> None:
    """JSON lines and quoted CSV of one result; line ends inside CSV cells become spaces."""
    kept = df.persist()
    try:
        kept.write.mode("overwrite").json(f"{folder}/json")
        flat = _flat(kept)
        one_line = [F.regexp_replace(F.col(f"`{f.name}`"), r"[\r\n]+", " ").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in flat.schema]
        flat.select(*one_line).write.mode("overwrite").csv(f"{folder}/csv", header=True, quoteAll=True, escape='"')
    finally:
        kept.unpersist()


def dead_letters(df: DataFrame, reason: str, path: str) -> None:
    df.withColumn("reason", F.lit(reason)).write.mode("append").json(path)


def html_report(title: str, frames: dict[str, DataFrame], most: int = 1000) -> str:
    """A page with the first rows of aggregates embedded as JSON and shown as tables, and how many rows there are if that isn't all."""
    data, tables = {}, []
    for k, df in frames.items():
        rows = [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*")).alias("j")).limit(most + 1).collect()]
        data[k] = rows[:most]
        more = f"<p>the first {most} of {df.count()} rows</p>" if len(rows) > most else ""
        tables.append(f"<h2>{html.escape(k)}</h2>{more}<pre>{html.escape(console_table(df.limit(most)))}</pre>")
    told = json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")
    name = html.escape(title)
    return f"<!DOCTYPE html><meta charset=utf-8><title>{name}</title><h1>{name}</h1>{''.join(tables)}<script type='application/json' id='data'>{told}</script>"


def graph_json(nodes: DataFrame, edges: DataFrame, most: int = 5000) -> str:
    """Nodes (id, ...) and links (a, b, ...) of a graph to be drawn: the first nodes by id, and the links among them."""
    kept = nodes.orderBy("id").limit(most)
    ids = F.broadcast(kept.select("id"))
    inner = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    rows = lambda df: [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    return json.dumps({"nodes": rows(kept.orderBy("id")), "links": rows(inner.withColumnsRenamed({"a": "source", "b": "target"}))}, ensure_ascii=False)


def markdown_report(title: str, frames: dict[str, DataFrame]) -> str:
    """Aggregates as Markdown tables under a title, all their rows."""
    out = [f"# {title}\n"]
    for name, df in frames.items():
        out.append(f"\n## {name}\n\n" + _markdown_row(df.columns) + _markdown_row(["---"] * len(df.columns)) + "".join(_markdown_row([str(v) for v in r]) for r in _flat(df).toLocalIterator()))
    return "".join(out)


class StageCounters:
    """Rows that pass the stages of a job, counted on the way by observations, with no pass of their own."""

    def __init__(self):
        self.observed: dict[str, Observation] = {}

    def count(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        """`df`, whose rows (and further aggregates) are counted when it is next run."""
        self.observed[stage] = Observation(stage)
        return df.observe(self.observed[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()])

    def totals(self) -> dict[str, dict[str, object]]:
        """Of each stage its counts; to be called when the job has run."""
        return {k: dict(o.get) for k, o in self.observed.items()}

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.totals(), f, ensure_ascii=False, indent=2)


def read_counters(paths: list[str]) -> dict[str, dict[str, object]]:
    """The stages' counts of several files, the later ones winning; files that aren't there count for nothing."""
    out: dict[str, dict[str, object]] = {}
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                out |= json.load(f)
    return out

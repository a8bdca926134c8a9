"""The engine from a shell: files as tables, federated databases, clusters.

    python -m orrery data inspect|query|summary --files a.csv ... [--sql ...] [--table ...] [--output-file ...]
    python -m orrery federation sql|schema|trends|report --registry federation.yaml [--sql ...] [--from ...] [--to ...]
    python -m orrery posts INPUT --lexicon lexicon.json -o OUT [--sim 0.92] [--min-risk 50] [--min-peak-risk 60] [--prune]
    python -m orrery cluster --edges edges.csv --output-file clusters.csv
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.jobs import posts, steps
from orrery.operators import aggregate, graph, reports
from orrery.session import session
from orrery.sources import catalog, sinks


def inspect_text(spark: SparkSession, names: dict[str, str]) -> str:
    """Columns, counts and the first rows of each table."""
    out = []
    for name, view in names.items():
        df = spark.table(view)
        told = aggregate.inspect(df)
        out += [f"\n{'=' * 60}", f'Table: {name} (SQL name: "{view}")', "=" * 60, f"Rows: {told['rows']}", f"\nColumns ({len(df.columns)}):", f"{'Name':<30} {'Type':<15} {'Nullable'}", f"{'-' * 30} {'-' * 15} {'-' * 8}"]
        out += [f"{f.name:<30} {f.dataType.simpleString().upper():<15} {'YES' if f.nullable else 'NO'}" for f in df.schema]
        out += ["\nNon-null counts:", *[f"  {c['name']}: {c['non_null']} / {told['rows']}" for c in told["columns"]], "\nSample data (first 5 rows):"]
        out.append(sinks.console_table(df.limit(5)))
    return "\n".join(out)


def summary_text(spark: SparkSession, names: dict[str, str], table: str) -> str:
    """Statistics of each column of a table, by its file's or its view's name."""
    view = names.get(table, table)
    if view not in names.values():
        return f"Table '{table}' not found. Available tables: " + ", ".join(f'"{v}" ({n})' for n, v in names.items())
    df = spark.table(view)
    numeric, _ = aggregate.summarise(df)
    numbers = {r["column"]: r for r in numeric.collect()} if numeric is not None else {}
    total = df.count()
    out = [f"\nStatistical Summary: {table}", f"Total rows: {total}", "=" * 70]
    show = lambda v: f"{v:,.4f}" if isinstance(v, float) else str(v)
    for f in df.schema:
        out.append(f"\n--- {f.name} ({f.dataType.simpleString().upper()}) ---")
        if f.name in numbers:
            r = numbers[f.name]
            out += [f"  {label:<8}: {show(r[c])}" for label, c in (("count", "n"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "q25"), ("50%", "median"), ("75%", "q75"), ("max", "max"), ("nulls", "nulls"))]
            continue
        rows = aggregate.categorical_summary(df, f.name).orderBy(F.desc("n"), "value").collect()
        nulls = df.where(F.col(f"`{f.name}`").isNull()).count() if not rows else rows[0]["nulls"]
        out += [f"  count   : {total - nulls}", f"  unique  : {rows[0]['n_distinct'] if rows else 0}", f"  top     : {rows[0]['value'] if rows else None}", f"  nulls   : {nulls}"]
        if rows:
            out += ["  top values:", *[f"    {r['value']}: {r['n']} ({r['percent']:.1f}%)" for r in rows]]
    return "\n".join(out)


def data(spark: SparkSession, args: argparse.Namespace) -> str:
    names, warnings = catalog.register_files(spark, args.files)
    told = "".join(f"{w}\n" for w in warnings)
    if not names:
        return told + "No tables could be loaded."
    if args.action == "inspect":
        return told + inspect_text(spark, names)
    if args.action == "summary":
        return told + summary_text(spark, names, args.table)
    try:
        result = catalog.query_files(spark, args.sql, names)
        if args.output_file:
            return told + f"Results exported to {args.output_file} ({sinks.export_file(result, args.output_file)} rows)"
        return told + sinks.console_table(result)
    except ValueError as e:
        return told + f"SQL Error: {e}"


def schema_of_views(databases: list[dict[str, str]], there: dict[str, bool]) -> dict[str, object]:
    columns = {"intel": catalog.RECORD_COLUMNS, "intel_raw": catalog.RAW_COLUMNS}
    return {"views": {v: {"columns": ["__db", *columns[v]], "available": there[v]} for v in columns}, "databases": [d["alias"] for d in databases]}


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r["j"]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def federation(spark: SparkSession, args: argparse.Namespace) -> str:
    databases = catalog.read_registry(args.registry)
    there, warnings = catalog.federated_views(spark, databases)
    for w in warnings:
        print(w, file=sys.stderr)
    show = lambda x: json.dumps(x, ensure_ascii=False, indent=2, default=str)
    if args.action == "schema":
        return show(schema_of_views(databases, there))
    if args.action == "sql":
        try:
            got = catalog.select(spark, args.sql, args.max_rows, ["intel", "intel_raw"])
        except ValueError as e:
            return show({"error": str(e)})
        rows = _rows(got.rows)
        return show({"columns": got.rows.columns, "rows": rows, "row_count": len(rows), "truncated": got.truncated})
    facts = reports.report_facts(spark.table("intel"), args.limit, args.first, args.last, args.platform)
    if args.action == "trends":
        return show(_rows(facts["trends"].orderBy("day", "risk_level")))
    if args.output_file:
        with open(args.output_file, "w", encoding="utf-8") as f:
            f.write(sinks.html_report("Report", facts))
        return f"Report written to {args.output_file}"
    return show({"scope": {"day_from": args.first, "day_to": args.last, "source_platform": args.platform}, "sources": databases, **{k: _rows(df) for k, df in facts.items()}})


def cluster(spark: SparkSession, args: argparse.Namespace) -> str:
    edges = catalog.read_file(spark, args.edges)
    a, b = edges.columns[:2]
    found = graph.connected_components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    if args.output_file:
        return f"Results exported to {args.output_file} ({sinks.export_file(found.orderBy('component', 'id'), args.output_file)} rows)"
    return sinks.console_table(found.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component"))


def run_posts(spark: SparkSession, args: argparse.Namespace) -> str:
    try:
        results, counts = posts.run(spark, args.input, args.lexicon, args.outdir, args.sim, args.min_risk, args.min_peak_risk)
    except ValueError as e:
        return f"Error: {e}"
    gone = steps.prune(spark, results, f"{args.outdir}/steps") if args.prune else 0
    told = [f"{n}: {'as before' if r.resumed else 'made'}, {json.dumps(r.counts)}" for n, r in results.items()]
    return "\n".join([*told, *([f"{gone} earlier results deleted"] if gone else []), json.dumps(counts, ensure_ascii=False), f"Report: {args.outdir}/analysis_report.md", f"Dashboard: {args.outdir}/dashboard.html"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = p.add_subparsers(dest="verb", required=True)
    d = verbs.add_parser("data")
    d.add_argument("action", choices=["inspect", "query", "summary"])
    d.add_argument("--files", nargs="+", required=True)
    d.add_argument("--sql")
    d.add_argument("--table")
    d.add_argument("--output-file")
    f = verbs.add_parser("federation")
    f.add_argument("action", choices=["sql", "schema", "trends", "report"])
    f.add_argument("--registry", required=True)
    f.add_argument("--sql")
    f.add_argument("--from", dest="first")
    f.add_argument("--to", dest="last")
    f.add_argument("--platform")
    f.add_argument("--limit", type=int, default=20)
    f.add_argument("--max-rows", type=int, default=500)
    f.add_argument("--output-file")
    j = verbs.add_parser("posts")
    j.add_argument("input")
    j.add_argument("-o", "--outdir", required=True)
    j.add_argument("--lexicon", required=True)
    j.add_argument("--sim", type=float, default=0.92)
    j.add_argument("--min-risk", type=int, default=50)
    j.add_argument("--min-peak-risk", type=int, default=60)
    j.add_argument("--prune", action="store_true")
    c = verbs.add_parser("cluster")
    c.add_argument("--edges", required=True)
    c.add_argument("--output-file")
    return p


def run(arguments: list[str], spark: SparkSession | None = None) -> str:
    """What a command prints."""
    p = parser()
    args = p.parse_args(arguments)
    if args.verb == "data" and args.action == "query" and not args.sql or args.verb == "federation" and args.action == "sql" and not args.sql:
        p.error("--sql is required")
    if args.verb == "data" and args.action == "summary" and not args.table:
        p.error("--table is required")
    spark = spark or session()
    return {"data": data, "federation": federation, "cluster": cluster, "posts": run_posts}[args.verb](spark, args)


def main() -> None:
    print(run(sys.argv[1:]))

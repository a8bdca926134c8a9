"""Files as views, federated sources, and guarded read-only SQL."""

from __future__ import annotations

import hashlib
import os
import re
import warnings
import zipfile
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.store import exists
from orrery.sources import office, sqlite


def view_name(name: str, taken: set[str]) -> str:
    """A name of word characters, with _1, _2, … if it is taken."""
    base = re.sub(r"\W", "_", name)
    base = f"t_{base}" if base[:1].isdigit() else base or "t_"
    out, k = base, 0
    while out.lower() in taken:
        k += 1
        out = f"{base}_{k}"
    taken.add(out.lower())
    return out


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's ending: csv, tsv, json (lines or whole documents), jsonl, parquet, orc, txt, xlsx (its first sheet)."""
    kind = PurePosixPath(path).suffix.lower()
    if kind in (".csv", ".tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == ".tsv" else ",", multiLine=True, escape='"')
    if kind == ".json":
        return spark.read.option("multiLine", True).json(path)
    if kind in (".jsonl", ".ndjson"):
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    if kind in (".parquet", ".orc"):
        return spark.read.format(kind[1:]).load(path)
    if kind == ".txt":
        return spark.read.text(path)
    if kind == ".xlsx":
        return office.read_sheet(spark, path)
    raise ValueError(f"unsupported ending: {kind}")


def register_files(spark: SparkSession, paths: list[str]) -> tuple[dict[str, str], list[str]]:
    """Views over files: original name (qualified by the file's folder if it repeats) -> view, and warnings of what was skipped. Each
    sheet of a workbook is a table under its own name; a sheet that can't be read is a warning, and the others stay."""
    names, warnings, taken = {}, [], set()

    def put(original: str, stem: str, df: DataFrame) -> None:
        names[original] = view_name(stem, taken)
        df.createOrReplaceTempView(names[original])

    for path in paths:
        if not exists(spark, path):
            warnings.append(f"missing: {path}")
            continue
        stem = PurePosixPath(path).stem
        if path.lower().endswith(".xlsx"):
            try:
                found = office.sheet_names(path)
            except (OSError, KeyError, zipfile.BadZipFile) as e:
                warnings.append(f"not a workbook: {path}: {e}")
                continue
            for sheet in found:
                try:
                    df = office.read_sheet(spark, path, sheet)
                    if df.columns:
                        put(sheet if sheet not in names else f"{stem}/{sheet}", sheet, df)
                    else:
                        warnings.append(f"sheet {sheet} of {path} is empty")
                except Exception as e:  # noqa: BLE001  any fault of one sheet leaves the others
                    warnings.append(f"sheet {sheet} of {path} can't be read: {str(e).splitlines()[0]}")
            continue
        try:
            df = read_file(spark, path)
        except ValueError as e:
            warnings.append(str(e))
            continue
        put(stem if stem not in names else f"{PurePosixPath(path).parent.name}/{stem}", stem, df)
    return names, warnings


def content_key(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files' names and contents, computed where the files are; their digests come to the driver in order, one by one."""
    files = spark.read.format("binaryFile").load(sorted(paths)).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
    digest = hashlib.sha256()
    for r in files.orderBy("name", "h").toLocalIterator():
        digest.update(f"{r['name']}:{r['h']}\n".encode())
    return digest.hexdigest()


def substitute_names(sql: str, names: dict[str, str]) -> str:
    """The statement with files' own names replaced by their views', longest first; names within quotes stay."""
    for original, view in sorted(names.items(), key=lambda x: -len(x[0])):
        if original != view:
            sql = re.sub(rf"('(?:[^']|'')*')|(?<!\w){re.escape(original)}(?!\w)", lambda m, v=view: m[1] or f"`{v}`", sql)
    return sql


def query_files(spark: SparkSession, sql: str, names: dict[str, str]) -> DataFrame:
    """A statement over registered files, which may use the files' own names; an error lists the tables with their columns."""
    try:
        return spark.sql(substitute_names(sql, names))
    except Exception as e:
        known = "\n".join(f"  {v} ({n}): {', '.join(spark.table(v).columns)}" for n, v in names.items())
        raise ValueError(f"{str(e).splitlines()[0]}\n\nAvailable tables:\n{known}") from e


def cached_table(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """The files' table, kept as Parquet under the digest of their names and contents."""
    at = f"{folder}/{content_key(spark, paths)}"
    if not exists(spark, f"{at}/_SUCCESS"):
        parts = [read_file(spark, p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def federate(sources: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """All sources under each other with __db; columns that a source lacks are null. Filters reach each source's scan."""
    out = None
    for name, df in sorted(sources.items()):
        part = df.withColumn("__db", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    if columns:
        out = out.select("__db", *[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns])
    return out


#: Columns of the federated views (fixed values).
RECORD_COLUMNS = ("day", "id", "source_platform", "source_group", "risk_type", "risk_level", "summary", "source_url", "entities")
RAW_COLUMNS = ("day", "id", "group_name", "payload")


def read_registry(path: str) -> list[dict[str, str]]:
    """The databases (alias, path, owner) of a registry in YAML; relative paths are below its folder, AUTO is output/intel.db below the
    folder that INTEL_HOME names, and left out where that is unset."""
    import yaml

    with open(path, encoding="utf-8") as f:
        listed = (yaml.safe_load(f) or {}).get("databases") or []
    out = []
    for item in listed:
        at = str(item["path"])
        if at.upper() == "AUTO":
            if not os.environ.get("INTEL_HOME"):
                warnings.warn(f"{item.get('alias')}: AUTO without INTEL_HOME, left out", stacklevel=2)
                continue
            at = os.path.join(os.environ["INTEL_HOME"], "output", "intel.db")
        elif "://" not in at:
            at = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), at))
        out.append({"alias": str(item["alias"]), "path": at, "owner": str(item.get("owner", ""))})
    return out


def from_registry(spark: SparkSession, registry: dict[str, str], suffix: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Tables whose name ends in a suffix in each registered database (a SQLite file, or a folder of Parquet tables); what is missing is
    told."""
    found, told = {}, []
    for alias, root in registry.items():
        if not exists(spark, root):
            told.append(f"missing: {alias}")
        elif root.endswith((".db", ".sqlite", ".sqlite3")):
            found |= {f"{alias}.{n}": sqlite.read_table(spark, root, n) for n in sqlite.tables(root) if n.endswith(suffix)}
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
            for n in sorted(n for n in names if n.removesuffix(".parquet").endswith(suffix)):
                found[f"{alias}.{n.removesuffix('.parquet')}"] = spark.read.parquet(f"{root}/{n}")
    return found, told


def federated_views(spark: SparkSession, databases: list[dict[str, str]], record_suffix: str = "_intel_filtered", raw_suffix: str = "_intel_raw") -> tuple[dict[str, bool], list[str]]:
    """Make the views intel and intel_raw over all tables of these kinds, with __db; tells which of them has any table, and warnings.
    A view without a table has its columns and no rows."""
    registry = {d["alias"]: d["path"] for d in databases}
    there, told = {}, []
    for view, suffix, columns in (("intel", record_suffix, RECORD_COLUMNS), ("intel_raw", raw_suffix, RAW_COLUMNS)):
        tables, missing = from_registry(spark, registry, suffix)
        told += [m for m in missing if m not in told]
        there[view] = bool(tables)
        by_db = [df.withColumn("__db", F.lit(name.split(".")[0])) for name, df in sorted(tables.items())]
        whole = None
        for df in by_db:
            part = df.select("__db", *[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
            whole = part if whole is None else whole.unionByName(part)
        if whole is None:
            whole = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("__db", *columns)))
        whole.createOrReplaceTempView(view)
    return there, told


#: Logical plans that only read (names of Catalyst's nodes).
READ_ONLY = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join Union Intersect Except Distinct Deduplicate SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedInlineTable "
    "UnresolvedSubqueryColumnAliases OneRowRelation Window WithWindowDefinition UnresolvedHaving Pivot Unpivot Generate LateralJoin LocalRelation "
    "WithCTE CTERelationDef CTERelationRef UnionLoop Sample TableAlias UnresolvedOrderBy UnresolvedSort ResolvedInlineTable".split()
)


@dataclass(frozen=True)
class Selected:
    rows: DataFrame
    truncated: bool


#: Groups of Catalyst's functions that compute from their arguments alone, and harmless functions of other groups.
PURE_GROUPS = frozenset(
    "math_funcs agg_funcs string_funcs datetime_funcs array_funcs collection_funcs conditional_funcs json_funcs map_funcs lambda_funcs predicate_funcs bitwise_funcs conversion_funcs "
    "window_funcs hash_funcs struct_funcs url_funcs generator_funcs variant_funcs csv_funcs xml_funcs".split()
)
PURE = frozenset(["typeof", "monotonically_increasing_id", "assert_true"])
#: Names that SQL has besides functions of the registry.
WORDS = frozenset(["count", "if", "coalesce"])


def _sequence(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _check_function(spark: SparkSession, name: str) -> None:
    """Raise ValueError unless a function is a built-in one that only computes."""
    if name in PURE or name in WORDS:
        return
    jvm = spark._jvm.org.apache.spark.sql.catalyst
    found = jvm.analysis.FunctionRegistry.builtin().lookupFunction(jvm.FunctionIdentifier(name))
    if not found.isDefined() or found.get().getGroup() not in PURE_GROUPS:
        raise ValueError(f"not an allowed function: {name}")


def check_read_only(spark: SparkSession, sql: str, views: list[str] | None = None) -> None:
    """Raise ValueError unless the text is one statement that only reads temporary views (those named, else all of the session) with
    functions that only compute; judged by the parsed plan, not by words in it."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError(f"not a statement: {e}") from e
    known = {v.lower() for v in (views if views is not None else [t.name for t in spark.catalog.listTables() if t.isTemporary])}
    relations: list[str] = []
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.nodeName().split("(")[0].strip()
        if kind not in READ_ONLY:
            raise ValueError(f"not a read-only statement: {node.nodeName()}")
        if kind == "UnresolvedRelation":
            relations.append(".".join(_sequence(node.multipartIdentifier())))
        if kind == "UnresolvedWith":
            known |= {r._1().lower() for r in _sequence(node.cteRelations())}
        todo += _sequence(node.children())
        todo += [x for x in _sequence(node.innerChildren()) if hasattr(x, "innerChildren") and "plans.logical" in x.getClass().getName()]
        exprs = _sequence(node.expressions())
        while exprs:
            e = exprs.pop()
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                _check_function(spark, ".".join(_sequence(e.nameParts())).lower())
            exprs += _sequence(e.children())
            if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
                todo.append(e.plan())
    for r in relations:
        if r.lower() not in known:
            raise ValueError(f"not a view: {r}")


def select(spark: SparkSession, sql: str, max_rows: int = 500, views: list[str] | None = None) -> Selected:
    """The first rows of a read-only statement over temporary views, and whether there are more."""
    check_read_only(spark, sql, views)
    df = spark.sql(sql)
    return Selected(df.limit(max_rows), len(df.select(F.lit(1)).limit(max_rows + 1).take(max_rows + 1)) > max_rows)

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import cli
from orrery.operators import store
from orrery.sources import catalog, files, sinks, sqlite


def write(folder, name, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_json_in_three_layouts(spark, tmp_path):
    note = T.StructType([T.StructField("note_id", T.StringType()), T.StructField("title", T.StringType())])
    write(tmp_path, "a/list.json", [{"note_id": "1", "title": "x"}, {"note_id": "2"}])
    write(tmp_path, "b/wrapped.json", {"notes": [{"note_id": "3"}]})
    write(tmp_path, "one.json", {"note_id": "4"})
    write(tmp_path, "bad.json", "{nonsense")
    write(tmp_path, "note.txt", "ignored")
    got = files.json_documents(spark, str(tmp_path), note)
    assert sorted((r.source_file, r.note_id, r.title) for r in got.where("note_id IS NOT NULL").collect()) == [("list.json", "1", "x"), ("list.json", "2", None), ("one.json", "4", None), ("wrapped.json", "3", None)]


def test_listing_files_take_the_keyword_from_the_name(spark, tmp_path):
    item = T.StructType([T.StructField("itemId", T.StringType())])
    write(tmp_path, "shoes.json", {"items": [{"itemId": "1"}, {"itemId": "2"}]})
    write(tmp_path, "other.json", {"keyword": "hats", "items": [{"itemId": "3"}]})
    write(tmp_path, "x_detail_1.json", {"keyword": "no", "items": [{"itemId": "4"}]})
    got = files.listing_files(spark, str(tmp_path), item)
    assert sorted((r.keyword, r.itemId) for r in got.collect()) == [("hats", "3"), ("shoes", "1"), ("shoes", "2")]


def test_incremental_files_are_read_once(spark, tmp_path):
    schema = "id int"
    write(tmp_path, "in/a.json", '{"id": 1}\n{"id": 2}')
    run = lambda: files.incremental_files(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.IntegerType())]), str(tmp_path / "c"), str(tmp_path / "out"))
    run()
    write(tmp_path, "in/b.json", '{"id": 3}')
    run()
    run()
    assert sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_event_log_skips_what_is_malformed_and_last_writer_wins(spark, tmp_path):
    write(tmp_path, "t/1.jsonl", '{"thread_id":"b","seq":1}\nnonsense\n{"thread_id":"a","seq":2}\n{"thread_id":"a","seq":1}\n')
    schema = T.StructType([T.StructField("thread_id", T.StringType()), T.StructField("seq", T.IntegerType())])
    assert [(r.thread_id, r.seq) for r in files.event_log(spark, str(tmp_path), schema).collect()] == [("a", 1), ("a", 2), ("b", 1)]
    raw = spark.createDataFrame([("g", 1, "old", 1), ("g", 1, "new", 2), ("g", 2, "x", 1)], "group string, msg_id int, text string, at int")
    assert sorted(tuple(r) for r in files.last_texts(spark, raw, F.col("at")).collect()) == [("g", 1, "new"), ("g", 2, "x")]


def test_evaluation_tree(spark, tmp_path):
    write(tmp_path, "eval-3/base/run-2/grading.json", {"score": 0.5})
    schema = T.StructType([T.StructField("score", T.DoubleType())])
    assert [tuple(r) for r in files.evaluation_tree(spark, str(tmp_path), schema).collect()] == [(3, "base", 2, 0.5)]


def test_listing_and_grep(spark, tmp_path):
    write(tmp_path, "src/a.py", "one\ntwo needle\n" + "x" * 3000 + "needle")
    write(tmp_path, "src/b.log", "needle")
    write(tmp_path, "node_modules/c.py", "needle")
    write(tmp_path, "src/my.egg-info/d.py", "needle")
    (tmp_path / "src/e.bin").write_bytes(b"needle\x00")
    assert [r.name for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.py", "e.bin"]
    found, more = files.grep(spark, str(tmp_path / "src"), "needle", most=1)
    assert [(r.line_number, r.line) for r in found.collect()] == [(2, "two needle")] and more
    assert spark.range(1).select(files.needs_fallback(F.lit("short"), F.lit(3)), files.needs_fallback(F.lit("x" * 200), F.lit(3))).first() == (True, False)


def test_feed_and_cursor(spark):
    xml = '<feed><entry><id>http://x.org/abs/2401.01234v2</id><title> A\n title </title><author><name>B  C</name></author><category term="cs.CL"/><published>2024-01-02T00:00:00Z</published><summary>s</summary></entry></feed>'
    r = files.atom_entries(spark.createDataFrame([(xml,), ("",)], "x string"), "x").collect()
    assert [tuple(x) for x in r] == [("2401.01234", "A title", ["B C"], ["cs.CL"], "2024-01-02", "s")]
    pages = ['{"cursorType":"Bottom","value":"c1"}', '{"value":"c2","cursorType":"Bottom"}', '{"next_cursor":"c3"}', "{}"]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").orderBy("i").select(files.next_cursor(F.col("p"))).collect()
    assert [x[0] for x in got] == ["c1", "c2", "c3", None]


def test_exports_hold_all_rows(spark, tmp_path):
    df = spark.range(12_000).select("id", F.concat(F.lit("a|b\n"), F.col("id").cast("string")).alias("t"), F.when(F.col("id") > 5, F.lit(1.5)).alias("x"))
    for ending in ("csv", "json", "md"):
        assert sinks.export_file(df, f"{tmp_path}/o/out.{ending}") == 12_000
    assert len(json.loads((tmp_path / "o/out.json").read_text())) == 12_000
    md = (tmp_path / "o/out.md").read_text().splitlines()
    assert len(md) == 12_002 and md[2] == r"| 0 | a\|b 0 | None |"
    assert (tmp_path / "o/out.csv").read_text().count("a|b") == 12_000
    table = sinks.console_table(df)
    assert table.endswith("(12000 rows)") and sinks.console_table(df.limit(0)) == "Query returned 0 rows."
    with pytest.raises(ValueError):
        sinks.export_file(df, f"{tmp_path}/x.xml")
    sinks.export(df.limit(3), f"{tmp_path}/lines.jsonl")
    assert spark.read.json(f"{tmp_path}/lines.jsonl").count() == 3


def test_dual_write_dead_letters_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x\ny "q"')], "i int, t string")
    sinks.dual_write(df, str(tmp_path / "d"))
    assert spark.read.json(f"{tmp_path}/d/json").first().t == 'x\ny "q"'
    assert spark.read.csv(f"{tmp_path}/d/csv", header=True, escape='"').first().t == 'x y "q"'
    sinks.dead_letters(df, "no verdict", str(tmp_path / "dead"))
    sinks.dead_letters(df, "other", str(tmp_path / "dead"))
    assert sorted(r.reason for r in spark.read.json(f"{tmp_path}/dead").collect()) == ["no verdict", "other"]
    page = sinks.html_report("<b>t</b>", {"a<script>": spark.createDataFrame([("</script><i>",)] * 3, "c string")}, most=2)
    assert "<b>" not in page and "<i>" not in page and "the first 2 of 3 rows" in page


def test_stage_counters(spark, tmp_path):
    c = sinks.StageCounters()
    out = c.count(c.count(spark.range(10), "read").where("id > 3"), "kept", most=F.max("id"))
    assert out.count() == 6
    c.write(f"{tmp_path}/a.meta.json")
    assert sinks.read_counters([f"{tmp_path}/a.meta.json", f"{tmp_path}/none.json"]) == {"read": {"rows": 10}, "kept": {"rows": 6, "most": 9}}


GUARDED = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.name')",
    "SELECT java_method('java.lang.System', 'setProperty', 'a', 'b')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.name')",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM parquet.`/tmp/x`",
    "WITH a AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM a",
    "SELECT (SELECT max(value) FROM text.`/etc/hostname`)",
    "SELECT id FROM guard_view WHERE id IN (SELECT reflect('java.lang.System', 'nanoTime'))",
    "SELECT count(*) OVER (ORDER BY reflect('java.lang.System', 'nanoTime')) FROM guard_view",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT * FROM other_view",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'nanoTime'))",
    "SELECT input_file_name() FROM guard_view",
    "SELECT TRANSFORM(id) USING 'cat' FROM guard_view",
    "SELECT * FROM range(3)",
    "SELECT session_user()",
]


@pytest.mark.parametrize("sql", GUARDED)
def test_the_guard_is_closed(spark, sql):
    spark.range(5).createOrReplaceTempView("guard_view")
    spark.range(5).createOrReplaceTempView("other_view")
    with pytest.raises(ValueError):
        catalog.select(spark, sql, views=["guard_view"])


def test_the_guard_lets_reading_through(spark):
    spark.range(50).createOrReplaceTempView("guard_view")
    sql = "WITH a AS (SELECT id % 7 AS k, count(*) AS n, max(upper(cast(id AS string))) AS m FROM guard_view GROUP BY 1) SELECT a.*, row_number() OVER (ORDER BY k) AS r FROM a WHERE k IN (SELECT id FROM guard_view) AND n > (SELECT min(id) FROM guard_view) ORDER BY k"
    got = catalog.select(spark, sql, 4, ["guard_view"])
    assert [r.k for r in got.rows.collect()] == [0, 1, 2, 3] and got.truncated


def database(path, alias, rows):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE tg_intel_filtered (day TEXT, id TEXT, source_platform TEXT, source_group TEXT, risk_type TEXT, risk_level TEXT, summary TEXT, source_url TEXT, entities TEXT)")
        c.executemany("INSERT INTO tg_intel_filtered VALUES (?,?,?,?,?,?,?,?,?)", rows)
        c.execute('CREATE TABLE "odd ""name" (i INTEGER, r REAL, b BLOB, t TEXT)')
        c.executemany('INSERT INTO "odd ""name" VALUES (?,?,?,?)', [(1, 1.5, b"x", "é"), (None, None, None, None), ("no number", 2, "text", 3)])
    return alias


@pytest.fixture
def registry(tmp_path):
    row = lambda i, day, level, kind="spam": (day, str(i), "telegram", f"g{i % 2}", kind, level, "s", "", json.dumps({"accounts": [f"a{i % 3}"], "links": "u"}))
    database(tmp_path / "one.db", "one", [row(i, "2026-01-01", "high") for i in range(4)])
    database(tmp_path / "two.db", "two", [row(i, "2026-01-02", "LOW", "scam") for i in range(3)])
    return write(tmp_path, "federation.yaml", "databases:\n  - alias: one\n    path: one.db\n    owner: me\n  - {alias: two, path: two.db}\n  - {alias: gone, path: none.db}\n")


def test_sqlite_tables(spark, tmp_path):
    database(tmp_path / "x.db", "x", [])
    path = str(tmp_path / "x.db")
    assert sqlite.tables(path) == ['odd "name', "tg_intel_filtered"]
    df = sqlite.read_table(spark, path, 'odd "name', rows=2)
    assert df.dtypes == [("i", "bigint"), ("r", "double"), ("b", "binary"), ("t", "string")] and df.rdd.getNumPartitions() == 2
    assert sorted(((r.i, r.r, r.b and bytes(r.b), r.t) for r in df.collect()), key=repr) == [(1, 1.5, b"x", "é"), (None, 2.0, b"text", "3"), (None, None, None, None)]
    assert sqlite.read_table(spark, path, "tg_intel_filtered").count() == 0
    posts = sqlite.read_platform_posts(spark, path, 'odd "name', {"id": "i", "none": "absent"})
    assert posts.columns == ["id", "none"] and posts.count() == 3


def test_federation_from_the_shell(spark, registry, tmp_path):
    run = lambda *a: cli.run(["federation", *a, "--registry", registry], spark)
    got = json.loads(run("sql", "--sql", "SELECT __db, risk_level, count(*) AS n FROM intel GROUP BY 1, 2 ORDER BY 1"))
    assert got["rows"] == [{"__db": "one", "risk_level": "high", "n": 4}, {"__db": "two", "risk_level": "LOW", "n": 3}] and not got["truncated"]
    assert "error" in json.loads(run("sql", "--sql", "DROP TABLE intel")) and "error" in json.loads(run("sql", "--sql", "SELECT * FROM text.`/etc/hostname`"))
    assert json.loads(run("sql", "--sql", "SELECT * FROM intel_raw"))["row_count"] == 0
    schema = json.loads(run("schema"))
    assert schema["views"]["intel"]["available"] and not schema["views"]["intel_raw"]["available"] and schema["databases"] == ["one", "two", "gone"]
    trends = json.loads(run("trends", "--from", "2026-01-02"))
    assert {(r["day"], r["risk_level"], r["n"]) for r in trends} == {("2026-01-02", "LOW", 3), ("2026-01-02", None, 3), (None, "LOW", 3), (None, None, 3)}
    report = json.loads(run("report"))
    assert report["top_groups"][0] == {"source_group": "g0", "total": 4, "n_met": 2} and report["keyword_heat"][0] == {"risk_type": "spam", "n": 4}
    assert {(e["bucket"], e["value"], e["n"]) for e in report["top_entities"] if e["bucket"] == "links"} == {("links", "u", 7)}
    assert "written" in run("report", "--output-file", f"{tmp_path}/r.html") and "<h2>trends</h2>" in (tmp_path / "r.html").read_text()


def test_registry_resolves_auto(tmp_path, monkeypatch):
    path = write(tmp_path, "r.yaml", "databases:\n  - {alias: a, path: AUTO}\n")
    monkeypatch.delenv("INTEL_HOME", raising=False)
    with pytest.warns(UserWarning):
        assert catalog.read_registry(path) == []
    monkeypatch.setenv("INTEL_HOME", "/x")
    assert catalog.read_registry(path) == [{"alias": "a", "path": "/x/output/intel.db", "owner": ""}]


def test_data_from_the_shell(spark, tmp_path):
    path = write(tmp_path, "my sales-2024.csv", "name,amount\na,1\nb,2\na,\n")
    run = lambda *a: cli.run(["data", *a, "--files", path], spark)
    assert "Rows: 3" in run("inspect") and "amount: 2 / 3" in run("inspect")
    assert "(2 rows)" in run("query", "--sql", "SELECT name, sum(amount) AS s FROM my sales-2024 GROUP BY name")
    assert "'my sales-2024'" not in run("query", "--sql", "SELECT 'my sales-2024' AS t FROM my_sales_2024 LIMIT 1") and "my sales-2024" in run("query", "--sql", "SELECT 'my sales-2024' AS t FROM my_sales_2024 LIMIT 1")
    told = run("query", "--sql", "SELECT nothing FROM my_sales_2024")
    assert told.startswith("SQL Error") and "my_sales_2024 (my sales-2024): name, amount" in told
    assert "3 rows" in run("query", "--sql", "SELECT * FROM my_sales_2024", "--output-file", f"{tmp_path}/out/o.json") and len(json.loads((tmp_path / "out/o.json").read_text())) == 3
    summary = run("summary", "--table", "my sales-2024")
    assert "Total rows: 3" in summary and "  mean    : 1.5000" in summary and "    a: 2 (66.7%)" in summary
    assert "not found" in run("summary", "--table", "x")
    assert "No tables" in cli.run(["data", "inspect", "--files", f"{tmp_path}/none.csv"], spark)
    with pytest.raises(SystemExit):
        run("query")


def test_clusters_from_the_shell(spark, tmp_path):
    path = write(tmp_path, "edges.csv", "a,b\n1,2\n2,3\n7,8\n")
    assert "2 rows" in cli.run(["cluster", "--edges", path], spark)
    assert "5 rows" in cli.run(["cluster", "--edges", path, "--output-file", f"{tmp_path}/c.csv"], spark)


def test_cached_table(spark, tmp_path):
    path = write(tmp_path, "a.csv", "x\n1\n")
    key = catalog.content_key(spark, [path])
    assert catalog.cached_table(spark, [path], f"file://{tmp_path}/cache").count() == 1 and catalog.content_key(spark, [path]) == key
    write(tmp_path, "a.csv", "x\n1\n2\n")
    assert catalog.content_key(spark, [path]) != key and catalog.cached_table(spark, [path], f"file://{tmp_path}/cache").count() == 2


def test_event_append_and_migration(spark):
    events = spark.createDataFrame([("t", "trace", "é" * 10, {"a": "b"}), ("t", "message", "é" * 10, None), ("t", None, "short", None)], "thread_id string, category string, content string, metadata map<string,string>")
    rows = store.append_events(events, None, [F.col("category").asc_nulls_last()], max_trace=5).orderBy("seq").collect()
    assert [(r.seq, r.content) for r in rows] == [(1, "é" * 10), (2, "éé"), (3, "short")]
    assert rows[1].metadata == {"a": "b", "content_truncated": "true", "original_byte_length": "20"}
    with pytest.raises(ValueError):
        store.append_events(events.unionByName(events.withColumn("thread_id", F.lit("u"))), None, [F.col("category")])
    old = spark.createDataFrame([(1, "a"), (2, "b")], "old_id int, t string")
    moved = store.migrate_table(old, spark.createDataFrame([(1, "x")], "id int, t string"), ["id"], [F.col("t")], {"old_id": "id"})
    assert [tuple(r) for r in moved.collect()] == [(2, "b")]


def test_raw_archive_keeps_what_has_no_identity(spark, tmp_path):
    batch = spark.createDataFrame([("d", '{"msg_id": 1}'), ("d", '{"msg_id": 1, "x": 2}'), ("d", "{}"), ("d", "{}"), ("e", '{"msg_id": 1}')], "day string, payload string")
    path = f"file://{tmp_path}/raw"
    assert store.append_raw(batch, path) == 4
    assert store.append_raw(batch, path) == 2 and spark.read.parquet(path).count() == 6


def test_dated_records(spark, tmp_path):
    element = T.StructType([T.StructField("id", T.StringType()), T.StructField("at", T.StringType())])
    write(tmp_path, "x_2024-01-02.json", [{"id": "1", "at": "2023-01-01T00:00"}])
    write(tmp_path, "old.json", {"records": [{"id": "2", "at": "2023-05-06T00:00"}, {"id": "3"}]})
    assert sorted((r.id, r.day) for r in files.dated_records(spark, str(tmp_path), element, "at").collect()) == [("1", "2024-01-02"), ("2", "2023-05-06"), ("3", "unknown")]


def test_graph_and_markdown_report(spark):
    nodes, edges = spark.range(5).withColumn("name", F.lit("n")), spark.createDataFrame([(0, 1), (1, 4)], "a long, b long")
    got = json.loads(sinks.graph_json(nodes, edges, most=3))
    assert [n["id"] for n in got["nodes"]] == [0, 1, 2] and got["links"] == [{"source": 0, "target": 1}]
    assert sinks.markdown_report("T", {"a": nodes.limit(1)}) == "# T\n\n## a\n\n| id | name |\n| --- | --- |\n| 0 | n |\n"

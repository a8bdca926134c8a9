import json
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import aggregate, graph, similarity, store, windows
from orrery.plans import registry
from orrery.sources import catalog, files, sinks


def test_components_and_empty(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "a int, b int")
    assert {r.id: r.component for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_similar_pairs_match_brute_force(spark):
    sets = {i: {f"w{(i * 7 + k) % 23}" for k in range(8 + i % 4)} for i in range(30)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(99, [])], "id int, s array<string>")
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, "id", F.col("s"), 0.6).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_greedy_keep_follows_rank(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "id int, rank int")
    got = {r.id: (r.kept, r.kept_by) for r in similarity.greedy_keep(pairs, ranks).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 3), 5: (True, None)}


def test_five_word_pairs_and_short_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    texts = ["one two", "One  two", "one", " ", None, " ".join(words), " ".join([*words[:-4], *"abcd"])]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    assert {(r.a, r.b, r.similarity) for r in q["jaccard_pairs"](spark, str(tmp_path)).collect()} == {(0, 1, 1.0), (5, 6, round(52 / 60, 9))}
    assert {(r.id, r.component) for r in q["components"](spark, str(tmp_path)).collect()} == {(0, 0), (1, 0), (5, 5), (6, 5)}
    assert {r.id for r in q["greedy_near_dup"](spark, str(tmp_path)).collect() if not r.kept} == {0, 6}


def test_grams_and_words_of_all_documents(spark, tmp_path):
    rows = [(1, "ab\U0001f600cd", "en"), (2, "ab\U0001f600", "de"), (3, None, "fr"), (4, "", "es"), (5, "x", "en"), (6, "the Zug", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    assert {tuple(r) for r in q["ngram_freq"](spark, str(tmp_path)).collect()} == {("ab", 2), ("b\U0001f600", 2), ("ab\U0001f600", 2)}
    assert {tuple(r) for r in q["word_freq_topk"](spark, str(tmp_path)).collect()} == {("ab", 2), ("cd", 1), ("x", 1), ("zug", 1)}


def test_upsert_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(1, -5.0, "a"), (5, 7.0, "b")], "c_custkey long, c_acctbal double, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert {tuple(r) for r in registry.queries()["upsert_merge"](spark, str(tmp_path)).collect()} == {(1, -4.0, "a"), (5, 7.0, "b"), (-5, 8.0, "b")}


def test_insert_or_ignore_twice(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "a", 1), ("d1", "a", 2), ("d2", "a", 3), ("d2", None, 4)], "day string, id string, v int")
    path = f"file://{tmp_path}/t"
    assert store.insert_or_ignore(rows, path, ["day", "id"], [F.col("v")]) == 3
    assert store.insert_or_ignore(rows.where("id IS NOT NULL"), path, ["day", "id"], [F.col("v")]) == 0


def test_paging(spark):
    e = spark.createDataFrame([(i,) for i in range(1, 11)], "seq int")
    page = lambda **k: [r.seq for r in store.page(e, **k).collect()]
    assert page(limit=3) == [8, 9, 10]
    assert page(limit=3, before=5) == [2, 3, 4]
    assert page(limit=3, after=5) == [6, 7, 8]
    assert page(limit=9, after=5, before=8) == [6, 7]


def test_candidates_merge(spark):
    seen = spark.createDataFrame([("k", i, f"s{i}") for i in range(5)], "key string, seen_at int, source string")
    new = aggregate.merge_candidates(seen)
    assert new.first().sources == ["s0", "s1", "s2"] and new.first()["count"] == 5
    known = new.withColumn("status", F.lit("rejected"))
    again = aggregate.merge_candidates(seen, known).first()
    assert again.status == "rejected" and again["count"] == 10


@pytest.mark.parametrize(("n", "expected"), [(30, {"L3": 2, "L1": 10}), (12, {"L3": 2, "L1": 4}), (1, {"L3": 1})])
def test_stratified(spark, n, expected):
    df = spark.createDataFrame([(i, "L3" if i < 2 else "L1") for i in range(40)], "k int, s string")
    got = windows.stratified(df, "k", F.col("s"), n, ["L1", "L2", "L3"], ["L3", "L2", "L1"], 1)
    assert {r.stratum: r["count"] for r in got.groupBy("stratum").count().collect()} == expected


def test_greedy_pick_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, "a", 5), ("g", 2, "b", 9), ("g", 3, "a", 1), ("g", 4, "c", 4)], "g string, r int, k string, c int")
    assert windows.greedy_pick(df, "g", "r", "k", "c", 10, 8, 5).first().picked == ["a", "c"]


def test_nested_comments_with_orphans(spark):
    posts = spark.createDataFrame([("p",), ("q",)], "note_id string")
    c = spark.createDataFrame([("p", "1", None, 1, "top", "u"), ("p", "2", "1", 2, "reply", "v"), ("p", "3", "7", 3, "lost", "w")], "note_id string, comment_id string, parent_comment_id string, create_time int, content string, user_id string")
    rows = {r.note_id: r.comments for r in store.nest_comments(posts, c).collect()}
    assert [(t.content, [x.content for x in t.replies]) for t in rows["p"]] == [("top", ["reply"]), ("[deleted]", ["lost"])]
    assert rows["q"] is None


@pytest.mark.parametrize("sql", ["DROP TABLE x", "INSERT INTO x SELECT 1", "CREATE VIEW v AS SELECT 1", "SET a=b", "SELECT 1; SELECT 2", "nonsense"])
def test_guard_rejects(spark, sql):
    with pytest.raises(ValueError):
        catalog.check_read_only(spark, sql)


def test_guard_allows_and_truncates(spark):
    spark.range(10).createOrReplaceTempView("ten")
    got = catalog.select(spark, "WITH r AS (SELECT id, replace('drop;', 'd', 'x') AS t FROM ten) SELECT * FROM r WHERE id > 1 ORDER BY id", 3)
    assert [r.id for r in got.rows.collect()] == [2, 3, 4] and got.truncated


def test_files_and_federation(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "1 s.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "a" / "1 s.csv").write_text("x\n5\n")
    names, warnings = catalog.register_files(spark, [f"{tmp_path}/1 s.csv", f"{tmp_path}/a/1 s.csv", f"{tmp_path}/none.csv"])
    assert names == {"1 s": "t_1_s", "a/1 s": "t_1_s_1"} and len(warnings) == 1
    assert spark.sql("SELECT sum(x) FROM t_1_s").first()[0] == 3
    both = catalog.federate({n: spark.table(v) for n, v in names.items()})
    assert sorted((r["__db"], r.x, r.y) for r in both.collect())[0] == ("1 s", 1, "a")
    sinks.export(both, f"{tmp_path}/out.md")
    assert (tmp_path / "out.md").read_text().count("\n") == 5
    assert sinks.console_table(both.limit(0)) == "Query returned 0 rows."


def test_nested_payload(spark):
    flat = {"type": "tweet", "tweet_id": 5, "text": "x", "screen_name": "n", "name": "N", "views": "12", "replies": 3, "media": {"photo": [{"media_url_https": "m1"}], "video": [{"media_url": "m2"}, {"media_url": "m2"}]}}
    legacy = {"full_text": "y", "created_at": "d", "id_str": "6", "user_id_str": "1", "lang": "en", "favorite_count": 2, "retweeted_status_id_str": "9", "entities": {"media": [{"expanded_url": "e"}]}}
    again = {"full_text": "other", "created_at": "d", "id_str": "5"}
    doc = {"data": [flat, {"deep": legacy}, again, {"type": "tweet", "tweet_id": ""}, {"users": {"1": {"id_str": "1", "screen_name": "who", "name": "Who"}}}]}
    df = spark.createDataFrame([(json.dumps(doc), "kw"), ("bad", "kw"), (None, None)], "p string, k string")
    got = {r.tweet_id: r for r in files.tweets(df, "p", "k").collect()}
    assert set(got) == {"5", "6"}
    a, b = got["5"], got["6"]
    assert (a.text, a.screen_name, a.user_name, a.view_count, a.reply_count, a.media_urls, a.url, a.source_keyword) == ("x", "n", "N", 12, 3, ["m1", "m2"], "https://twitter.com/n/status/5", "kw")
    assert (b.text, b.screen_name, b.user_name, b.lang, b.favorite_count, b.is_retweet, b.media_urls, b.url) == ("y", "who", "Who", "en", 2, True, ["e"], "https://twitter.com/who/status/6")


def test_list_changes(spark):
    a = spark.createDataFrame([(0, "x", "pending"), (1, "y", "pending"), (2, "z", "pending")], "pos int, content string, status string")
    b = spark.createDataFrame([(0, "x", "in_progress"), (1, "y2", "pending")], "pos int, content string, status string")
    assert {(r.content, r.action) for r in windows.list_changes(a, b).collect()} >= {("x", "start"), ("z", "remove")}


def test_co_occurrences_deal_rows_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_A_TASK", 10)
    rows = [(k, (k * 7 + i) % 23) for k in range(60) for i in range(1 + k % 5)] * 2 + [(None, 1), (3, None)]
    got = graph.co_occurrences(spark.createDataFrame(rows, "k int, id int"), "k", "id", 2, 4)
    nodes = {k: {i for j, i in rows if j == k and i is not None} for k in range(60)}
    expected = Counter((a, b) for s in nodes.values() if 2 <= len(s) <= 4 for a in s for b in s if a < b)
    assert {(r.a, r.b): r.n for r in got.collect()} == expected
    # the pairs' stage has a task for each ten rows
    assert f"hashpartitioning(k, {-(-(len(rows) - 2) // 10)})" in re.sub(r"#\d+L?", "", got._jdf.queryExecution().toString())


def test_co_occurrences_move_few_nodes_of_a_common_key(spark):
    rows = [(0, i) for i in range(500)] + [(1, 1), (1, 2), (2, 1), (2, 2), (2, 9)]
    got = graph.co_occurrences(spark.createDataFrame(rows, "k int, id int"), "k", "id", 2, 3)
    plan = got._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan
    assert {tuple(r) for r in got.collect()} == {(1, 2, 2), (1, 9, 1), (2, 9, 1)}


def test_co_occurrences_leave_no_number_of_tasks_to_spark(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_A_TASK", 50)
    rows = [(0, i) for i in range(300)] + [(1, 5)] * 300 + [(k, k % 7 + i) for k in range(1, 40) for i in range(k % 11)]
    got = graph.co_occurrences(spark.createDataFrame(rows, "k int, id int").repartition(8), "k", "id", 2, 9)
    nodes = {k: {i for j, i in rows if j == k} for k in range(40)}
    expected = Counter((a, b) for s in nodes.values() if 2 <= len(s) <= 9 for a in s for b in s if a < b)
    assert {(r.a, r.b): r.n for r in got.collect()} == expected
    tasks = -(-len(rows) // 50)
    plan = re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())
    assert "ENSURE_REQUIREMENTS" not in plan
    assert all(f"hashpartitioning({by}, {tasks})" in plan for by in ("k, part", "k", "a, b"))


def test_grams_of_repeated_words_are_cut_once(spark):
    texts = ["abcab abcab\tx \U0001f600a\U0001f600a", " abcab\nabc  ", "", None, "abcde"]
    got = aggregate.ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), "text", (2, 4), keep=r"\p{L}")
    grams = Counter(t[i : i + k] for t in texts if t for k in (2, 4) for i in range(len(t) - k + 1))
    expected = {g: n for g, n in grams.items() if n >= 2 and not re.search(r"\s", g) and re.search("[a-z]", g)}
    assert {r.gram: r.n for r in got.collect()} == expected
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(word" in re.sub(r"#\d+L?", "", plan)


def test_similar_classes_stand_for_their_copies(spark):
    sets = {i: frozenset(f"w{(i % 12 * 5 + k) % 29}" for k in range(9 + i % 3)) for i in range(36)}
    df = spark.createDataFrame([(i, sorted(s, reverse=i > 20)) for i, s in sets.items()] + [(None, ["x"]), (99, [])], "id int, s array<string>")
    members, pairs = similarity.similar_classes(df, "id", F.col("s"), 0.3)
    first = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    assert {tuple(r) for r in members.collect()} == {(i, f) for i, f in first.items() if list(first.values()).count(f) > 1}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert {(r.a, r.b): r.similarity for r in pairs.collect()} == {(a, b): like(a, b) for a in set(first.values()) for b in set(first.values()) if a < b and like(a, b) >= 0.3}
    rank = {i: i * 17 % 37 for i in sets}
    kept, by = set(), {}
    for i in sorted(sets, key=rank.get):
        earlier = [j for j in kept if like(i, j) >= 0.3]
        by[i] = min(earlier, key=rank.get) if earlier else None
        if not earlier:
            kept.add(i)
    got = similarity.greedy_keep_classes(members, pairs, spark.createDataFrame(list(rank.items()), "id int, rank int"))
    assert {r.id: (r.kept, r.kept_by) for r in got.collect()} == {i: (i in kept, by[i]) for i in sets}


def _near_copies():
    """Texts of 400 words in groups of eight, some with a few other words, and short ones."""
    rows = []
    for i in range(80):
        w = [f"w{i // 8}x{k * k % 389}" for k in range(400)]
        for k in range(i % 8 * 3):
            w[k * 17] = f"o{i}x{k}"
        rows.append((i, " ".join(w)))
    return [*rows, (80, "one two"), (81, "One\n two "), (82, "two one"), (83, ""), (84, None), (85, "a b c d"), (86, "a b c d e"), (87, "a b c d")]


def test_near_copies_meet_without_written_sets(spark, tmp_path, monkeypatch):
    texts = _near_copies()
    words = {i: (t or "").lower().split() for i, t in texts}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    expected = {(a, b): round(like(a, b), 9) for a in sets for b in sets if a < b and sets[a] and like(a, b) >= 0.8}
    spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    similarity.ensure_checkpoints(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    assert {(r.a, r.b): r.similarity for r in q["jaccard_pairs"](spark, str(tmp_path)).collect()} == expected
    # the sets alone have so many bytes; what is written is of ids and pairs
    assert size() - before < 8 * sum(len(s) for s in sets.values()) / 5
    # in groups of a few pairs, a group's sets are dealt to parts
    monkeypatch.setattr(similarity, "ITEMS_A_GROUP", 900)
    assert {(r.a, r.b): r.similarity for r in q["jaccard_pairs"](spark, str(tmp_path)).collect()} == expected
    # beyond that many ids all is joined by shuffles
    monkeypatch.setattr(similarity, "BROADCAST_IDS", 0)
    assert {(r.a, r.b): r.similarity for r in q["jaccard_pairs"](spark, str(tmp_path)).collect()} == expected


def test_a_set_moves_once_for_a_group_of_near_copies(spark):
    rows = [(100 * g + i, 100 * g + j, 300, 300) for g in range(30) for i in range(12) for j in range(i + 1, 12)]
    met = similarity._meeting(spark.createDataFrame(rows, "a long, b long, n_a long, n_b long"))
    moved = met.select(F.explode(F.array("a", "b")).alias("id"), "at").distinct()
    assert met.count() == len(rows) and moved.count() == 30 * 12
    assert similarity._meeting(met.limit(0).select("a", "b", F.lit(1).alias("n_a"), F.lit(1).alias("n_b"))).count() == 0


def test_pairs_that_share_too_little_of_their_prefixes_are_not_moved(spark, monkeypatch):
    # of 100 items each, two groups: one shares 95, the other its first 30, by whose prefixes alone no pair can be similar
    sets = {i: [f"s{k}" for k in range(95)] + [f"s{i}x{k}" for k in range(5)] for i in range(4)}
    sets |= {i: [f"t{k}" for k in range(30)] + [f"t{i}x{k}" for k in range(70)] for i in range(4, 12)}
    moved = []
    meeting = similarity._meeting
    monkeypatch.setattr(similarity, "_meeting", lambda pairs: moved.extend(pairs.select("a", "b").collect()) or meeting(pairs))
    monkeypatch.setattr(similarity, "_counts", lambda rows, size: np.zeros(1 << similarity.COUNTER_BITS, dtype=np.int64))
    _, pairs = similarity.similar_classes(spark.createDataFrame(list(sets.items()), "id long, s array<string>"), "id", F.col("s"), 0.8)
    expected = {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert {(r.a, r.b) for r in pairs.collect()} == expected == {tuple(r) for r in moved}

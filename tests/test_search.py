import pytest
from pyspark.sql import functions as F

from orrery.operators import aggregate, reports, search, store


@pytest.fixture(scope="module")
def threads(spark):
    rows = [("a", "u1", "idle", '{"k": 1}', 5), ("b", "u1", "busy", '{"k": true}', 5), ("c", None, "idle", '{"k": "1"}', 7), ("d", "u2", "idle", None, 9), ("e", "u1", "idle", '{"k": 1, "x": 2}', 1)]
    return spark.createDataFrame(rows, "thread_id string, user_id string, status string, metadata string, updated_at int")


@pytest.mark.parametrize(
    ("asked", "expected"),
    [
        ({}, ["d", "c", "b", "a", "e"]),
        ({"user": "u1"}, ["b", "a", "e"]),
        ({"status": "idle", "metadata": {"k": 1}}, ["a", "e"]),
        ({"metadata": {"k": True}}, ["b"]),
        ({"metadata": {"k": 1, "x": 2}}, ["e"]),
        ({"limit": 2, "offset": 1}, ["c", "b"]),
        ({"metadata": {}}, ["d", "c", "b", "a", "e"]),
    ],
)
def test_thread_search(threads, asked, expected):
    assert [r.thread_id for r in search.search_threads(threads, **asked).collect()] == expected


def test_thread_search_leaves_unsafe_keys_out(threads):
    with pytest.warns(UserWarning):
        assert [r.thread_id for r in search.search_threads(threads, metadata={"k": 1, "a.b": 2, "k2": [1]}).collect()] == ["a", "e"]
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="a.b, x;y"):
        search.search_threads(threads, metadata={"x;y": 1, "a.b": 2})


def test_access(spark, threads):
    asked = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("c", "u2"), ("gone", "u1"), ("a", None)], "thread_id string, user_id string")
    got = lambda strict: {(r.thread_id, r.user_id): r.allowed for r in search.check_access(asked, threads, strict).collect()}
    assert got(False) == {("a", "u1"): True, ("a", "u2"): False, ("c", "u2"): True, ("gone", "u1"): True, ("a", None): False}
    assert got(True)["gone", "u1"] is False


@pytest.mark.parametrize(
    ("query", "expected"),
    [("select:web_fetch, read", ["read", "web_fetch"]), ("select:none", []), ("+web", ["web_search", "web_fetch"]), ("+WEB page", ["web_fetch", "web_search"]), ("+", []), ("  ", []), ("READ", ["read", "web_fetch"]), ("fetch(", []), ("search|page", ["web_search", "web_fetch"])],
)
def test_catalogue(spark, query, expected):
    c = spark.createDataFrame([(0, "web_search", "find things"), (1, "read", None), (2, "web_fetch", "read a page, any page")], "position int, name string, description string")
    assert [r.name for r in search.search_catalogue(c, query).collect()] == expected


def test_verdicts_by_place(spark):
    replies = spark.createDataFrame([(1, "0:1\n1 ： 0\n1:1 12:0 x:1"), (2, None)], "batch int, reply string")
    told = search.verdicts(replies, "batch", "reply")
    assert sorted(tuple(r) for r in told.collect()) == [(1, 0, 1), (1, 1, 1), (1, 12, 0)]
    items = spark.createDataFrame([(1, 12), (1, 3), (2, 0)], "batch int, index int")
    assert sorted((r.batch, r["index"], r.verdict) for r in search.apply_verdicts(items, told, "batch").collect()) == [(1, 3, 1), (1, 12, 0), (2, 0, 1)]
    joined, lost = store.zip_verdicts(items, told, "batch", "index")
    assert joined.count() == 1 and sorted((r.batch, r["index"], r.reason) for r in lost.collect()) == [(1, 3, "no verdict"), (2, 0, "no verdict")]


def test_thresholds(spark):
    df = spark.createDataFrame([("g", 50), ("g", 61), ("h", 60), ("i", None)], "g string, risk int")
    assert search.above_risk(df, "risk", 50).count() == 2 and search.above_risk(df, "risk", 0).count() == 4
    assert {r.g for r in search.groups_above(df, "g", "risk", 60).collect()} == {"g"} and search.groups_above(df, "g", "risk", 60).count() == 2
    levels = spark.createDataFrame([("high",), ("medium",), ("low",), ("x",), (None,)], "c string")
    assert [search.confident(levels, "c", k).count() for k in ("high", "medium", "low")] == [1, 2, 3]


def test_cache(spark):
    df = spark.createDataFrame([("a:1", 5), ("a:2", 15), ("b.1", None)], "key string, expires_at int")
    live = lambda p: sorted(r.key for r in search.live_entries(df, F.lit(10), p).collect())
    assert live("*") == ["a:2", "b.1"] and live("a:*") == ["a:2"] and live("b?1") == [] and live("b.1") == ["b.1"]


def test_candidates_with_their_sources(spark):
    c = spark.createDataFrame([("k", 3, [("g", 1), ("h", 2)]), ("l", 9, []), ("m", 5, [("x", 7)])], "key string, count int, sources array<struct<group:string,msg_id:int>>")
    rep = spark.createDataFrame([("g", 4, 1, 9)], "group string, high int, medium int, total int")
    assert sorted((r.key, r.group or "", r.high, r.total) for r in search.with_reputation(c, rep).collect()) == [("k", "g", 4, 9), ("k", "h", 0, 0), ("l", "", 0, 0), ("m", "x", 0, 0)]
    raw = spark.createDataFrame([("g", 1, "said")], "group string, msg_id int, text string")
    assert sorted((r.key, r.position, r.text or "") for r in search.with_raw_text(c, raw).collect()) == [("k", 0, "said"), ("k", 1, ""), ("m", 0, "")]
    assert [(r.key, r.score) for r in search.best_candidates(c, rep, 5).collect()] == [("k", 12), ("m", 5)]


def test_groups_of_a_report(spark):
    rows = [(1, "tg", "g", "", "HIGH"), (2, "tg", "g", "u2", "low"), (3, None, "", "u3", "odd"), (4, "tg", "g", "u4", None)]
    df = spark.createDataFrame(rows, "at int, source_platform string, source_group string, source_group_url string, risk_level string")
    assert [tuple(r) for r in reports.report_groups(df, "at").collect()] == [("tg", "g", "u2", 1, 0, 1, 3), ("unknown", "(未知来源)", "u3", 0, 0, 0, 1)]


def test_merged_terms_keep_the_better_type(spark):
    known = spark.createDataFrame([("aa", 2, reports.MODEL_TERM, ["p"], ["c"]), ("bb", 5, "own", [], [])], "term string, n long, type string, platforms array<string>, categories array<string>")
    found = spark.createDataFrame([(0, " aa ", reports.MODEL_TERM, "1"), (1, "aa", "better", "2"), (2, "bb", "other", None), (3, "x", "short", "1"), (4, "cc", None, "9"), (5, None, "t", "1")], "position int, term string, type string, note_id string")
    records = spark.createDataFrame([("1", ["q"], ["d"]), ("2", ["p"], ["c", "e"])], "note_id string, platforms array<string>, categories array<string>")
    got = [(r.term, r.n, r.type, r.platforms, r.categories) for r in reports.merge_terms(known, found, records).collect()]
    assert got == [("bb", 6, "own", [], []), ("aa", 4, "better", ["p", "q"], ["c", "d", "e"]), ("cc", 1, reports.MODEL_TERM, [], [])]


def test_sellers_and_funnel(spark):
    rows = [("s", "x", ["b", "a"], "f", "abcdef", "first", "l1", 1), ("s", "y", ["c"], "", "abc", "second", "l2", 2), ("s", "y", [], None, "abcdef", "third", "l3", 3), (" ", "z", [], "", "", "", "", 4)]
    df = spark.createDataFrame(rows, "seller string, area string, segment array<string>, image_fp string, template string, title string, link string, at int")
    r = reports.seller_features(df, "at").collect()
    assert len(r) == 1 and (r[0].n, r[0].area, r[0].segments, r[0].image_fp, r[0].templates, r[0].template, r[0].first_title, r[0].first_link) == (3, "y", ["a", "b", "c"], "f", ["abcdef"], "abcdef", "first", "l1")
    f = reports.funnel(spark.createDataFrame([(1, "a", 8), (2, "b", 4), (3, "c", 0)], "position int, stage string, n long")).collect()
    assert [(x.of_first, x.of_before) for x in f] == [(100.0, None), (50.0, 50.0), (0.0, 0.0)]


def test_demand_and_tags(spark):
    df = spark.createDataFrame([([("how much",), (None,), ("nice",), ("price?",)],), (None,)], "comments array<struct<content:string>>")
    got = df.select(reports.demand_signals(F.col("comments"), ["much", "price"], 1).alias("s")).collect()
    assert (got[0].s.inquiries, [c.content for c in got[0].s.samples]) == (2, ["how much"]) and got[1].s.inquiries == 0
    tags = lambda *a: spark.range(1).select(reports.risk_tags(*a)).first()[0]
    zero, none = F.lit(0), F.array().cast("array<string>")
    assert tags(zero, zero, zero, F.lit(4), none, zero) == ["评论区导流"]
    assert tags(F.lit(1), F.lit(1), F.lit(1), F.lit(5), F.array(F.lit("违规技术")), F.lit(2)) == list(reports.TAGS)
    assert tags(zero, zero, F.lit(None), F.lit(None), none, zero) == []


def test_summary_by_sketch_and_places(spark):
    df = spark.range(10_001).select(F.col("id").alias("x"))
    exact, sketch = aggregate.numeric_summary(df, ["x"]).first(), aggregate.numeric_summary(df, ["x"], accuracy=1000).first()
    assert exact.median == 5000 and all(abs(exact[c] - sketch[c]) <= 11 for c in ("q25", "median", "q75")) and exact.n == sketch.n
    got = aggregate.places(spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "k int, v int"), "v", "k")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (2, 1), (3, 3)]


def test_last_visible_and_raw_identity(spark):
    m = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("b", False, 1), ("b", False, 2), (None, False, 3)], "id string, visible boolean, i int")
    assert sorted(((r.id or "", r.i) for r in store.keep_last_visible(m, "id", "visible", "i").collect())) == [("", 3), ("a", 1), ("b", 2)]
    p = spark.createDataFrame([(i, x) for i, x in enumerate(['{"msg_id": 5, "tweet_id": 6}', '{"tweet_id": "t"}', "{}", None])], "i int, p string")
    assert [r[0] for r in p.orderBy("i").select(store.raw_identity(F.col("p"))).collect()] == ["msg_id:5", "tweet_id:t", None, None]

import pytest
from pyspark.sql import functions as F

from orrery.functions import extract, markdown, text, values


def one(spark, c, **row):
    keys = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], keys).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(("t", "expected"), [("thing alpha buy", True), ("ALPHA BUY", True), ("alpha only", False), ("buy only", False), ("", False), (None, False)])
def test_two_dimensional_match(spark, t, expected):
    assert one(spark, text.two_dimensional_match(F.col("t"), ["alpha"], ["buy"]), t=t) is expected


@pytest.mark.parametrize(("t", "zeros", "scaled", "first"), [("12", 12, 12, 12), ("1.2w", 0, 12000, 1), ("3万", 30000, 30000, 3), ("10+", 0, 10, 10), ("", 0, 0, 0), (None, 0, 0, 0)])
def test_count_parsers_differ(spark, t, zeros, scaled, first):
    got = spark.createDataFrame([(t,)], "t string").select(text.count_zeros(F.col("t")), text.count_scaled(F.col("t")), text.count_first_digits(F.col("t"))).first()
    assert tuple(got) == (zeros, scaled, first)


def test_replacements_run_in_order(spark):
    assert one(spark, text.fold_replacements(F.col("t"), {"a": "b", "b": "c"}), t="ab") == "cc"


@pytest.mark.parametrize("size", range(1, 9))
def test_truncate_utf8_keeps_whole_characters(spark, size):
    t = "aé漢😀z"
    assert one(spark, text.truncate_utf8(F.col("t"), size), t=t) == t.encode()[:size].decode("utf-8", "ignore")


def keys(rows):
    return [(r.key, r.channel) for r in rows]


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("see https://t.me/Some_Name/12 and https://t.me/+AbC @other_one @abc https://t.me/joinchat/Z-1 @own_group", [("+AbC", "text"), ("+Z-1", "text"), ("some_name", "text"), ("other_one", "text"), ("forwarded", "forward")]),
        ("@addtheme https://t.me/TelegramBot https://t.me/joinchat @setlanguage", [("setlanguage", "text"), ("forwarded", "forward")]),
        ("@" + "x" * 40 + " me@mail_host.org https://t.me/" + "y" * 33, [("forwarded", "forward")]),
        ("@Forwarded https://t.me/FORWARDED/3", [("forwarded", "text")]),
        (None, [("forwarded", "forward")]),
    ],
)
def test_mined_references(spark, said, expected):
    assert keys(one(spark, text.mined_references(F.col("t"), F.lit("Forwarded"), F.lit("own_group")), t=said)) == expected


def test_mined_references_of_the_own_group_and_without_a_forward(spark):
    assert keys(one(spark, text.mined_references(F.col("t"), F.lit(None).cast("string"), F.lit("Own_Group")), t="https://t.me/own_group @OWN_group")) == []


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ("广告: buy\n🌄 X! https://t.me/chan_one/12345\n  🎬 [00:09] film\nheader\n💬", [("🌄", "X! https://t.me/chan_one/12345", "https://t.me/chan_one/12345", 12345), ("🎬", "[00:09] film", None, None)]),
        ("🔥 see https://t.me/chan_one or https://t.me/+abc", [("🔥", "see https://t.me/chan_one or https://t.me/+abc", "https://t.me/chan_one", None)]),
        (" plain\n\n广告：x\nmore ", [(None, "plain\nmore", None, None)]),
        ("广告:only", []),
        ("  \n ", []),
        (None, []),
    ],
)
def test_bot_previews(spark, reply, expected):
    assert [(p.icon, p.text, p.deeplink, p.msg_id) for p in one(spark, text.bot_previews(F.col("t")), t=reply)] == expected


def test_call_hash_is_of_the_multiset(spark):
    call = lambda name, args: (name, args)
    sets = {
        "a": [call("read_file", '{"path":"x","start_line":1,"end_line":50}'), call("search", '{"query":"q","note":1}')],
        "a2": [call("search", '{"note":2,"query":"q"}'), call("read_file", '{"path":"x","start_line":"180","end_line":2}')],
        "b": [call("read_file", '{"path":"x","start_line":201}'), call("search", '{"query":"q"}')],
        "c": [call("search", '{"query":"q"}')],
        "c2": [call("search", '{"query":"q"}')] * 2,
        "w": [call("write_file", '{"path":"x","content":"1"}')],
        "w2": [call("write_file", '{"path":"x","content":"2"}')],
        "w3": [call("write_file", '{"content":"1","path":"x"}')],
        "n": [call("ls", "no json")],
        "z": [],
    }
    df = spark.createDataFrame(list(sets.items()), "k string, calls array<struct<name:string,arguments:string>>")
    h = {r.k: r.h for r in df.select("k", text.call_hash(F.col("calls")).alias("h")).collect()}
    assert h["a"] == h["a2"] and h["w"] == h["w3"] and all(len(x) == 12 for x in h.values())
    assert len({h[k] for k in ("a", "b", "c", "c2", "w", "w2", "n", "z")}) == 8


def test_call_key_parses_each_argument_once(spark):
    keys = [
        ("read_file", '{"path":"x","start_line":401,"end_line":3}', "x:0-2"),
        ("read_file", '{"p\\u0061th":"x","st\\u0061rt_line":"5"}', "x:0-0"),
        ("read_file", "{'path':'x','end_line':900}", "x:0-4"),
        ("read_file", '{"path":null,"url":"u"}', "url=u"),
        ("read_file", None, ""),
        ("search", '{"qu\\u0065ry":"q","cmd":"c"}', "cmd=c\x01query=q"),
        ("search", '{"b":"path","a":1}', '[{"key":"a","value":"1"},{"key":"b","value":"path"}]'),
        (None, '{"url":"u"}', "url=u"),
        ("str_replace", '{"path":"x"}', '[{"key":"path","value":"x"}]'),
    ]
    df = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(keys)], "i int, n string, a string")
    found = df.select("i", text.call_key(F.col("n"), F.col("a")).alias("k"))
    assert {r.i: r.k for r in found.collect()} == {i: k for i, (_, _, k) in enumerate(keys)}
    # of a read: path and the ends of its lines, once each; of what has no path, and of other calls, the seven telling ones
    assert found._jdf.queryExecution().analyzed().toString().count("get_json_object") <= 17


def test_marks_of_listings_and_addresses(spark):
    got = spark.range(1).select(
        text.image_fingerprint(F.lit("https://x/O1CN01abcdefghijklmnop_!!9.jpg")), text.image_fingerprint(F.lit(None).cast("string")), text.hour_bucket(F.lit("2024-01-31 07:15")), text.hour_bucket(F.lit("31.1.2024")),
        text.profile_url(F.lit(""), F.lit("https://x.com/who/status/1"), F.lit("Twitter")), text.profile_url(F.lit("g"), F.lit("u"), F.lit("twitter")), text.profile_url(F.lit(None).cast("string"), F.lit("https://t.me/souso"), F.lit("telegram")),
        text.title_template(F.lit("抖币充值 100% 秒到账快速安全可靠放心")), text.url_parameters(F.lit("http://a/?q=a%20b+c&x=%E6%BC%A2&q=z&bad=%zz#f=1")),
    ).first()
    assert tuple(got) == ("O1CN01abcdefghijkl", "", "2024-01-31 07h", "", "https://x.com/who", "g", "", "抖币充值秒到账快速安全可"[:12], {"q": "z", "x": "漢", "bad": "%zz"})


def test_small_text_functions(spark):
    c = F.col("t")
    assert one(spark, text.deep_link(c), t="see t.me/Chan_one/77").asDict() == {"channel": "chan_one", "msg_id": 77}
    assert one(spark, text.content_text(c), t='["a", {"type":"text","text":"b"}, {"type":"image"}]') == "a\nb" and one(spark, text.content_text(c), t="plain") == "plain"
    assert one(spark, text.strip_fence(c), t="```json\n{}\n```") == "{}" and one(spark, text.strip_fence(c), t=" x ") == "x"
    assert one(spark, text.excerpt(c, F.lit("word"), 3, 4), t="0123456 word 0123456") == "56 word 012" and one(spark, text.excerpt(c, F.lit("none")), t="x") is None
    assert one(spark, text.linkify(c), t="<b> http://a.b/?x=1 'q'") == "&lt;b&gt; <a href=\"http://a.b/?x=1\">http://a.b/?x=1</a> &#39;q&#39;"
    assert one(spark, text.head_tail(c, 4, "|"), t="0123456789") == "01|89" and one(spark, text.head_tail(c, 10), t="0123456789") == "0123456789"
    assert one(spark, text.line_range(c, 2, 3), t="a\nb\nc\nd") == "b\nc" and one(spark, text.line_range(c, 3, 2), t="a\nb\nc") == ""
    assert one(spark, text.fingerprint(c), t="Ab-1 漢") == ["ab1", "b1漢"] and one(spark, text.fingerprint(c), t="a") == ["a"] and one(spark, text.fingerprint(c), t="!") == []
    assert one(spark, text.listing_key(F.lit(None), c, F.lit("s"), F.lit("x")), t="http://a/?id=42&b") == "42" and one(spark, text.listing_key(F.lit(None), c, F.lit("s"), F.lit("x")), t="http://a") == "s|x"
    assert text.safe_pattern("a(") == r"a\(" and text.safe_pattern("a.b") == "a.b"
    assert one(spark, text.matched_words(c, ["Ab", "x", "b"]), t="aB") == ["Ab", "b"] and one(spark, text.matched_words(c, ["a"], False), t="A") == []
    assert one(spark, text.segment_signature(c, ["b", "a", "z"], 2), t="zab") == ["a", "b"]


def test_small_value_functions(spark):
    c = F.col("t")
    assert [one(spark, values.coerce_iso(c), t=t) for t in ("1700000000", "2024-01-02 03:04:05", "soon", None)] == ["2023-11-14T22:13:20Z", "2024-01-02T03:04:05Z", "soon", None]
    assert str(one(spark, values.mail_time(c), t="Wed Oct 10 20:19:24 +0000 2018")) == "2018-10-10 20:19:24" and one(spark, values.mail_time(c), t="x") is None
    assert [one(spark, values.day_of(c, F.lit("2024-05-06T07:00"), ), t=t) for t in ("x_2024-01-02.json", "x.json")] == ["2024-01-02", "2024-05-06"]
    assert one(spark, values.day_of(c, F.lit("later")), t="x") == "unknown"
    assert [one(spark, values.clamp(c.try_cast("double")), t=t) for t in ("0.5", "7", "-1", "NaN", "x")] == [0.5, 1.0, 0.0, 0.0, 0.0]
    probe = lambda status, names: spark.range(1).select(values.probe_class(F.lit(status), F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.lit("Key"))).first()[0]
    assert [probe("error", []), probe("empty", []), probe("ok", ["x", "KEY"]), probe("ok", ["x"]), probe("ok", [])] == ["error", "empty_reply", "direct_hit", "indirect_hit", "no_results"]
    assert spark.range(1).select(values.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")))).first()[0] == ["b", "a", "c"]
    with pytest.raises(TypeError):
        values.json_matches(c, "k", {"a": 1})
    with pytest.raises(ValueError):
        values.json_matches(c, "k.x", 1)


def test_json_matches_keep_types_apart(spark):
    docs = ["{}", '{"k":null}', '{"k":true}', '{"k":1}', '{"k":1.0}', '{"k":1.5}', '{"k":"1"}', "nonsense", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    hit = lambda v: sorted(r.i for r in df.where(values.json_matches(F.col("d"), "k", v)).collect())
    assert hit(None) == [1]
    assert hit(True) == [2]
    assert hit(1) == [3]
    assert hit("1") == [6]
    assert hit(1.5) == [5]
    assert 3 in hit(1.0)


def test_risk_score_rounds_half_even_and_caps(spark):
    got = spark.range(1).select(values.risk_score(F.array(F.lit(30), F.lit(10)), F.lit(5), F.lit(True), F.lit(1), F.lit(0), F.lit(0)), values.risk_score(F.array(F.lit(90)), F.lit(0), F.lit(False), F.lit(0), F.lit(0), F.lit(0))).first()
    assert tuple(got) == (round(2.2 * (30 + 4 + 18 + 8 + 2)) if 2.2 * 62 < 100 else 100, 100)


def test_ladder_and_maps(spark):
    got = spark.range(1).select(values.ladder(F.lit("high"), F.lit(1)), values.ladder(F.lit("low"), F.lit(3)), values.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)))).first()
    assert tuple(got) == ("medium", "low", {"a": 1, "b": 2})


def test_prices_and_contacts(spark):
    df = spark.createDataFrame([("sell at 12元 each box, call me: ab1234567 call again ab1234567", ), (None,)], "t string")
    rows = df.select(extract.prices(F.col("t"), ["box"]).alias("p"), extract.contacts(F.col("t"), {"id": (["call"], r"[a-z]{2}\d{5,}")}).alias("c")).collect()
    assert rows[0].p[0].amount == 12.0 and rows[0].p[0].near_unit == "box"
    assert [(c.type, c.value) for c in rows[0].c] == [("id", "ab1234567")]
    assert rows[1].p == [] and rows[1].c == []


def snap(text, pos):
    if pos <= 0 or pos >= len(text):
        return pos
    at = text.rfind("\n", pos // 2, pos)
    return at + 1 if at >= 0 else pos


@pytest.mark.parametrize(("head", "tail"), [(10, 5), (0, 7), (50, 50), (7, 0), (3, 30)])
def test_previews_are_cut_at_line_ends(spark, head, tail):
    texts = ["", "short", "line one\nline two\nline three\nline four", "x" * 60, "é\n" * 25, "a" * 30 + "\n" + "b" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", text.preview(F.col("t"), head, tail, "<%d>").alias("p")).collect()}
    for i, t in enumerate(texts):
        first = snap(t, min(head, len(t)))
        last = max(first, len(t) - tail)
        last = snap(t, last) if snap(t, last) > first else last
        assert got[i] == f"{t[:first]}<{last - first}>{t[last:]}"


@pytest.mark.parametrize("most", [0, 20, 48, 60, 100])
def test_truncations_keep_their_bound(spark, most):
    t = "0123456789" * 9
    middle, head = one(spark, text.truncated_middle(F.col("t"), most), t=t), one(spark, text.truncated_head(F.col("t"), most, "x"), t=t)
    assert (middle == head == t) if most in (0, 100) else len(middle) <= most and len(head) <= most and middle[:1] == head[:1] == "0"
    if most == 60:
        assert "chars skipped" in middle and middle.endswith("9")


def test_arrays_and_trees(spark):
    assert one(spark, text.first_array(F.col("t")), t="```json\nsee [1, [2]] end\n```") == "[1, [2]]" and one(spark, text.first_array(F.col("t")), t="none") is None
    entries = [("a", "tree"), ("a/b.txt", "blob"), ("a/c/d", "tree"), ("a/c/d/e.txt", "blob")]
    df = spark.createDataFrame([(entries,)], "e array<struct<path:string,type:string>>")
    assert df.select(text.directory_tree(F.col("e"))).first()[0] == "a/\n  b.txt\n    d/" and df.select(text.directory_tree(F.col("e"), 9, 1)).first()[0] == "a/"


def test_articles_as_markdown(spark):
    page = "<html><head><title> A  &amp; B </title><script>x</script></head><body><nav>menu</nav><article><h2>Head</h2><p>One <b>bold</b> <a href='/l'>link</a><br>two<ul><li>x<li>y</ul><img src='i.png' alt='p'><script>no</script></article><footer>f</footer>"
    want = "# A & B\n\n## Head\n\nOne **bold** [link](/l)  \ntwo\n\n* x\n* y\n\n![p](i.png)\n"
    assert markdown.to_markdown(page) == want
    assert markdown.to_markdown(None) == markdown.to_markdown("") == "# Untitled\n\n*No content available*\n" and markdown.to_markdown("<p>x", False) == "x\n"
    df = spark.createDataFrame([(page, "http://h/d/"), (None, None)], "p string, u string").withColumn("m", markdown.article_markdown(F.col("p")))
    rows = df.select(markdown.message_parts(F.col("m"), F.col("u")).alias("x")).collect()
    assert [(x.type, x.url) for x in rows[0].x] == [("text", None), ("image_url", "http://h/d/i.png")] and rows[1].x[0].text.startswith("# Untitled")


def test_repository_summary(spark):
    row = ('{"full_name":"o/r","stargazers_count":5,"license":{"spdx_id":"MIT"},"topics":["a"]}', '{"Py":3}', "[{},{}]", '[{"tag_name":"v2","name":"n","published_at":"d"},{"tag_name":"v1"}]')
    df = spark.createDataFrame([row, ("{}", None, "[]", "[]")], "i string, l string, c string, r string")
    a, b = [r.s for r in df.select(values.repository_summary(*map(F.col, "ilcr")).alias("s")).collect()]
    assert (a.name, a.stars, a.license, a.topics, a.languages, a.contributors, a.latest_release.tag) == ("o/r", 5, "MIT", ["a"], {"Py": 3}, 2, "v2")
    assert (b.name, b.topics, b.languages, b.contributors, b.latest_release) == (None, [], {}, 0, None)

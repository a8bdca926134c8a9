"""The step runner, and the posts job against a plain version of it."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery import cli
from orrery.functions import extract
from orrery.jobs import posts, steps

LEXICON = {
    "obfuscation_map": {"_comment": "x", "v-x": "vx", "c@sh": "cash"},
    "business_categories": {"accounts": {"weight": 9, "keywords": ["Account", "login"]}, "cash": {"weight": 6, "keywords": ["cash"]}, "bots": {"weight": 4, "keywords": ["bot"]}},
    "platforms": {"red": ["redbook"], "blue": ["BLUE"]},
    "platform_jargon": ["mk", "fz"],
    "price_patterns": {"money_regex": r"(\d+(?:\.\d+)?)\s?(?:usd|eur)", "unit_regex": r"(?:per |a )?(?:piece|month)"},
    "contact_patterns": {"_comment": "x", "vx": {"trigger_words": ["vx", "add"], "id_regex": r"[a-z]{2}\d{4,}"}, "phone": {"trigger_words": ["call"], "id_regex": r"1[3-9]\d{9}"}},
    "demand_signal_keywords": {"keywords": ["how much", "want"]},
    "scam_disguise_keywords": {"keywords": ["no fraud"]},
}


def make_posts(n=120, seed=1):
    rng = random.Random(seed)
    fill = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    out = []
    for i in range(n):
        words = [rng.choice(fill) for _ in range(12)] + rng.sample(["Account", "login", "c@sh", "bot", "redbook", "Blue", "mk", "no fraud", "12 usd per piece", "3.5 EUR", "add ab12345", "v-x: cd99999", "13812345678", "nothing", "#tag#", "[hiR]"], rng.randint(0, 7))
        rng.shuffle(words)
        out.append(
            {
                "note_id": None if i % 17 == 0 else f"n{i % 100}",
                "platform": "p",
                "source_keyword": rng.choice(["k1", "k2", None]),
                "author": {"user_id": f"u{rng.randint(0, 60)}", "nickname": f"nick{i % 50}", "ip_location": rng.choice(["A", "B", ""])},
                "content": {"title": f"Title {i}", "desc": " ".join(words)},
                "stats": {"liked_count": str(rng.randint(0, 900)), "collected_count": rng.choice(["1w", "3", None, "x"]), "comment_count": "10+", "share_count": "0"},
                "comments": [{"user": "c", "content": rng.choice(["how much is it", "I want one", "nice", None, "login please"]), "like_count": "1"} for _ in range(rng.randint(0, 9))],
                "involved_user_ids": [f"i{rng.randint(0, 200)}"] if i % 3 == 0 else None,
            }
        )
    for i in range(5):  # near copies
        out.append({**out[i + 1], "note_id": f"copy{i}", "content": {"title": out[i + 1]["content"]["title"], "desc": out[i + 1]["content"]["desc"] + "."}, "stats": {"liked_count": "1"}})
    return out


@pytest.fixture
def folder(tmp_path):
    notes = make_posts()
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text(json.dumps(notes[:60]))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"notes": notes[60:-1]}))
    (tmp_path / "in" / "deep" / "c.json").write_text(json.dumps(notes[-1]))
    (tmp_path / "in" / "bad.json").write_text("{no json")
    (tmp_path / "lexicon.json").write_text(json.dumps(LEXICON))
    return tmp_path


def number(v):
    s = re.sub("w|万", "0000", str(v if v is not None else 0).replace("+", ""))
    return int(s) if re.fullmatch(r"\d+", s) else 0


def tidy(s):
    return re.sub(r"\s+", " ", re.sub(r"#[^#\s]+#?|\[[^\[\]]{1,12}\]", " ", s)).strip()


def grams(s):
    s = re.sub(r"[^a-z0-9]", "", s.lower())
    return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else {s} if s else set()


def plain(rows, min_risk, min_peak):
    """The same job over lists; rows as load() gives them."""
    best, none = {}, []
    for r in sorted(rows, key=lambda r: r["row"]):
        if not r["note_id"]:
            none.append(r)
        elif r["note_id"] not in best or r["engagement"] > best[r["note_id"]]["engagement"]:
            best[r["note_id"]] = r
    single = sorted([*best.values(), *none], key=lambda r: (-r["engagement"], r["row"]))
    kept = []
    for r in single:
        g = grams(r["full_text"])
        twin = next((k for k in kept if len(g & k["g"]) >= 0.92 * len(g | k["g"])), None)
        if twin:
            twin["copies"] += 1
        else:
            kept.append({**r, "g": g, "copies": 0})
    records = []
    for r in kept:
        comments = [c["content"] for c in r["comments"] or [] if c["content"]]
        body = "\n".join([r["full_text"], *comments]).replace("v-x", "vx").replace("c@sh", "cash")
        low = body.lower()
        cats = {n: sorted({k for k in c["keywords"] if k.lower() in low}) for n, c in LEXICON["business_categories"].items()}
        cats = {n: k for n, k in cats.items() if k}
        if not cats:
            continue
        units = [(m.group(), m.start()) for m in re.finditer(LEXICON["price_patterns"]["unit_regex"], body, re.I)]
        prices = []
        for m in re.finditer(LEXICON["price_patterns"]["money_regex"], body, re.I):
            unit = next((u for u, at in units if abs(at - m.start()) <= 25), "").strip()
            if (m.group(1), unit) not in prices:
                prices.append((m.group(1), unit))
        contacts = {("phone", m.group()) for m in re.finditer(r"1[3-9]\d{9}", body)}
        for t in re.finditer("vx|add", body, re.I):
            if m := re.search(r"[a-z]{2}\d{4,}", body[t.end() : t.end() + 40]):
                contacts.add(("vx", m.group()))
        inquiries = sum("how much" in c or "want" in c for c in comments)
        weights = sorted((LEXICON["business_categories"][n]["weight"] for n in cats), reverse=True)
        scams, jargon = body.count("no fraud") > 0, sum(j in body for j in ("mk", "fz"))
        score = weights[0] + sum(0.4 * w for w in weights[1:]) + min(len(contacts), 3) * 6 + (8 if prices else 0) + min(inquiries, 10) * 2 + scams * 5 + min(jargon, 5) * 2
        records.append({**r, "cats": cats, "prices": prices, "contacts": contacts, "inquiries": inquiries, "risk": min(round(score * 2.2), 100)})
    intel = len(records)
    records = [r for r in records if r["risk"] > min_risk]
    by = defaultdict(set)
    for r in records:
        keys = [("a", r["author"]["user_id"]), *[("c", c) for c in r["contacts"]], *[("u", u) for u in r["involved_user_ids"] or []]]
        for k in keys:
            by[k].add(r["row"])
    component = {r["row"]: r["row"] for r in records}
    moved = True
    while moved:
        moved = False
        for group in by.values():
            least = min(component[x] for x in group)
            for x in group:
                if component[x] != least:
                    component[x], moved = least, True
    gangs = defaultdict(list)
    for r in records:
        gangs[component[r["row"]]].append(r)
    gangs = [g for g in gangs.values() if max(r["risk"] for r in g) > min_peak]
    counts = {"after_id_dedup": len(single), "kept": len(kept), "intel": intel, "above_risk": len(records), "gangs": len(gangs), "records": sum(map(len, gangs))}
    return records, gangs, counts


def test_posts_job_against_a_plain_version(spark, folder):
    results, counts = posts.run(spark, str(folder / "in"), str(folder / "lexicon.json"), str(folder / "out"), min_risk=40, min_peak_risk=60)
    rows = [r.asDict(recursive=True) for r in results["load"].table.collect()]
    assert len(rows) == 125 and all(r["full_text"] == tidy(f"{r['content']['title']} {r['content']['desc']}") for r in rows)
    assert all(r["engagement"] == sum(number(v) for v in r["stats"].values()) for r in rows)
    records, gangs, want = plain(rows, 40, 60)
    assert {k: counts[k] for k in want} == want and counts["raw"] == 125 and counts["near_dup_removed"] == want["after_id_dedup"] - want["kept"] > 0
    assert counts["noise_filtered"] == want["kept"] - want["intel"] and counts["source_keywords"] == 2
    got = {r["row"]: r for r in results["members"].table.collect()}
    assert set(got) == {r["row"] for r in records}
    for r in records:
        g = got[r["row"]]
        assert g["risk_score"] == r["risk"] and g["near_duplicate_count"] == r["copies"] and g["demand_signals"]["inquiries"] == r["inquiries"]
        assert {k: v["matched"] for k, v in g["biz_categories"].items()} == r["cats"]
        assert [(p["amount"], p["near_unit"]) for p in g["prices"]] == r["prices"]
        assert {(c["type"], c["value"]) for c in g["contacts"]} == r["contacts"]
    told = results["clusters"].table.orderBy("gang_id").collect()
    assert [(t["note_count"], t["max_risk"]) for t in told] == sorted(((len(g), max(r["risk"] for r in g)) for g in gangs), reverse=True)
    assert told[0]["gang_id"] == "G001" and sum(t["total_demand"] for t in told) == sum(r["inquiries"] for g in gangs for r in g)
    assert Counter(c["n"] for t in told for c in t["top_categories"]) == Counter(n for g in gangs for _, n in sorted(Counter(c for r in g for c in r["cats"]).items(), key=lambda x: (-x[1], x[0]))[:3])
    assert sorted(tuple(t["authors"]) for t in told) == sorted(tuple(sorted({r["author"]["nickname"] for r in g})) for g in gangs)
    report = (folder / "out" / "analysis_report.md").read_text()
    assert report.startswith("# Posts") and "## Clusters" in report and "G001" in report
    assert "application/json" in (folder / "out" / "dashboard.html").read_text()
    assert json.loads((folder / "out" / "counts.json").read_text()) == counts


def test_a_job_goes_on_where_its_inputs_differ(spark, folder):
    command = ["posts", str(folder / "in"), "--lexicon", str(folder / "lexicon.json"), "-o", str(folder / "out"), "--min-risk", "40"]
    resumed = lambda text: [line.split(":")[0] for line in text.splitlines() if ": as before" in line]
    names = ["load", "clean", "extract", "members", "clusters", "records"]
    assert resumed(cli.run(command, spark)) == []
    assert resumed(cli.run(command, spark)) == names
    assert resumed(cli.run([*command[:-1], "30"], spark)) == names[:3]
    assert resumed(cli.run([*command, "--sim", "0.8"], spark)) == ["load"]
    # a step that was cut short has no counts, and what comes after it keeps its key
    cut = next((folder / "out" / "steps").glob("extract-*/counts.json")).parent
    for f in (folder / "out" / "steps").glob("extract-*/counts.json"):
        f.unlink()
    assert cut.exists() and resumed(cli.run(command, spark)) == ["load", "clean", "members", "clusters", "records"]
    (folder / "in" / "d.json").write_text(json.dumps(make_posts(6, 9)[:1]))
    told = cli.run([*command, "--prune"], spark)
    assert resumed(told) == [] and "earlier results deleted" in told
    assert len(list((folder / "out" / "steps").iterdir())) == 6
    assert "no lexicon" in cli.run([*command[:3], str(folder / "none.json"), *command[4:]], spark)


def test_keys_follow_content_and_names(spark, tmp_path):
    (tmp_path / "a.json").write_text("x")
    first = steps.files_key(spark, str(tmp_path))
    (tmp_path / "b.json").write_text("y")
    second = steps.files_key(spark, str(tmp_path))
    (tmp_path / "b.json").write_text("z")
    assert len({first, second, steps.files_key(spark, str(tmp_path))}) == 3
    (tmp_path / "b.json").unlink()
    assert steps.files_key(spark, str(tmp_path)) == first


def test_steps_read_nothing_that_known_results_stand_for(spark, tmp_path):
    reads = []

    def source():
        reads.append(1)
        return spark.range(5)

    twice = steps.Step("twice", lambda a, times: a.select((F.col("id") * times).alias("id")), ("a",), {"times": 2})
    for _ in range(2):
        out = steps.run_job(spark, [twice], {"a": ("k", source)}, str(tmp_path))
    assert reads == [1] and out["twice"].resumed and out["twice"].counts == {"rows": 5}
    assert sorted(r[0] for r in out["twice"].table.collect()) == [0, 2, 4, 6, 8]
    again = steps.Step("twice", twice.make, ("a",), {"times": 2}, version=2)
    assert not steps.run_job(spark, [again], {"a": ("k", source)}, str(tmp_path))["twice"].resumed


def test_match_places(spark):
    rng = random.Random(2)
    texts = ["", "12 usd", "x", None, *["".join(rng.choice("12 .usdé€\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", extract.match_places(F.col("t"), r"(\d+)\s?u", 1).alias("m")).collect():
        assert [(m["text"], m["at"]) for m in r["m"]] == [(m.group(1), m.start()) for m in re.finditer(r"(\d+)\s?u", r["t"] or "")]

"""Column functions over text. All are JVM-side; null text gives null unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{4e00}-\x{9fff}"


def quoted(words: list[str]) -> str:
    """A pattern of any of the words, taken literally; one that matches nothing for no words."""
    return "|".join(rf"\Q{w}\E" for w in sorted(set(words), key=lambda w: (-len(w), w))) or "(?!)"


def safe_pattern(pattern: str) -> str:
    """The pattern, or its literal text if it isn't a valid one."""
    try:
        re.compile(pattern)
        return pattern
    except re.error:
        return re.escape(pattern)


def normalize_text(c: Column) -> Column:
    """Topic tags, bracketed topic marks and bracketed emoji names become spaces; white space collapses; ends are trimmed."""
    tags = F.regexp_replace(c, r"#[^#\s]+#?|\[[^\[\]]{1,12}\]", " ")
    return F.trim(F.regexp_replace(tags, r"\s+", " "))


def fingerprint(c: Column, n: int = 3) -> Column:
    """The distinct character n-grams of the lower-cased letters and digits; shorter texts are one gram, empty ones none."""
    core = F.regexp_replace(F.lower(c), rf"[^{HAN}a-z0-9]+", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(core) - (n - 1)), lambda i: core.substr(i, F.lit(n)))
    return F.when(F.length(core) >= n, F.array_distinct(grams)).when(F.length(core) > 0, F.array(core)).otherwise(F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """The lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def word_shingles(c: Column, n: int = 3) -> Column:
    """The distinct runs of n lower-cased words, joined by a space; shorter texts are one run.

    The words are bound as a lambda's variable, so they are split once for a text and not once for a run.
    """

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(each)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words(c)), runs)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets held as arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def fold_replacements(c: Column, mapping: dict[str, str]) -> Column:
    """Literal replacements one after another, in the mapping's order, so a later one sees what an earlier one made."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), mapping.items(), c)


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether the text holds any word, without regard to case; null and empty texts don't."""
    return F.coalesce(c.rlike(f"(?iu){quoted(words)}"), F.lit(False)) if words else F.lit(False)


def matched_words(c: Column, words: list[str], ignore_case: bool = True) -> Column:
    """The words that the text holds, in the order given."""
    listed = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    # the text is bound as a lambda's variable, so it is lowered once and not once for each word
    found = lambda t: F.filter(listed, lambda k: F.coalesce(t.contains(F.lower(k) if ignore_case else k), F.lit(False)))
    return F.transform(F.array(F.lower(c) if ignore_case else c), found)[0]


def two_dimensional_match(c: Column, subjects: list[str], actions: list[str]) -> Column:
    """Whether the text holds a word of each list."""
    return contains_any(c, subjects) & contains_any(c, actions)


def relevance(c: Column, positive: str, negative: str) -> Column:
    """relevant if the positive pattern matches, else irrelevant if the negative does, else unknown."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(positive), "relevant").when(text.rlike(negative), "irrelevant").otherwise("unknown")


def count_zeros(c: Column) -> Column:
    """A count in text, the unit w standing for four zeros: what isn't whole is 0."""
    digits = F.regexp_replace(F.lower(F.trim(c)), "w|万", "0000")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def count_scaled(c: Column) -> Column:
    """A count in text with its unit (w, 万: 10,000; k: 1,000; 亿: 100,000,000); no number: 0."""
    text = F.lower(F.trim(c))
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.when(text.rlike("亿"), 1e8).when(text.rlike("w|万"), 1e4).when(text.rlike("k|千"), 1e3).otherwise(1.0)
    return F.coalesce((number * unit).cast("bigint"), F.lit(0))


def count_first_digits(c: Column) -> Column:
    """The first run of digits; none: 0."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint"), F.lit(0))


def excerpt(c: Column, word: Column, before: int = 24, after: int = 36) -> Column:
    """The text around the first place of a word, or null without one."""
    at = F.position(word, c)
    return F.when(at > 0, c.substr(F.greatest(at - before, F.lit(1)), F.length(word) + after + F.least(at - 1, F.lit(before))))


def sanitize_identifier(c: Column) -> Column:
    """A name of word characters; one that starts with a digit gets the prefix t_."""
    name = F.regexp_replace(c, r"(?U)[^\w]", "_")
    return F.when(name.rlike(r"^\d"), F.concat(F.lit("t_"), name)).otherwise(name)


def markdown_cell(c: Column) -> Column:
    """Text that is safe in a Markdown table cell."""
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(r"\|")), r"[\r\n]+", " ")


def escape_html(c: Column) -> Column:
    """Text with the characters of markup as references."""
    return fold_replacements(c, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})


def linkify(c: Column) -> Column:
    """Escaped text whose web addresses are links."""
    return F.regexp_replace(escape_html(c), r"(https?://[^\s<>&]+)", '<a href="$1">$1</a>')


def strip_tags(c: Column) -> Column:
    """Markup without scripts, styles and tags, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(bare, r"<[^>]*>", ""))


def url_parameters(c: Column) -> Column:
    """The query of a URL as a map, percent signs and plus decoded; the last of equal names counts."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.regexp_extract(p, r"=(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)["v"]))


def title_template(c: Column, size: int = 12) -> Column:
    """The first letters of a title without anything else: what sellers of one template share."""
    return F.left(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[^{HAN}]", ""), F.lit(size))


def segment_signature(c: Column, words: list[str], size: int = 10) -> Column:
    """The first words, sorted, that a text holds."""
    return F.slice(F.array_sort(F.array_distinct(matched_words(c, words))), 1, size)


def first_present(*columns: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def listing_key(item: Column, link: Column, seller: Column, title: Column) -> Column:
    """A listing's identity: its id, else the id in its link, else seller and title."""
    return first_present(item, F.regexp_extract(link, r"[?&]id=(\w+)", 1), F.concat_ws("|", F.coalesce(seller, F.lit("")), F.coalesce(title, F.lit(""))))


#: Path words of the messenger's site that name no channel, and the shapes of references (fixed values).
RESERVED = ("joinchat", "addstickers", "share", "addtheme", "iv", "proxy", "socks", "c", "addemoji", "telegram", "telegrambot")
MENTION = r"(?<![A-Za-z0-9_])@([A-Za-z][A-Za-z0-9_]{4,31})(?![A-Za-z0-9_])"
CHANNEL = r"https?://t\.me/([A-Za-z][A-Za-z0-9_]{4,31})(?:/\d+)?(?![A-Za-z0-9_])"
INVITE = r"https?://t\.me/\+([A-Za-z0-9_\-]+)"
OLD_INVITE = r"https?://t\.me/joinchat/([A-Za-z0-9_\-]+)"


def mined_references(text: Column, forwarded: Column, own: Column) -> Column:
    """References to groups in a message (key, username, invite_hash, channel): invites as +hash, channels by lower-cased name, from
    links, mentions (both without reserved names) and the name it was forwarded from; the message's own group is left out; each key
    once, in this order."""
    t, group = F.coalesce(text, F.lit("")), F.lower(F.coalesce(own, F.lit("")))
    found = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), 1)
    invite = lambda x: F.struct(F.concat(F.lit("+"), x).alias("key"), F.lit(None).cast("string").alias("username"), x.alias("invite_hash"), F.lit("text").alias("channel"))
    named = lambda x, how: F.struct(F.lower(x).alias("key"), F.lower(x).alias("username"), F.lit(None).cast("string").alias("invite_hash"), F.lit(how).alias("channel"))
    free = lambda x: ~F.lower(x).isin(*RESERVED)
    names = F.filter(F.concat(found(CHANNEL), found(MENTION)), free)
    forward = F.filter(F.array(F.coalesce(forwarded, F.lit(""))), lambda x: x != "")
    every = F.concat(F.transform(F.concat(found(INVITE), found(OLD_INVITE)), invite), F.transform(names, lambda x: named(x, "text")), F.transform(forward, lambda x: named(x, "forward")))
    others = F.filter(every, lambda r: r["invite_hash"].isNotNull() | (r["key"] != group))
    keys = F.array_distinct(F.transform(others, lambda r: r["key"]))
    return F.transform(keys, lambda k: F.filter(others, lambda r: r["key"] == k)[0])


#: What starts a line of a search bot's result, and what starts an advert (fixed values).
RESULT_ICONS = "🌄🎬💬📂📁📄🎵🎤📺🔞🔥📌📎🌟🎁📷🖼📸🎯🎫🎪🎨"
ADVERTS = ("广告:", "广告：")
MESSAGE_LINK = r"https?://t\.me/([A-Za-z][A-Za-z0-9_]{4,31})/(\d+)(?![\d/])"
CHANNEL_LINK = r"https?://t\.me/([A-Za-z][A-Za-z0-9_]{4,31})(?![A-Za-z0-9_/])"


def bot_previews(c: Column) -> Column:
    """The results in a search bot's reply (raw_line, text, icon, deeplink, channel, msg_id): lines that start with a result's icon and
    go on after it, adverts left out; a reply without any is one result of all its lines."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~F.coalesce(x.startswith(ADVERTS[0]) | x.startswith(ADVERTS[1]), F.lit(False)))
    icon = lambda x: F.when(F.lit(RESULT_ICONS).contains(F.left(x, F.lit(1))), F.left(x, F.lit(1)))
    rest = lambda x: F.regexp_replace(F.substring(x, 2, 1 << 30), r"(?U)^\s+|\s+$", "")

    def preview(line: Column, text: Column, icon: Column) -> Column:
        channel = F.nullif(F.coalesce(F.nullif(F.regexp_extract(line, MESSAGE_LINK, 1), F.lit("")), F.regexp_extract(line, CHANNEL_LINK, 1)), F.lit(""))
        msg = F.regexp_extract(line, MESSAGE_LINK, 2).try_cast("bigint")
        link = F.concat(F.lit("https://t.me/"), channel, F.coalesce(F.concat(F.lit("/"), msg.cast("string")), F.lit("")))
        return F.struct(line.alias("raw_line"), text.alias("text"), icon.alias("icon"), link.alias("deeplink"), channel.alias("channel"), msg.alias("msg_id"))

    led = F.transform(F.filter(kept, lambda x: icon(x).isNotNull() & (rest(x) != "")), lambda x: preview(x, rest(x), icon(x)))
    whole = F.array_join(kept, "\n")
    return F.when(F.size(led) > 0, led).when(whole != "", F.array(preview(whole, whole, F.lit(None).cast("string")))).otherwise(F.slice(led, 1, 0))


def image_fingerprint(c: Column) -> Column:
    """The first 18 characters of an image's id in its address; without one empty."""
    return F.left(F.regexp_extract(F.coalesce(c, F.lit("")), r"O1CN01.{13,20}", 0), F.lit(18))


def hour_bucket(c: Column) -> Column:
    """Day and hour of a time in text, as 2024-01-31 07h; what doesn't start so is empty."""
    found = lambda k: F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4}-\d{2}-\d{2})\s(\d{2}):", k)
    return F.when(found(1) != "", F.concat(found(1), F.lit(" "), found(2), F.lit("h"))).otherwise(F.lit(""))


def profile_url(group_url: Column, source_url: Column, platform: Column) -> Column:
    """The address of a record's group: its own, else the author's page of a post on the one platform where a post's address tells it."""
    author = F.regexp_extract(F.coalesce(source_url, F.lit("")), r"^(https?://(?:twitter|x)\.com/[^/]+)", 1)
    return F.coalesce(F.nullif(group_url, F.lit("")), F.when(F.lower(platform) == "twitter", author), F.lit(""))


def deep_link(c: Column) -> Column:
    """Channel and message id of a link to a message."""
    return F.struct(F.nullif(F.lower(F.regexp_extract(c, r"t\.me/([A-Za-z]\w{4,31})/(\d+)", 1)), F.lit("")).alias("channel"), F.regexp_extract(c, r"t\.me/([A-Za-z]\w{4,31})/(\d+)", 2).try_cast("bigint").alias("msg_id"))


def content_text(c: Column) -> Column:
    """The text of message content in JSON: a string, or the texts of a list of strings and {text: …} blocks, joined by line ends."""
    parts = F.from_json(c, "array<string>")
    texts = F.transform(parts, lambda p: F.when(F.trim(p).startswith("{"), F.get_json_object(p, "$.text")).otherwise(p))
    return F.when(F.trim(c).startswith("["), F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")).otherwise(c)


def strip_fence(c: Column) -> Column:
    """The inside of a fenced block if the text is one."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def first_array(c: Column) -> Column:
    """The JSON array in a reply, from the first opening bracket to the last closing one, outside of a fence; without one null."""
    return F.nullif(F.regexp_extract(strip_fence(c), r"(?s)\[.*\]", 0), F.lit(""))


def directory_tree(paths: Column, depth: int = 3, most: int = 100) -> Column:
    """A listing of entries (structs path, type: tree or blob) as indented lines, folders with a slash: those less deep, the first ones."""
    deep = lambda p: F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    near = F.filter(paths, lambda x: deep(x["path"]) < depth)
    line = lambda x: F.concat(F.repeat(F.lit("  "), deep(x["path"])), F.element_at(F.split(x["path"], "/"), -1), F.when(x["type"] == "tree", "/").otherwise(""))
    return F.array_join(F.slice(F.transform(near, line), 1, most), "\n")


#: Arguments that tell a call by themselves, tools that all arguments tell, and lines in a bucket of a reading tool (fixed values).
SALIENT = ("path", "url", "query", "command", "pattern", "glob", "cmd")
BY_CONTENT = ("write_file", "str_replace")
LINE_BUCKET = 200


def call_key(name: Column, arguments: Column) -> Column:
    """What tells a tool's call (arguments as a JSON object): for reads the path and the buckets of lines; for writes all arguments; else
    the salient ones, or all without any."""
    # an object is parsed only for names that may be in it: they stand there as such, or with escapes
    take = lambda k: F.when(arguments.contains(k) | arguments.contains("\\"), F.get_json_object(arguments, f"$.{k}"))
    # what is used more than once is held by a lambda's variable, so that it is computed once
    held = lambda x, use: F.transform(F.array(x), use)[0]
    bucket = lambda x: F.floor((F.greatest(x, F.lit(1)) - 1) / LINE_BUCKET).cast("string")
    chosen = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), take(k)) for k in sorted(SALIENT)]))
    whole = F.coalesce(F.to_json(F.array_sort(F.map_entries(F.from_json(arguments, "map<string,string>")))), arguments, F.lit(""))
    other = F.when(name.isin(*BY_CONTENT), whole).otherwise(held(chosen, lambda x: F.when(F.size(x) == 0, whole).otherwise(F.array_join(x, "\x01"))))

    def lines(path: Column) -> Column:
        first = F.coalesce(take("start_line").try_cast("bigint"), F.lit(1))
        ends = held(first, lambda x: F.array_sort(F.array(x, F.coalesce(take("end_line").try_cast("bigint"), x))))
        return held(ends, lambda x: F.concat(path, F.lit(":"), bucket(x[0]), F.lit("-"), bucket(x[1])))

    return F.when(name == "read_file", held(take("path"), lambda x: F.when(x.isNotNull(), lines(x)).otherwise(other))).otherwise(other)


def call_hash(calls: Column) -> Column:
    """Twelve hex digits that equal sets of calls share (structs name, arguments), whatever their order; how often each is there counts."""
    keys = F.transform(calls, lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.lit(":"), call_key(c["name"], c["arguments"])))
    return F.left(F.md5(F.array_join(F.sort_array(keys), "\x02")), F.lit(12))


def outline(c: Column, most: int = 50) -> Column:
    """Headings of a Markdown text (# marks, bold lines, upper-case lines) with level and line, the first `most`, and if more."""
    lines = F.transform(F.split(c, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("t")))
    level = lambda t: F.when(t.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(t, "^(#+)", 1))).when(t.rlike(r"^\*\*[^*]+\*\*$"), F.lit(2)).when(t.rlike(r"^[A-Z][A-Z0-9 ]{3,60}$"), F.lit(1))
    heads = F.filter(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), level(x["t"]).alias("level"), F.trim(F.regexp_replace(x["t"], r"^#+\s+|^\*\*|\*\*$", "")).alias("title"))), lambda x: x["level"].isNotNull())
    return F.struct(F.slice(heads, 1, most).alias("headings"), (F.size(heads) > most).alias("truncated"))


def snapped(c: Column, at: Column) -> Column:
    """A place in a text (characters before it), moved back behind the last line end in the half of the text before it, if there is one."""
    half = F.floor(at / 2).cast("int")
    back = F.position(F.lit("\n"), F.reverse(F.substring(c, half + 1, at - half)))
    return F.when((at <= 0) | (at >= F.length(c)) | (back == 0), at).otherwise(at - back + 1)


def head_tail(c: Column, size: int, mark: str = "\n…\n") -> Column:
    """The text, or its first and last halves of `size` characters around a mark if it is longer."""
    half = size // 2
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(half)), F.lit(mark), F.right(c, F.lit(size - half)))).otherwise(c)


def truncated_middle(c: Column, most: int) -> Column:
    """The text, or its two ends around a mark that tells how many characters are left out, `most` characters at most in all; 0: all."""
    total = F.length(c)
    kept = F.lit(most) - F.length(F.format_string("\n... [middle truncated: %d chars skipped] ...\n", total))
    head = F.floor(kept / 2).cast("int")
    cut = F.concat(F.left(c, head), F.format_string("\n... [middle truncated: %d chars skipped] ...\n", total - kept), F.right(c, kept - head))
    return c if most == 0 else F.when(total <= most, c).when(kept <= 0, F.left(c, F.lit(most))).otherwise(cut)


def truncated_head(c: Column, most: int, advice: str = "Use start_line/end_line to read a specific range") -> Column:
    """The text, or its start and a mark that tells how much that is, `most` characters at most in all; 0: all."""
    total = F.length(c)
    mark = lambda n: F.format_string(f"\n... [truncated: showing first %d of %d chars. {advice}] ...", n, total)
    kept = F.lit(most) - F.length(mark(total))
    return c if most == 0 else F.when(total <= most, c).when(kept <= 0, F.left(c, F.lit(most))).otherwise(F.concat(F.left(c, kept), mark(kept)))


def preview(c: Column, head: int, tail: int, mark: str = "\n\n[... %d chars omitted ...]\n\n") -> Column:
    """The start and the end of a text around a mark that tells what is left out, both cut at line ends where there are any near."""
    total = F.length(c)
    first = snapped(c, F.least(F.lit(head), total))
    last = F.greatest(first, total - tail)
    last = F.when(snapped(c, last) > first, snapped(c, last)).otherwise(last)
    return F.concat(F.left(c, first), F.format_string(mark, last - first), F.substring(c, last + 1, total - last))


def line_range(c: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, both included."""
    return F.array_join(F.slice(F.split(c, "\n"), first, max(0, last - first + 1)), "\n")


def truncate_utf8(c: Column, size: int) -> Column:
    """The longest start of the text that has at most `size` bytes in UTF-8."""
    cut = F.hex(F.substring(F.encode(c, "UTF-8"), 1, size))
    # of the last character, take all or nothing: a lead byte and fewer following bytes than it asks for go
    open_end = "(?:[CD].|E.(?:[89AB].){0,1}|F.(?:[89AB].){0,2})$"
    return F.when(F.octet_length(c) <= size, c).otherwise(F.decode(F.unhex(F.regexp_replace(cut, f"^((?:..)*?){open_end}", "$1")), "UTF-8"))

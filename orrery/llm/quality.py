"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit operations on the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared_table, without

#: White space between words, and the characters that count as symbols (fixed values).
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

#: Bit of each rule in the ledger.
RULES = {"few_words": 0, "repeated_words": 1, "symbols": 2, "duplicate_lines": 3, "word_length": 4, "shouting": 5}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it enforces."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("v1", tuple(RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


def _repeated_words(df: DataFrame) -> DataFrame:
    """From the window hashes in __h, n_repeat_words: how many words lie in a three-word window that occurs twice.

    Windows are sorted with their place, equal neighbours are marked, and each marked place adds three words, less the overlap
    with the next. Texts without any repeated window skip the sort.
    """
    twice = F.size("__h") > F.size(F.array_distinct("__h"))
    df = df.withColumn("__s", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s, none = F.col("__s"), F.array(F.lit(None).cast("bigint"))
    neighbours = F.arrays_zip(
        s["i"].alias("i"),
        s["h"].alias("h"),
        F.concat(none, F.slice(s["h"], 1, F.size(s) - 1)).alias("a"),
        F.concat(F.slice(s["h"], 2, F.size(s) - 1), none).alias("b"),
    )
    same = lambda x: F.coalesce(x["h"] == x["a"], F.lit(False)) | F.coalesce(x["h"] == x["b"], F.lit(False))
    df = df.withColumn("__p", F.sort_array(F.transform(F.filter(neighbours, same), lambda x: x["i"])))
    step = lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))
    steps = F.zip_with("__p", F.slice("__p", 2, F.size("__p")), step)
    covered = F.aggregate(steps, F.lit(0), lambda n, x: n + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__s", "__p")


def rule_ledger(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and `failed_bits`, in which bit RULES[r] is set if the text fails rule r.

    Null and empty texts have no words and fail few_words. Whole texts are measured, however long; repeated rows are measured
    each alike. Input columns with the ledger's names are replaced, all others kept.
    """
    base = without(documents, *MEASURES, "failed_bits", "__words", "__lines", "__h", "__s", "__p")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blanks = SPACES[1:]
    step1 = base.withColumns(
        {
            "__words": F.filter(F.split(F.translate(body, blanks, " " * len(blanks)), " "), lambda w: w != ""),
            "__lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", ""))).cast("long"),
            "n_exclaims": (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("long"),
        }
    )
    step2 = step1.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.when(
                F.size("__words") >= 4,
                F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(3)])),
            ),
        }
    ).drop("__words", "__lines")
    step3 = _repeated_words(step2)
    n = F.col("n_words")
    fails = {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 40 * F.col("n_lines"),
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        "shouting": 2 * F.col("n_exclaims") > n,
    }
    bits = sum((F.when(c, F.lit(1 << RULES[r])).otherwise(F.lit(0)) for r, c in fails.items()), F.lit(0))
    return step3.withColumn("failed_bits", bits.cast("long"))


def stored_ledger(documents: DataFrame, text: str = "text") -> DataFrame:
    """rule_ledger() without the text, written to the shared folder: policies and ablations read it and measure nothing again."""
    return shared_table(rule_ledger(documents, text).drop(text), "ledger")


def passes(policy: Policy) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def passing_rows(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger's rows that pass a policy.

    The filter reads a row number that is made above the ledger, so that the optimizer leaves it there: pushed below the
    measurements, it would hold all of them written out within each other.
    """
    numbered = without(ledger, "__row").withColumn("__row", F.monotonically_increasing_id())
    return numbered.where(passes(policy) & (F.col("__row") >= 0)).drop("__row")


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger's rows with `kept` and the version that decided."""
    return without(ledger, "kept", "policy").withColumns({"kept": passes(policy), "policy": F.lit(policy.version)})


def ablations(ledger: DataFrame, policies: list[Policy]) -> DataFrame:
    """For each policy and each of its rules: rows in all, rows rejected, and rows that only this rule rejects.

    The ledger is first counted by its bits, of which there are at most 2^rules, so the rest is on a few rows. An empty ledger gives
    none.
    """
    counts = ledger.groupBy("failed_bits").agg(F.count("*").alias("n"))
    table = [(p.version, r, p.mask, 1 << RULES[r]) for p in policies for r in p.rules]
    grid = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, r, m, b in table]))
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return (
        counts.select("failed_bits", "n", grid.alias("g"))
        .select("failed_bits", "n", "g.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing_rule"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_by_rule_alone"),
        )
    )

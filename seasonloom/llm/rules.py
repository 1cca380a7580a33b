"""Quality rules as a ledger: every rule is evaluated once per text, policies come later.

``ledger`` measures a text and stores one failure bit per rule.  ``apply_policy`` reads
only the bits: a policy is a versioned bit mask, so a change of policy touches no text.
``ablations`` counts, per policy and rule, what the rule decides, from the counts of the
different bit patterns (at most two to the number of rules, whatever the input).
``store`` writes a ledger once, named after the rule set that made it, and ``load`` reads one
that the present rules can interpret: policies and ablations then cost a scan of numbers.

All of it is column expressions.  The three-word windows of a text are compared inside
its row, through 64-bit hashes; nothing is exploded and the ledger needs no shuffle.

Defined results: a null or empty text has no words, so every measure is 0 and the rules
``few_words`` and ``repeated_words`` decide it (the first fails it).  Repeated rows repeat
their result, an empty table gives an empty ledger.  Columns of the input are kept; an
input column named like a measure is replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]

# Rule: condition on the measures, in SQL that Spark and other engines read alike.
# The position of a rule is its bit and never changes; new rules go to the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "capitals": "100 * n_upper > 50 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 70 * n_lines",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ["few_words", "repeated_words"]

# Policy versions; a version never changes once documents were kept under it.
POLICIES = {
    "v1": BASE,
    "v2": [*BASE, "symbols", "capitals", "repeated_lines", "long_words"],
}


def mask(rules: Iterable[str]) -> int:
    bits = {name: 1 << k for k, name in enumerate(RULES)}
    return sum(bits[name] for name in set(rules))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once (an expression inlined into a lambda is not)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, each word counted once."""
    windows = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def starts(ordered: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        kept = F.transform(
            ordered,
            lambda e, k: F.when(same(F.get(ordered, k - 1), e) | same(F.get(ordered, k + 1), e), e["i"]),
        )
        return F.sort_array(F.array_compact(kept))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def count(hashed: Column) -> Column:
        ordered = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = _bound(_bound(ordered, starts), covered)
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0)).otherwise(repeated)

    return _bound(windows, count)


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    whole = F.char_length
    counted = _bound(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"), _repeat_words(w).alias("r"), whole(F.array_join(w, "")).alias("c")
        ),
    )
    seen = _bound(
        lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))
    )
    marks = _bound(
        F.regexp_replace(text, f"[^A-Z{SYMBOLS}]+", ""),
        lambda m: F.struct(whole(m).alias("n"), whole(F.regexp_replace(m, "[^A-Z]+", "")).alias("u")),
    )
    return {"words": counted, "lines": seen, "marks": marks}


def free_name(name: str, columns: list[str]) -> str:
    """A column name that no given column has."""
    while name in columns:
        name += "_"
    return name


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measures (long) and ``fail_bits`` (long)."""
    kept = [c for c in docs.columns if c not in {*MEASURES, "fail_bits"}]
    found = free_name("measured", docs.columns)
    parts = [c.alias(name) for name, c in measures(F.col(f"`{text}`")).items()]
    named = docs.select(*(F.col(f"`{c}`") for c in kept), F.struct(*parts).alias(found))
    at = lambda path: F.col(f"{found}.{path}")
    counts = {
        "n_words": at("words.n"),
        "word_chars": at("words.c"),
        "n_symbols": at("marks.n") - at("marks.u"),
        "n_upper": at("marks.u"),
        "n_lines": at("lines.n"),
        "n_dup_lines": at("lines.d"),
        "n_repeat_words": at("words.r"),
    }
    named = named.withColumns({name: c.cast("long") for name, c in counts.items()}).drop(found)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return named.withColumn("fail_bits", reduce(Column.__add__, bits).cast("long"))


def rule_set() -> str:
    """A name of the present rules: their number and a digest of names and conditions, in order."""
    text = "\n".join(f"{name}: {rule}" for name, rule in RULES.items())
    return f"{len(RULES)}-{zlib.crc32(text.encode()):08x}"


def store(ledger: DataFrame, folder: str) -> str:
    """Write a ledger below ``folder`` under the name of the rule set; returns its path."""
    path = f"{folder.rstrip('/')}/rules={rule_set()}"
    ledger.write.parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; bits of another rule set are refused, as they mean something else."""
    made_by = path.rstrip("/").rpartition("/rules=")[2]
    if made_by != rule_set():
        raise ValueError(f"the ledger at {path} was made by the rules {made_by}, not {rule_set()}")
    return spark.read.parquet(path)


def failed(policy: str | Iterable[str], bits: str = "fail_bits") -> Column:
    """Whether any rule of the policy (a version, or rule names) fails."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(bits).bitwiseAND(F.lit(mask(names)).cast("long")) != 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    return ledger.withColumns({"base_failed": failed(BASE), "kept": ~failed([*BASE, *POLICIES[policy]])})


def ablations(ledger: DataFrame) -> DataFrame:
    """Per policy and rule: documents, and how many the policy keeps with and without the rule.

    ``only`` counts documents that no other rule of the policy removes.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("docs"))
    entries = [
        F.struct(
            F.lit(policy).alias("policy"),
            F.lit(rule).alias("rule"),
            F.lit(mask(names)).cast("long").alias("all_bits"),
            F.lit(mask([rule])).cast("long").alias("bit"),
        )
        for policy, names in POLICIES.items()
        for rule in names
    ]
    pairs = patterns.select("*", F.inline(F.array(*entries)))
    within = F.col("fail_bits").bitwiseAND(F.col("all_bits"))
    rest = within.bitwiseAND(F.bitwise_not(F.col("bit")))
    number = lambda when: F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0)).alias
    return pairs.groupBy("policy", "rule").agg(
        F.sum("docs").alias("n_docs"),
        number(within == 0)("n_kept"),
        number(rest == 0)("n_kept_without"),
        number(within == F.col("bit"))("n_only"),
    )

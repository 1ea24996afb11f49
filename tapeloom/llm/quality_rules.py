"""Quality rules as a bitmask ledger, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without_breaks, words_of

SYMBOLS = "#*$%&|<>"

#: Name and failure condition of each rule over the ledger's measurements; a
#: rule's place is its bit and never changes, so old ledgers stay readable.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("shouting", "100 * n_bangs > 50 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("short_words", "2 * n_words > word_chars"),
    ("long_words", "word_chars > 25 * n_words"),
]

#: Versioned policies: the rules that each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting", "repeated_lines", "short_words", "long_words"),
}


def policy_mask(rules: tuple[str, ...]) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[r] for r in rules)


def _count(text: Column, chars: str) -> Column:
    rest = text
    for ch in chars:
        rest = F.replace(rest, F.lit(ch), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the measurements and ``fail_bits`` (every rule, evaluated once).

    ``n_repeat_words`` is found within each row: 3-word windows are hashed to
    64 bits and sorted with their places; places of equal neighbours are the
    repeated windows, and their sorted starts give the words covered. All of it
    is linear or n log n in the text, and no row leaves its task. Null and blank
    texts measure zero everywhere (and fail ``few_words``); repeated rows are
    measured alike; other columns are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, t.alias("__t")).select(*keep, "__t", words_of("__t").alias("__w"), F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    n = F.size("__w")
    grams = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))
    rows = rows.select(
        *keep, n.cast("long").alias("n_words"), F.length(without_breaks(F.col("__t"))).cast("long").alias("word_chars"),
        _count(F.col("__t"), SYMBOLS).alias("n_symbols"), _count(F.col("__t"), "!").alias("n_bangs"), F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), F.sort_array(grams).alias("__g"),
    )
    twice = F.filter("__g", lambda x, k: (F.get("__g", k - 1)["h"] == x["h"]).__or__(F.get("__g", k + 1)["h"] == x["h"]))
    rows = rows.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__g")
    covered = F.aggregate(F.transform("__p", lambda p, k: F.coalesce(F.least(F.get("__p", k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", covered.cast("long")).drop("__p")
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0))
    # One row in, one row out. A filter on the bits stays above the generator: pushed
    # into the measurements it would have the optimizer double its constraints for each.
    found = F.struct(*(c for c in rows.columns if c not in keep), bits.cast("long").alias("fail_bits"))
    return rows.select(*keep, F.explode(F.array(found)).alias("__m")).select(*keep, "__m.*")


def apply_policy(rows: DataFrame, policy: str = "v1", name: str = "kept") -> DataFrame:
    """Add whether a ledger's row passes every rule of a policy."""
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(policy_mask(POLICIES[policy]))) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it removes.

    One pass: the ledger is aggregated to its distinct bitmasks (at most
    2 ** rules rows), which the rules then read.
    """
    mask = policy_mask(POLICIES[policy])
    seen = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    wanted = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in wanted))
    each = seen.select("n", "fail_bits", F.explode(rules).alias("r"))
    hit = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("fail_bits").bitwiseAND(F.lit(mask)) == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(only, F.col("n"))), F.lit(0)).alias("only_by_this")
    )

"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
long of failure bits (bit i: rule i failed). A policy is a named, versioned set of rules,
so it is one mask: applying it, comparing two versions or asking what a single rule
costs needs only bit operations on the ledger, never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: What separates words: space, tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule and the SQL condition under which a document fails it."""

    name: str
    fails: str


#: The position of a rule is its bit: append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("many_words", "n_words > 100000"),
)
#: Versioned policies. `base` holds the two rules that no policy may drop.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": tuple(r.name for r in RULES),
    # length alone rejects no document: many_words is measured only
    "v3": ("few_words", "repeated_words", "repeated_lines", "symbols", "short_words", "long_words"),
}
PRODUCTION = "v3"


def mask_of(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in set(names))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Words are runs of anything but blanks; a line counts if it has a word; a null text
    has no words. Other columns pass through; those of these names are replaced.

    3-word windows are compared through 64-bit hashes first: without two equal hashes
    there is no repeat. Only otherwise the windows themselves are sorted with their
    positions; equal neighbours are the repeated ones, and the words they cover are
    counted by walking their positions once.
    """
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]).alias("_row")
    step = docs.select(kept, text_of(text).alias("_t")).withColumn("_w", F.filter(F.split("_t", BLANKS), lambda w: w != ""))
    step = step.withColumn(
        "_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    step = step.withColumn(
        "_hashes",
        F.when(
            F.size("_w") >= 4,
            F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))"),
        ),
    )
    # windows with positions, only where two hashes are equal; sorted, so that equals are neighbours
    step = step.withColumn(
        "_sorted",
        F.when(
            (F.size("_w") >= 4) & (F.size(F.array_distinct("_hashes")) < F.size("_hashes")),
            F.expr(
                "array_sort(transform(sequence(0, size(_w) - 3), "
                "i -> named_struct('w', concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]), 'i', i)))"
            ),
        ),
    )
    step = step.withColumn(
        "_at",
        F.expr(
            "sort_array(transform(filter(_sorted, (x, k) -> "
            "(k > 0 AND _sorted[k - 1].w = x.w) OR (k + 1 < size(_sorted) AND _sorted[k + 1].w = x.w)), x -> x.i))"
        ),
    )
    covered = F.expr(
        "coalesce(aggregate(transform(_at, (p, k) -> "
        "if(k + 1 < size(_at), least(3, _at[k + 1] - p), 3)), 0L, (n, x) -> n + x), 0L)"
    )
    rows = step.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
            "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
        }
    )
    return rows.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in MEASURES], *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`measured` plus `failed` (long, replaced if there): bit i is set if rule i of RULES fails."""
    bits = " | ".join(f"IF({r.fails}, {1 << i}L, 0L)" for i, r in enumerate(RULES))
    return measured(docs, text).withColumn("failed", F.expr(bits))


def passes(policy: str | tuple[str, ...] = PRODUCTION) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects.

    Rows are first counted by their failure bits (at most 2 ** rules groups, combined on
    the map side); each rule is then judged on those patterns by bit operations.
    """
    mask = mask_of(policy)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
            for i, r in enumerate(RULES)
            if mask >> i & 1
        ]
    )
    one = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    return one.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def sole_rule(policy: str = PRODUCTION) -> Column:
    """The rule of a policy that alone rejects a ledger row; null if none or several do."""
    bits, mask = F.col("failed").bitwiseAND(F.lit(mask_of(policy)).cast("long")), mask_of(policy)
    return F.coalesce(*[F.when(bits == 1 << i, F.lit(r.name)) for i, r in enumerate(RULES) if mask >> i & 1])


def quality_digest(docs: DataFrame) -> DataFrame:
    """One row per document: measurements, base_failed, kept, the failure bits, and what the stored ledger gives.

    The ledger is written once; all the rest is read from it: the verdicts of the other
    policies (kept_v1, kept_v2), sole_rule, and from the ablation how many documents that
    rule alone rejects (n_sole; null without one). Null and empty texts have no words and
    fail few_words; repeated rows are rows of their own, and an empty table has none.
    """
    rows = written(ledger(docs.select("doc_id", "text")), "ledger").withColumn("sole_rule", sole_rule())
    base = passes("base")
    # a row per rule
    costs = ablation(rows).select(F.col("rule").alias("sole_rule"), F.col("n_only").alias("n_sole"))
    return rows.join(F.broadcast(costs), "sole_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), (base & passes(PRODUCTION)).alias("kept"), "failed", "n_lines",
        (base & passes("v1")).alias("kept_v1"), (base & passes("v2")).alias("kept_v2"), "sole_rule", "n_sole",
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass the production policy, columns unchanged."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    # not a filter: pushed down, it would measure a text anew for every use of a measurement
    stays = passes("base") & passes(PRODUCTION)
    return ledger(whole).select(F.inline(F.filter(F.array("row"), lambda _: stays)))

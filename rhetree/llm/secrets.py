"""Secret scans through a trigram inverted index.

From every rule's regular expression a Boolean trigram query is derived: an OR of
clauses, each an AND of trigrams that any match must contain. The trigrams of all
queries are indexed once (trigram -> documents); a clause's documents are the
intersection of its trigrams' postings, and only a rule's candidates are searched with
its expression. A rule whose query is empty (its matches need no trigram) scans all texts.

Everything on this path is DataFrame functions; the only Python is the derivation of the
queries from the handful of rules, on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_buckets, text_of
from .splicing import spliced

#: Trigrams kept of a clause: fewer make a weaker filter, never a wrong one.
MAX_TRIGRAMS = 3
#: Strings that a part of an expression may stand for before it counts as open.
MAX_STRINGS = 40
ANY = frozenset([frozenset()])


@dataclass(frozen=True)
class SecretRule:
    """`pattern` is searched leftmost, non-overlapping; a match stays if group `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds and their patterns, in the order that breaks ties.
BASE = (
    SecretRule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]+", 0, 32),
)
#: What this method adds: kinds whose marks make them cheap to look up.
MORE = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _absorbed(clauses) -> frozenset:
    """Without clauses that another, weaker clause implies."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: frozenset, b: frozenset) -> frozenset:
    return _absorbed({x | y for x in a for y in b})


def _of_strings(strings) -> frozenset:
    return _absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _item(code, arg):
    """(the strings it stands for or None, its query) of one node of a parsed expression."""
    if code is op.LITERAL:
        return {chr(arg).lower()}, ANY
    if code is op.IN and all(c is op.LITERAL for c, _ in arg) and len(arg) <= 6:
        return {chr(x).lower() for _, x in arg}, ANY
    if code is op.SUBPATTERN:
        return _sequence(arg[-1])
    if code is op.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        exact = None if any(e is None for e, _ in parts) else set().union(*(e for e, _ in parts))
        return exact, _absorbed(frozenset().union(*(q for _, q in parts)))
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _sequence(inner)
        if low == 0:
            return ({""} | exact if exact is not None and high == 1 else None), ANY
        return (exact if low == high == 1 else None), query
    return None, ANY


def _sequence(nodes):
    run, query, closed = {""}, ANY, True
    for code, arg in nodes:
        exact, own = _item(code, arg)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        closed, query, run = False, _both(query, _of_strings(run)), {""}
        query = _both(query, own if exact is None else _of_strings(exact))
    query = _both(query, _of_strings(run))
    return (run if closed else None), query


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs of lower-case trigrams that any text with a match contains; [] if none is needed."""
    _, query = _sequence(parser.parse(pattern))
    if frozenset() in query:
        return []
    short = _absorbed({frozenset(sorted(c)[:: -(-len(c) // MAX_TRIGRAMS)]) for c in query})
    return sorted(sorted(c) for c in short)


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, key) for each of `trigrams` in each row's text, in lower case."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    # lower-cased in a step of its own: within the lambda it would be done for each trigram
    low = keyed.select("_key", F.lower("_t").alias("_low"))
    return low.select("_key", F.explode(F.filter(wanted, lambda t: F.contains(F.col("_low"), t))).alias("trigram"))


def candidates(keyed: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(key, rules): bit i is set if the row may match rule i, by intersected postings."""
    clauses = [
        (i, k, clause) for i, r in enumerate(rules) for k, clause in enumerate(trigram_query(r.pattern))
    ]
    trigrams = sorted({t for _, _, c in clauses for t in c})
    # trigram -> the clauses that need it; as few as the rules, so a literal map
    uses = F.create_map(
        *[
            x
            for t in trigrams
            for x in (
                F.lit(t),
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("rule"), F.lit(k).alias("clause"),
                            F.lit(1 << c.index(t)).alias("has"), F.lit((1 << len(c)) - 1).alias("needs"),
                        )
                        for i, k, c in clauses
                        if t in c
                    ]
                ),
            )
        ]
    )
    hits = postings(keyed, trigrams).select("_key", F.explode(uses[F.col("trigram")]).alias("u")).select("_key", "u.*")
    met = hits.groupBy("_key", "rule", "clause", "needs").agg(F.bit_or("has").alias("has")).where("has = needs")
    return met.groupBy("_key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("_rules"))


def _spans(rule: SecretRule, kind: int) -> Column:
    """array<(start, kind, end)> of a rule in column _t; positions are code points.

    Splitting at the matches gives the texts between them, so that a match starts after
    the lengths of all that precedes it. Lengths are summed in blocks of 256.
    """
    pattern, text = F.lit(rule.pattern), F.col("_t")
    found = F.transform(
        F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("gap"),
            F.regexp_extract_all(text, pattern, 0).alias("hit"),
            F.regexp_extract_all(text, pattern, rule.group).alias("part"),
        ),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("hit"),
            F.length(x["part"]).alias("part"),
        ),
    )
    at = F.transform(
        F.filter(_running(found), lambda x: x["part"] >= rule.least),
        lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + x["hit"]).alias("end")),
    )
    return at


def _running(found: Column) -> Column:
    """Adds the start of each match: the gaps up to it and the matches before it."""
    add = lambda n, x: n + x["gap"] + F.coalesce(x["hit"], F.lit(0))
    zero = F.lit(0)
    blocks = lambda m: F.sequence(F.lit(0), F.floor((F.size(m) - 1) / 256).cast("int"))
    sums = lambda m: F.transform(
        blocks(m), lambda b: F.aggregate(F.slice(m, b * 256 + 1, F.lit(256)), zero, add)
    )
    firsts = lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), zero, lambda n, x: n + x))
    rows = lambda m, f: F.transform(
        m,
        lambda x, i: F.struct(
            x["hit"].alias("hit"),
            x["part"].alias("part"),
            (
                F.get(f, F.floor(i / 256).cast("int"))
                + F.aggregate(F.slice(m, i - i % 256 + 1, i % 256), zero, add)
                + x["gap"]
            ).alias("start"),
        ),
    )
    # lambdas over one-element arrays name a value once, so that it is computed once
    with_m = F.transform(F.array(found), lambda m: F.struct(m.alias("m"), sums(m).alias("s")))
    with_f = F.transform(with_m, lambda v: F.struct(v["m"].alias("m"), firsts(v["s"]).alias("f")))
    return F.flatten(F.transform(with_f, lambda v: rows(v["m"], v["f"])))


def scan(docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = RULES, spread: str = "doc_id") -> DataFrame:
    """Adds `secrets`: array<(start, kind, end)> sorted, kind being the rule's place in `rules`.

    A null or empty text has none; other columns pass through (one called `secrets` is
    replaced). Candidates are joined by a hash of the text and of the column `spread` (if
    there is one), so that copies of a text do not meet in one task; a clash of hashes
    only adds candidates, which the search then turns down.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"]).alias("_row")
    key = F.xxhash64(text_of(text), *[F.col(f"`{c}`") for c in (spread,) if c in docs.columns])
    keyed = docs.select(kept, text_of(text).alias("_t"), key.alias("_key"))
    found = candidates(keyed.select("_key", "_t"), rules)
    # only candidates are shuffled (and the few others in their buckets)
    hit = in_buckets(keyed, found, "_key").join(found, "_key", "left")
    rest = in_buckets(keyed, found, "_key", "left_anti").withColumn("_rules", F.lit(None).cast("long"))
    matched = hit.unionByName(rest)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for i, r in enumerate(rules):
        if trigram_query(r.pattern):
            due = F.coalesce(F.expr(f"(_rules & {1 << i}L) <> 0"), F.lit(False))
        else:
            due = F.col("_t").rlike(_at_least(r))
        each.append(F.when(due, _spans(r, i)).otherwise(none))
    out = matched.withColumn("secrets", F.array_sort(F.concat(*each)))
    return out.select("_row.*", "secrets")


def _at_least(rule: SecretRule) -> str:
    """For a scan of all texts: an expression that any kept match contains, cheaper to search for."""
    if m := re.fullmatch(r"(\[[^\]]*\])\+", rule.pattern):
        return f"{m[1]}{{{rule.least}}}"
    return rule.pattern


def span_text(spans: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans, all spans."""
    rows = scan(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < len(BASE))
    return rows.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by `mark`; overlapping spans become one.

    A null text stays null. Columns are unchanged, but for n_chars (if there is one), which follows the
    text where that changes.
    """
    rows = scan(docs)
    has = F.size("secrets") > 0
    rows = rows.withColumn("_new", F.when(has, spliced(F.col("text"), F.col("secrets"), mark)).otherwise(F.col("text")))
    new = {"text": F.col("_new").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(has, F.length("_new").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])

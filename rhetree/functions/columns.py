"""Column expressions: guarded logarithms, divisions, labels, identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "ROOT"
UNRELATED = "UNRELATED"
UNKNOWN = "__UNK__"
CAP = 1e90


def cap_score(x: Column) -> Column:
    """A score clamped to +-CAP."""
    return F.greatest(F.lit(-CAP), F.least(F.lit(CAP), x))


def safe_log(p: Column) -> Column:
    """ln(p), -CAP at 0 and below."""
    return F.when(p > 0, cap_score(F.ln(p))).otherwise(F.lit(-CAP))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)), clamped to +-CAP at 0 and 1."""
    return F.when(p <= 0, F.lit(-CAP)).when(p >= 1, F.lit(CAP)).otherwise(cap_score(F.ln(p / (1 - p))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(1)).otherwise(b))


def best_label(label_w: Column) -> Column:
    """The place of the largest label weight, the first on ties."""
    return F.array_position(label_w, F.array_max(label_w)).cast("int") - 1


def name_of(ix: Column, labels: Sequence[str]) -> Column:
    """The name of a label number; null for a number without one."""
    return F.get(F.array(*[F.lit(x) for x in labels]), ix.cast("int"))


def number_of(name: Column, labels: Sequence[str]) -> Column:
    """The number of a label name; null for an unknown one."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), name).cast("int")
    return F.when(place > 0, place - 1)


def id_number(unit: Column) -> Column:
    """The number at the end of a unit's id; ROOT is 0."""
    return F.when(unit == ROOT, F.lit(0)).otherwise(F.regexp_extract(unit, r"(\d+)$", 1).try_cast("long")).cast("long")


def join_keys(*parts: Column) -> Column:
    return F.concat_ws("-", *parts)


def ellipsis(text: Column, width: int) -> Column:
    """The text cut to `width` characters, the last three being dots where it was longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)

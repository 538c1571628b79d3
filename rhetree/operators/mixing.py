"""Online linear learners over wide feature spaces: iterative parameter mixing with the weights as a table.

Rows have sparse features, an array `items` of (ix, value). In an epoch the weights of a
row's features come to it by a join on ix; every part of the rows is then run through in
order, and gives for the features that it has touched how far their weights moved. The
moves are averaged over the parts by an aggregation on ix. Weights never pass the driver,
and a task holds those of the features of its own part alone. With one part this is
the plain online algorithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import concluded, written

ITEMS = "array<struct<ix:long,value:double>>"
MOVES = "ix long, moved double, late double"
#: The ix of the row that gives a part's number of steps.
STEPS = -1


def step_size(kind: str, y: float, score: float, norm: float, c: float, eta: float) -> float:
    """How far a row moves the weights: perceptron, pa (hinge, capped at c) or pa2 (softened by c)."""
    if kind == "perceptron":
        return eta * y if y * score <= 0 else 0.0
    loss = max(0.0, 1 - y * score)
    if not loss or not norm:
        return 0.0
    return y * (min(c, loss / norm) if kind == "pa" else loss / (norm + 1 / (2 * c)))


class Moves:
    """What a part has done to the weights of the features it has touched."""

    def __init__(self):
        self.steps, self.of = 0, {}

    def load(self, ix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moves, and moves times the steps before them, of features given by ix."""
        both = np.array([self.of.get(i, (0.0, 0.0)) for i in ix.tolist()]).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def store(self, ix: np.ndarray, moved: np.ndarray, late: np.ndarray) -> None:
        for i in np.flatnonzero((moved != 0) | (late != 0)).tolist():
            self.of[int(ix[i])] = (float(moved[i]), float(late[i]))

    def frame(self) -> pd.DataFrame:
        """A row per feature: its move, and by how much the sum of its weights over all steps grows for it."""
        rows = [(i, m, self.steps * m - late) for i, (m, late) in self.of.items()]
        return pd.DataFrame([(STEPS, 0.0, float(self.steps)), *rows], columns=["ix", "moved", "late"])


def _flat(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(distinct ix, their place for each item, values, weights, row of each item) of a batch of rows."""
    sizes = frame["ix"].map(len).to_numpy()
    row = np.repeat(np.arange(len(frame)), sizes)
    cat = lambda c, t: np.concatenate([np.zeros(0, t), *[np.asarray(x, t) for x in frame[c]]])
    ix, at = np.unique(cat("ix", np.int64), return_inverse=True)
    return ix, at, cat("value", np.float64), cat("w", np.float64), row


def _linear(frame: pd.DataFrame, moves: Moves, kind: str, c: float, eta: float) -> None:
    ix, at, value, weight, row = _flat(frame)
    moved, late = moves.load(ix)
    ends = np.searchsorted(row, np.arange(len(frame) + 1))
    for k, y in enumerate(frame["y"].tolist()):
        own = slice(ends[k], ends[k + 1])
        x, place = value[own], at[own]
        tau = step_size(kind, y, float(x @ (weight[own] + moved[place])), float(x @ x), c, eta)
        if tau:
            np.add.at(moved, place, tau * x)
            np.add.at(late, place, tau * x * moves.steps)
        moves.steps += 1
    moves.store(ix, moved, late)


def _structured(decode: Callable) -> Callable:
    def run(doc: pd.DataFrame, moves: Moves, kind: str, c: float, eta: float) -> None:
        ix, at, value, weight, row = _flat(doc)
        moved, late = moves.load(ix)
        base = np.zeros(len(ix))
        base[at] = weight
        now = base + moved
        scores = np.bincount(row, value * now[at], len(doc))
        gold, chosen = doc["gold"].to_numpy(bool), np.asarray(decode(doc, scores), bool)
        cost = 1 - (gold & chosen).sum() / max(1, gold.sum())
        if cost > 0:
            towards = np.bincount(at, value * (gold.astype(float) - chosen)[row], len(ix))
            norm = float(towards @ towards)
            loss = max(0.0, float(-towards @ now) + cost**0.5)
            tau = eta if kind == "perceptron" else 0.0 if not norm else min(c, loss / norm) if kind == "pa" else loss / (norm + 1 / (2 * c))
            moved, late = moved + tau * towards, late + tau * towards * moves.steps
        moves.steps += 1
        moves.store(ix, moved, late)

    return run


def _units(frames: Iterator[pd.DataFrame], by: list[str], whole: bool) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of runs of rows alike in `by`; with `whole` a run that goes on in the next batch is held back until it ends."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        groups = list(frame.groupby(by, sort=False, dropna=False))
        held = groups.pop()[1] if whole and groups else None
        yield from groups
    if held is not None and len(held):
        yield tuple(held[c].iloc[0] for c in by), held


def _epoch(rows: DataFrame, weights: DataFrame, work: Callable, by: str | None, kind: str, c: float, eta: float) -> DataFrame:
    """(ix, moved, late) summed over the parts; `by` names what is worked on whole (documents), None for single rows."""
    plain = [f for f in rows.columns if f != "items"]
    each = rows.select(*plain, F.explode_outer("items").alias("x")).select(*plain, F.col("x.ix").alias("ix"), F.col("x.value").alias("value"))
    near = each.join(weights.select("ix", "w"), "ix", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    items = F.filter(F.collect_list(F.struct("ix", "value", "w")), lambda x: x["ix"].isNotNull())
    again = near.groupBy("part", "seq").agg(*[F.first(f).alias(f) for f in plain if f not in ("part", "seq")], items.alias("x"))
    field = lambda f: F.transform("x", lambda i: i[f]).alias(f)
    again = again.select(*plain, *[field(f) for f in ("ix", "value", "w")])
    dealt = again.repartition("part").sortWithinPartitions("part", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, moves = None, Moves()
        for (own, *_), frame in _units(frames, ["part", by] if by else ["part"], whole=by is not None):
            if part is not None and own != part:
                yield moves.frame()
                moves = Moves()
            part = own
            work(frame, moves, kind, c, eta)
        if part is not None:
            yield moves.frame()

    return dealt.mapInPandas(run, MOVES).groupBy("ix").agg(F.sum("moved").alias("moved"), F.sum("late").alias("late"), F.count(F.lit(1)).alias("parts"))


def _trained(rows: DataFrame, work: Callable, by: str | None, kind: str, epochs: int, c: float, eta: float, average: bool) -> DataFrame:
    if kind not in ("perceptron", "pa", "pa2"):
        raise ValueError(f"unknown kind {kind}")
    spark = rows.sparkSession
    rows = written(rows, "rows")
    state = spark.createDataFrame([], "ix long, w double, total double")
    for _ in range(epochs):
        moves = written(_epoch(rows, state, work, by, kind, c, eta), "moves")
        run = moves.where(F.col("ix") == STEPS).first()
        if run is None:
            break
        parts, steps = run["parts"], run["late"] / run["parts"]
        both = state.join(moves.where(F.col("ix") != STEPS).drop("parts"), "ix", "full").fillna(0.0)
        state = written(
            both.select("ix", (F.col("w") + F.col("moved") / parts).alias("w"), (F.col("total") + F.col("w") * steps + F.col("late") / parts).alias("total")), "weights"
        )
    return state.select(F.col("ix").alias("feature_ix"), F.col("total" if average else "w").alias("w"))


def train_linear(rows: DataFrame, kind: str = "perceptron", epochs: int = 5, c: float = 1.0, eta: float = 1.0, average: bool = True) -> DataFrame:
    """(feature_ix, w) of a +-1 model; rows have part, seq, y (+1 or -1) and items. Features that never moved have no row.

    Each part's rows are run through by seq. `average` gives the sum of the weights over
    all steps, averaged over the parts.
    """
    slim = rows.select("part", "seq", F.col("y").cast("double").alias("y"), F.col("items").cast(ITEMS).alias("items"))
    return concluded(lambda: _trained(slim, _linear, None, kind, epochs, c, eta, average), "linear")


def train_structured(
    pairs: DataFrame, decode: Callable[[pd.DataFrame, np.ndarray], np.ndarray], parts: int = 8, kind: str = "perceptron", epochs: int = 5,
    c: float = 1.0, eta: float = 1.0, average: bool = True,
) -> DataFrame:
    """(feature_ix, w) from whole documents: decode with the current weights, move towards the gold graph.

    Pairs have grouping, pair_ix, parent, child, gold (boolean) and items; documents are
    dealt into `parts` by a hash. decode(document, scores) gives the chosen rows as
    booleans. The cost of a prediction is its tree loss; perceptron steps eta, pa and pa2
    by the margin that the cost asks for.
    """
    slim = pairs.select(
        F.pmod(F.xxhash64("grouping"), F.lit(parts)).cast("int").alias("part"), F.struct("grouping", "pair_ix").alias("seq"), "grouping", "pair_ix", "parent", "child", "gold",
        F.col("items").cast(ITEMS).alias("items"),
    )
    return concluded(lambda: _trained(slim, _structured(decode), "grouping", kind, epochs, c, eta, average), "structured")

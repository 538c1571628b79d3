"""Language identification by interpolated Kneser-Ney character models.

One model of order ORDER is learned per language. Counts, continuation counts and the
probabilities of all n-grams seen in any language are worked out by aggregations and
joins of DataFrames, none of them is left out, and kept in arrays sorted by the n-grams'
hashes, one row of log-probabilities (a column per language) each, and so are the back-off
weights of histories. The arrays pass the driver once, to be broadcast: an array has no
more values than its n-grams times languages, and the sample they are learned from is
bounded so that these are MAX_CELLS at most, however many languages there are. A text's
cross-entropy per character under each language follows from binary searches; the lowest
wins. A temperature and a rejection threshold are
calibrated on training documents that the models did not see.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .encoding import tidied

ORDER = 4
DISCOUNT = 0.75
#: Bounds of the training sample, in expectation: labelled documents of a language, and
#: their characters (texts are taken whole).
MAX_DOCS = 1500
MAX_CHARS = 4_000_000
#: Characters of the whole sample times languages, in expectation.
MAX_CELLS = 150_000_000
#: One training document in so many calibrates instead of training.
CALIBRATE = 8
#: Calibration documents below which the defaults stay: temperature 1, nothing rejected.
LEAST_CALIBRATION = 20
#: Text positions scored at once.
AT_ONCE = 1_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, blanks as spaces, after ORDER - 1 spaces for the start."""
    codes = np.frombuffer((" " * (ORDER - 1) + text.lower()).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes <= 32, np.uint32(32), codes)


def _hash(codes: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given as columns of code points."""
    h = np.full(len(codes[0]), len(codes), np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # of orders 1 to ORDER
    logs: list[np.ndarray]
    histories: list[np.ndarray]  # of lengths 1 to ORDER - 1
    weights: list[np.ndarray]
    floor: np.ndarray  # log-probability of an unseen character
    temperature: float = 1.0
    threshold: float = float("inf")

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities (positions x languages) of codes[ORDER - 1:]."""
        n = len(codes) - ORDER + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        left = np.arange(n)
        for order in range(ORDER, 0, -1):
            columns = [codes[left + ORDER - order + i] for i in range(order)]
            at, hit = _find(self.keys[order - 1], _hash(columns))
            out[left[hit]] += self.logs[order - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if order > 1:
                at, hit = _find(self.histories[order - 2], _hash([c[~hit] for c in columns[:-1]]))
                out[left[hit]] += self.weights[order - 2][at[hit]]
        out[left] += self.floor
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _by_language(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, m): one map from language number to value for each key."""
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ix", value))).alias("m"))


def fit(counts: DataFrame) -> Models | None:
    """Interpolated Kneser-Ney from (lang, gram, n), the counts of ORDER-grams; None if there are none.

    Below the highest order, an n-gram counts as often as different characters precede
    it. A language has as many rows as n-grams; a gram's languages meet in one row.
    """
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    numbered = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
    own = {ORDER: written(counts.select(numbered.cast("int").alias("ix"), "gram", F.col("n").alias("c")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        shorter = own[k + 1].groupBy("ix", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        own[k] = written(shorter, "grams")
    size = own[1].select("gram").distinct().count() + 1
    base = {r["ix"]: r for r in own[1].groupBy("ix").agg(F.sum("c").alias("t"), (DISCOUNT * F.count(F.lit(1)) / F.sum("c")).alias("w")).collect()}
    each = F.sequence(F.lit(0), F.lit(len(languages) - 1))
    of = lambda values: F.array(*[F.lit(float(v)) for v in values])
    total, floor = of(base[i]["t"] for i in range(len(languages))), of(base[i]["w"] / size for i in range(len(languages)))
    # share of the discounted count, and what the shorter gram adds
    p = lambda i: F.get(floor, i) + F.coalesce((F.col("m")[i] - DISCOUNT) / F.get(total, i), F.lit(0.0))
    table = written(_by_language(own[1], "gram", F.col("c")).select("gram", F.transform(each, p).alias("p")), "order-1")
    keys, logs, histories, weights = [], [], [], []

    def keep(rows: DataFrame, order: int, to_keys: list, to_values: list) -> None:
        hashes, values = _arrays(rows, order, len(languages))
        to_keys.append(hashes)
        to_values.append(values)

    keep(table, 1, keys, logs)
    for k in range(2, ORDER + 1):
        past = own[k].groupBy("ix", F.substring("gram", 1, k - 1).alias("h")).agg(
            F.struct(F.sum("c").alias("t"), (DISCOUNT * F.count(F.lit(1)) / F.sum("c")).alias("w")).alias("v")
        )
        past = written(_by_language(past, "h", F.col("v")).withColumnRenamed("m", "past"), "histories")
        w = lambda i: F.coalesce(F.col("past")[i]["w"], F.lit(1.0))
        keep(past.select(F.col("h").alias("gram"), F.transform(each, w).alias("p")), k - 1, histories, weights)
        p = lambda i: w(i) * F.get("low", i) + F.coalesce((F.col("m")[i] - DISCOUNT) / F.col("past")[i]["t"], F.lit(0.0))  # noqa: E731, B023
        low = table.select(F.col("gram").alias("shorter"), F.col("p").alias("low"))
        now = _by_language(own[k], "gram", F.col("c"))
        now = now.join(past, F.substring("gram", 1, k - 1) == F.col("h")).join(low, F.substring("gram", 2, k - 1) == F.col("shorter"))
        table = written(now.select("gram", F.transform(each, p).alias("p")), f"order-{k}")
        keep(table, k, keys, logs)
    return Models(languages, keys, logs, histories, weights, np.log([base[i]["w"] / size for i in range(len(languages))]).astype(np.float32))


def _arrays(rows: DataFrame, order: int, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams in ascending order, and the logarithms of their values (grams x languages)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = "".join(batch.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(text, "<u4").reshape(batch.num_rows, order)
            h = _hash([codes[:, i] for i in range(order)]).view(np.int64)
            values = np.log(batch.column("p").flatten().to_numpy(zero_copy_only=False)).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values), n_languages).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(h), lists], ["h", "v"])

    found = rows.select("gram", "p").mapInArrow(tidied(hashed), "h long, v array<float>").toArrow()
    hashes = found.column("h").to_numpy().view(np.uint64)
    values = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy(zero_copy_only=False) for c in found.column("v").chunks)])
    sort = np.argsort(hashes)
    return hashes[sort], values.reshape(len(hashes), n_languages)[sort]


def held_out():
    """Whether crc32 of the doc_id as text leaves 1 modulo 3; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over whole texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                total: Counter = Counter()
                for text in texts:
                    codes = _codes(text)
                    for at in range(0, len(codes) - ORDER + 1, AT_ONCE):
                        part = codes[at : at + AT_ONCE + ORDER - 1]
                        windows = np.lib.stride_tricks.sliding_window_view(part, ORDER)
                        grams = np.ascontiguousarray(windows).view(f"<U{ORDER}").ravel()
                        total.update(dict(zip(*(x.tolist() for x in np.unique(grams, return_counts=True)), strict=True)))
                yield pd.DataFrame({"lang": lang, "gram": list(total), "n": list(total.values())})

    rows = sample.select("lang", "text").mapInPandas(tidied(count), "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, max_cells: int = MAX_CELLS) -> Models | None:
    """Models of the languages in (doc_id, text, lang), from a bounded sample of the training rows.

    The sample takes each row of a language with the same chance, by its doc_id's hash,
    so that about `max_docs` rows and `max_chars` characters of it are taken at most, and
    fewer characters where languages are so many that the sample's characters times the
    languages would pass `max_cells`; all n-grams of the sample count. None if there is no labelled training row with a text.
    Where fewer than LEAST_CALIBRATION rows calibrate, the temperature is 1 and no text
    is rejected.
    """
    spark = docs.sparkSession
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if not n:
        return None
    max_chars = min(max_chars, max_cells / len(n) ** 2)
    shares = [(r["lang"], float(min(1.0, max_docs / r["n"], max_chars / max(r["chars"], 1)))) for r in n]
    share = spark.createDataFrame(shares, "lang string, share double")
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    rows = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sample = written(rows.join(F.broadcast(share), "lang").where(chance < F.col("share")), "language-sample")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(CALIBRATE)) == 0
    models = fit(_gram_counts(sample.where(~apart)))
    if models is None:
        return None
    seen = _entropies(sample.where(apart), models, keep="lang").toPandas()
    seen = seen[seen["lang"].isin(models.languages)]
    if len(seen) >= LEAST_CALIBRATION:
        entropy = np.stack(seen["entropy"].to_numpy())
        truth = seen["lang"].map({x: i for i, x in enumerate(models.languages)}).to_numpy()
        right = entropy[np.arange(len(truth)), truth]
        losses = {}
        for t in 2.0 ** np.arange(-2, 8):
            z = -entropy * t
            z -= z.max(axis=1, keepdims=True)
            losses[t] = -(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
        models.temperature = float(min(losses, key=losses.get))
        models.threshold = float(np.quantile(right, 0.999) * 1.25)
    return models


def _entropies(rows: DataFrame, models: Models, keep: str) -> DataFrame:
    """(keep, entropy array): nats per character under each language; null without a letter."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            out: list = [None] * len(frame)
            texts = frame["text"].tolist()
            batch: list[tuple[int, np.ndarray]] = []
            size = 0
            for i, text in enumerate(texts):
                if text is not None and LETTER.search(text):
                    batch.append((i, _codes(text)))
                    size += len(batch[-1][1])
                if batch and (size >= AT_ONCE or i + 1 == len(texts)):
                    for (k, _), e in zip(batch, _mean_scores(model, [c for _, c in batch]), strict=True):
                        out[k] = e
                    batch, size = [], 0
            yield pd.DataFrame({keep: frame[keep], "entropy": out})

    kind = rows.schema[keep].dataType.simpleString()
    return rows.select(keep, "text").mapInPandas(tidied(run), f"{keep} {kind}, entropy array<double>")


def _mean_scores(model: Models, texts: list[np.ndarray]) -> np.ndarray:
    """Cross-entropy of each text; the texts' positions are scored AT_ONCE at a time."""
    sizes = np.array([len(t) - ORDER + 1 for t in texts])
    sums = np.zeros((len(texts), len(model.languages)))
    # joined texts have windows across their ends, which are scored and left out
    joined = np.concatenate(texts)
    first = np.cumsum([0, *[len(t) for t in texts]])[:-1]
    for at in range(0, len(joined) - ORDER + 1, AT_ONCE):
        logs = model.score(joined[at : at + AT_ONCE + ORDER - 1])
        a = np.clip(first - at, 0, len(logs))
        b = np.clip(first + sizes - at, 0, len(logs))
        some = b > a
        # between a text's end and the next one's start lie the windows left out
        edges = np.stack([a[some], b[some]], axis=1).ravel()
        if len(edges):
            whole = np.add.reduceat(np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)]), edges, dtype=np.float64)
            sums[some] += whole[::2]
    return -sums / sizes[:, None]


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), entropy, rejected of each document, from its text alone.

    `und` with score 0 if the text is null or has no letter, or nothing was learned. Of
    languages with equal cross-entropy the first by name is taken; repeated rows are
    predicted alike, whole texts of any length are scored a part at a time. The
    score is the calibrated probability of lang_pred; `rejected` marks texts that are
    less likely under every model than practically all training texts of the language.
    """
    if models is None:
        return docs.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"),
        )
    rows = _entropies(docs.select("doc_id", F.col("text").cast("string").alias("text")), models, keep="doc_id")
    least = F.array_min("entropy")
    names = F.array(*[F.lit(x) for x in models.languages])
    odds = F.aggregate("entropy", F.lit(0.0), lambda s, e: s + F.exp((least - e) * models.temperature))
    return rows.select(
        "doc_id",
        F.coalesce(F.get(names, F.array_position("entropy", least).cast("int") - 1), F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(1 / odds, F.lit(0.0)).alias("score"),
        least.alias("entropy"),
        F.coalesce(least > models.threshold, F.lit(True)).alias("rejected"),
    )


def language_digest(docs: DataFrame) -> DataFrame:
    """Learns from the training rows and predicts all documents, one row each; see `learn` and `identify`.

    A null text or one without a letter is `und` with score 0; a document of null lang is
    never learned from. Repeated rows count and are predicted again, of equally good
    languages the first by name wins, an empty table gives none; other columns are not read.
    """
    with scratch(docs.sparkSession):
        models = learn(docs.select("doc_id", "text", "lang"))
    found = identify(docs, models)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")

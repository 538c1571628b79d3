"""Discourse tables derived from the given ones, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("__UNK__", "elaboration", "narration", "continuation", "UNRELATED", "ROOT")
UNRELATED_IX, ROOT_IX = 4, 5

UNITS = """
SELECT conv_id, turn + 1 AS pos, concat('c', conv_id, '_', turn + 1) AS id, text, concat('c', conv_id) AS grouping,
       concat('c', conv_id, '_s', CAST(floor(turn / 2) AS BIGINT)) AS subgrouping,
       CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start,
       CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS span_end
FROM conversations
"""
PAIRS = """
SELECT c.conv_id, c.grouping, p.pos AS ppos, c.pos AS cpos, c.pos * 4294967296 + p.pos AS pair_ix,
       p.id AS parent, c.id AS child, p.subgrouping AS psub, c.subgrouping AS csub,
       CASE WHEN p.pos <> CASE WHEN c.pos = 1 THEN 0
                 ELSE c.pos - 1 - (c.conv_id + c.pos) % least(c.pos - 1, 3) END THEN 4
            WHEN p.pos = 0 THEN 5
            ELSE 1 + (c.conv_id + p.pos + c.pos) % 3 END AS target
FROM (SELECT conv_id, pos, id, subgrouping FROM units
      UNION ALL SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 'ROOT', CAST(NULL AS STRING) FROM units) p
JOIN units c ON p.conv_id = c.conv_id AND p.pos <> c.pos
"""
WEIGHTS = """
SELECT p.*,
       ((conv_id * 7919 + ppos * 104729 + cpos * 1299709 + 17) % 1000003 + 1) / CAST(1000005 AS DOUBLE) AS attach,
       ((conv_id * 31 + ppos * 17 + cpos * 13 + 1) % 101) / CAST(101 AS DOUBLE) AS w_elaboration,
       ((conv_id * 37 + ppos * 11 + cpos * 29 + 2) % 103) / CAST(103 AS DOUBLE) AS w_narration,
       ((conv_id * 41 + ppos * 23 + cpos * 7 + 3) % 107) / CAST(107 AS DOUBLE) AS w_continuation
FROM pairs p
"""
SPANS = """
SELECT conv_id, grouping, least(ppos, cpos) AS span_lo, greatest(ppos, cpos) AS span_hi,
       CASE WHEN (conv_id + cpos) % 2 = 0 THEN 'Nucleus' ELSE 'Satellite' END AS nuclearity,
       CASE target WHEN 1 THEN 'elaboration' WHEN 2 THEN 'narration' ELSE 'continuation' END AS relation
FROM pairs WHERE target <> 4 AND ppos > 0
"""
INSTANCES = """
SELECT grouping, pair_ix, parent AS m_source, child AS m_target, abs(cpos - ppos) AS c_distance,
       CASE WHEN psub = csub THEN 'True' ELSE 'False' END AS d_same_sentence,
       CASE WHEN cpos - ppos = 1 THEN 'True' ELSE 'False' END AS d_last,
       concat('k', (conv_id + ppos) % 4) AS d_kind,
       CASE WHEN target <> 4 THEN 'True' ELSE 'False' END AS c_class
FROM pairs
"""
TOKENS_SPARK = """
SELECT conv_id, pos, grouping, id AS unit_id, CAST(tok_ix AS BIGINT) AS tok_ix, form
FROM units LATERAL VIEW posexplode(split(text, ' ')) x AS tok_ix, form
"""
TOKENS_DUCKDB = """
SELECT conv_id, pos, grouping, id AS unit_id,
       generate_subscripts(string_split(text, ' '), 1) - 1 AS tok_ix,
       unnest(string_split(text, ' ')) AS form
FROM units
"""
TAGGED = """
SELECT t.*, lower(form) AS lemma,
       CASE (length(form) + tok_ix) % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'V' WHEN 2 THEN 'PRO' ELSE 'DET' END AS cpos_tag,
       CASE WHEN tok_ix = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(floor((tok_ix - 1) / 2) AS BIGINT) END AS head_ix,
       CAST(coalesce(sum(length(form) + 1) OVER (PARTITION BY conv_id, pos ORDER BY tok_ix
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tok_start
FROM tokens t
"""
#: The label by number of the largest label weight, the first on ties, for SQL.
BEST = """CASE WHEN greatest(w_elaboration, w_narration, w_continuation) <= 0 THEN 0
     WHEN w_elaboration >= w_narration AND w_elaboration >= w_continuation THEN 1
     WHEN w_narration >= w_continuation THEN 2 ELSE 3 END"""
DUCKDB = {
    "units": UNITS, "pairs": PAIRS, "weights": WEIGHTS, "spans": SPANS, "instances": INSTANCES,
    "tokens": TOKENS_DUCKDB, "tagged": TAGGED,
}


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names, and those that they need, at its head."""
    used, found = [], sql
    for name in reversed(DUCKDB):
        if f" {name}" in found.replace("\n", " "):
            used.append(name)
            found += DUCKDB[name].replace("\n", " ")
    head = ",\n".join(f"{n} AS ({DUCKDB[n].strip()})" for n in reversed(used))
    body = sql.strip()
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


class Bridge:
    """The discourse tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, query: str, **frames: DataFrame) -> DataFrame:
        for name in frames:
            query = query.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
        return self.spark.sql(query, **frames)

    @cached_property
    def units(self) -> DataFrame:
        return self._sql(UNITS, conversations=self.table("conversations"))

    @cached_property
    def pairs(self) -> DataFrame:
        return self._sql(PAIRS, units=self.units)

    @cached_property
    def weights(self) -> DataFrame:
        """Pairs with attach and label_w, a weight for each of LABELS."""
        rows = self._sql(WEIGHTS, pairs=self.pairs)
        own = [F.col(f"w_{x}") for x in LABELS[1:4]]
        return rows.withColumn("label_w", F.array(F.lit(0.0), *own, F.lit(0.0), F.lit(0.0)))

    @cached_property
    def spans(self) -> DataFrame:
        return self._sql(SPANS, pairs=self.pairs)

    @cached_property
    def instances(self) -> DataFrame:
        """Instances with their items as the map `feats`."""
        rows = self._sql(INSTANCES, pairs=self.pairs)
        names = {
            "m#source": "m_source", "m#target": "m_target", "C#distance": "c_distance",
            "D#same_sentence": "d_same_sentence", "D#LAST": "d_last", "D#kind": "d_kind", "c#class": "c_class",
        }
        items = [x for k, c in names.items() for x in (F.lit(k), F.col(c).cast("string"))]
        return rows.withColumn("feats", F.create_map(*items))

    @cached_property
    def tagged(self) -> DataFrame:
        return self._sql(TAGGED, tokens=self._sql(TOKENS_SPARK, units=self.units))

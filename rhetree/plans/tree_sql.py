"""DuckDB SQL for the search decoders, by other means than the library's.

Candidates are rows (g, p, c, pair_ix, attach) of a table: g is what is decoded by itself, p and
c are units by number, 0 being ROOT. Trees grow a unit at a time over the sets of units that
they hold (best tree for each set); the others follow their one-at-a-time definition, a
step of recursion for each link or unit. Documents of the given tables have eight units.
"""

from __future__ import annotations

#: Units of a document, ROOT included, that the projective chart has widths for.
MOST = 12
#: The score of a link: its logit, certain and impossible ones far out.
ODDS = "CASE WHEN attach >= 1 THEN 1e6 WHEN attach <= 0 THEN -1e6 ELSE ln(attach / (1 - attach)) END"
LOG = "CASE WHEN attach <= 0 THEN -1e6 ELSE ln(attach) END"


def mst(rows: str, x: str) -> str:
    """CTEs that end in `{x}tree` (g, pair_ix)."""
    return f"""{x}e AS (SELECT g, p, c, pair_ix, {ODDS} AS w FROM {rows} WHERE p <> c AND c > 0),
    {x}all AS (SELECT g, sum(1::BIGINT << c::INTEGER)::BIGINT + 1 AS m FROM (SELECT DISTINCT g, c FROM {x}e) GROUP BY g),
    {x}s AS (SELECT g, 1::BIGINT AS mask, 0::DOUBLE AS total, []::BIGINT[] AS tree FROM {x}all
             UNION ALL SELECT g, mask, max(total), arg_max(tree, total) FROM (
                 SELECT s.g, s.mask | (1::BIGINT << e.c::INTEGER) AS mask, s.total + e.w AS total, list_append(s.tree, e.pair_ix) AS tree
                 FROM {x}s s JOIN {x}e e ON e.g = s.g AND (s.mask >> e.c::INTEGER) & 1 = 0 AND (s.mask >> e.p::INTEGER) & 1 = 1) GROUP BY g, mask),
    {x}tree AS (SELECT s.g, unnest(s.tree) AS pair_ix FROM {x}s s JOIN {x}all a ON a.g = s.g AND a.m = s.mask)"""


def msdag(rows: str, x: str) -> str:
    """CTEs that end in `{x}dag` (g, pair_ix): the tree's links, then the others by falling score unless they close a circle."""
    return f"""{mst(rows, x)},
    {x}r AS (SELECT e.*, row_number() OVER (PARTITION BY e.g ORDER BY t.pair_ix IS NULL, w DESC, e.pair_ix) AS k FROM {x}e e LEFT JOIN {x}tree t ON t.g = e.g AND t.pair_ix = e.pair_ix),
    {x}d AS (SELECT g, 0::BIGINT AS k, list_transform(range(0, 63), lambda i: 1::BIGINT << i::INTEGER) AS reach, []::BIGINT[] AS kept FROM {x}all
             UNION ALL SELECT d.g, r.k, CASE WHEN (reach[c + 1] >> p::INTEGER) & 1 = 1 THEN reach ELSE list_transform(reach, lambda y: CASE WHEN (y >> p::INTEGER) & 1 = 1 THEN y | reach[c + 1] ELSE y END) END,
                 CASE WHEN (reach[c + 1] >> p::INTEGER) & 1 = 1 THEN kept ELSE list_append(kept, r.pair_ix) END FROM {x}d d JOIN {x}r r ON r.g = d.g AND r.k = d.k + 1),
    {x}dag AS (SELECT g, unnest(arg_max(kept, k)) AS pair_ix FROM {x}d GROUP BY g)"""


def eisner(rows: str, x: str) -> str:
    """CTEs that end in `{x}proj` (g, pair_ix): the best projective tree with one child of unit 0; a CTE for each width."""
    out = [
        f"{x}e AS (SELECT g, p, c, pair_ix, {LOG} AS w FROM {rows} WHERE p <> c AND c > 0)",
        f"{x}n AS (SELECT g, max(greatest(p, c)) AS n FROM {x}e GROUP BY g)",
        f"""{x}c0 AS (SELECT g, i, i AS j, 0::DOUBLE AS ro, 0::DOUBLE AS lo, 0::DOUBLE AS rc, 0::DOUBLE AS lc, []::BIGINT[] AS tro, []::BIGINT[] AS tlo, []::BIGINT[] AS trc, []::BIGINT[] AS tlc
            FROM (SELECT g, unnest(range(0, n + 1)) AS i FROM {x}n))""",
    ]
    for w in range(1, MOST):
        chart = " UNION ALL ".join(f"SELECT * FROM {x}c{v}" for v in range(w))
        inner = chart.replace(f"SELECT * FROM {x}c0 UNION ALL ", "") if w > 1 else f"SELECT * FROM {x}c0 WHERE false"
        out.append(f"""{x}o{w} AS (SELECT a.g, a.i, b.j, max(a.rc + b.lc) AS s, arg_max(list_concat(a.trc, b.tlc), a.rc + b.lc) AS t,
                max(a.rc + b.lc) FILTER (WHERE a.i > 0 OR a.j = 0) AS s1, arg_max(list_concat(a.trc, b.tlc), a.rc + b.lc) FILTER (WHERE a.i > 0 OR a.j = 0) AS t1
            FROM ({chart}) a JOIN ({chart}) b ON b.g = a.g AND b.i = a.j + 1 AND b.j = a.i + {w} GROUP BY 1, 2, 3)""")
        out.append(f"""{x}i{w} AS (SELECT a.g, a.i, b.j, max(a.lc + b.lo) AS l, arg_max(list_concat(a.tlc, b.tlo), a.lc + b.lo) AS tl, max(a.ro + b.rc) AS r, arg_max(list_concat(a.tro, b.trc), a.ro + b.rc) AS tr
            FROM ({inner}) a JOIN ({inner}) b ON b.g = a.g AND b.i = a.j AND b.j = a.i + {w} GROUP BY 1, 2, 3)""")
        out.append(f"""{x}c{w} AS (SELECT g, i, j, ro, lo, greatest(ro, coalesce(r, ro)) AS rc, greatest(lo, coalesce(l, lo)) AS lc, tro, tlo,
                CASE WHEN r >= ro THEN tr ELSE tro END AS trc, CASE WHEN l > lo THEN tl ELSE tlo END AS tlc FROM (
            SELECT o.*, n.l, n.tl, n.r, n.tr, coalesce(s1 + f.w, -1e12) AS ro, list_append(t1, f.pair_ix) AS tro, coalesce(s + b.w, -1e12) AS lo, list_append(t, b.pair_ix) AS tlo
            FROM {x}o{w} o LEFT JOIN {x}i{w} n ON n.g = o.g AND n.i = o.i AND n.j = o.j
            LEFT JOIN {x}e f ON f.g = o.g AND f.p = o.i AND f.c = o.j LEFT JOIN {x}e b ON b.g = o.g AND b.p = o.j AND b.c = o.i))""")
    every = " UNION ALL ".join(f"SELECT * FROM {x}c{v}" for v in range(1, MOST))
    out.append(f"{x}proj AS (SELECT c.g, unnest(c.trc) AS pair_ix FROM ({every}) c JOIN {x}n n ON n.g = c.g WHERE c.i = 0 AND c.j = n.n)")
    return ",\n    ".join(out)


def greedy(rows: str, x: str) -> str:
    """CTEs that end in `{x}greedy` (g, pair_ix); units whose numbers differ by 1 are neighbours."""
    return f"""{x}e AS (SELECT g, p, c, pair_ix, attach FROM {rows} WHERE p <> c AND attach > 0),
    {x}u AS (SELECT g, max(greatest(p, c)) AS n FROM {rows} GROUP BY g),
    {x}w AS (SELECT g, (1::BIGINT << (n + 1)::INTEGER) - 1 AS here, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 2 ELSE (5::BIGINT << (i - 1)::INTEGER) END) AS near, []::BIGINT[] AS kept FROM {x}u
             UNION ALL SELECT g, here & ~(1::BIGINT << p::INTEGER), list_transform(near, lambda y, i: CASE WHEN i = c + 1 THEN y | near[p + 1] ELSE y END), list_append(kept, pair_ix) FROM (
                 SELECT w.*, e.p, e.c, e.pair_ix, row_number() OVER (PARTITION BY w.g ORDER BY e.attach DESC, e.p, e.c) AS k
                 FROM {x}w w JOIN {x}e e ON e.g = w.g AND (w.here >> e.p::INTEGER) & 1 = 1 AND (w.near[e.p + 1] >> e.c::INTEGER) & 1 = 1 WHERE bit_count(w.here) > 1) WHERE k = 1),
    {x}greedy AS (SELECT g, unnest(arg_max(kept, len(kept))) AS pair_ix FROM {x}w GROUP BY g)"""


def reading_order(rows: str, x: str, nbest: int = 1, full: bool = False) -> str:
    """CTEs that end in `{x}order` (g, k, pair_ix): all ways along the right frontier, the cheapest ones; with `full` rows have the boolean coord."""
    keep = "CASE WHEN e.coord THEN s.at - 1 ELSE s.at END" if full else "s.at"
    coord = ", coord" if full else ""
    return f"""{x}e AS (SELECT g, p, c, pair_ix, -({LOG}) AS w{coord} FROM {rows} WHERE p < c),
    {x}n AS (SELECT g, max(c) AS n FROM {x}e GROUP BY g),
    {x}s AS (SELECT g, 0::BIGINT AS j, [0]::BIGINT[] AS open, 0::DOUBLE AS spent, []::BIGINT[] AS path FROM {x}n
             UNION ALL SELECT s.g, s.j + 1, list_append(open[1:{keep}], s.j + 1), spent + e.w, list_append(path, e.pair_ix)
             FROM (SELECT *, unnest(range(1, len(open) + 1)) AS at FROM {x}s) s JOIN {x}e e ON e.g = s.g AND e.c = s.j + 1 AND e.p = s.open[s.at]),
    {x}order AS (SELECT g, k, unnest(path) AS pair_ix FROM (
        SELECT s.g, path, row_number() OVER (PARTITION BY s.g ORDER BY spent, path) AS k FROM {x}s s JOIN {x}n n ON n.g = s.g AND n.n = s.j) WHERE k <= {nbest})"""

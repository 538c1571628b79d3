"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import bpe_digest
from .common import table
from .embedding_dedup import embedding_links
from .language_id import language_digest
from .near_join import near_digest
from .packing import packing_digest
from .periodic_runs import runs_digest
from .phrases import phrase_digest
from .quality import PRODUCTION, mask_of, quality_digest
from .quality import RULES as QUALITY_RULES
from .secrets import RULES, SecretRule, secrets_digest
from .sharding import sharding_digest
from .substring_dedup import substring_digest
from .token_files import token_file_digest
from .url_filter import BLOCKED_HOSTS, LOWER, PARTS, UPPER, url_digest
from .url_filter import RULES as URL_RULES


def op1_secret_scan(spark, sf_dir):
    return secrets_digest(table(spark, sf_dir, "documents"))


def op2_near_join(spark, sf_dir):
    return near_digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_digest(table(spark, sf_dir, "documents"))


def op4_sharding(spark, sf_dir):
    return sharding_digest(table(spark, sf_dir, "documents"))


def op5_token_files(spark, sf_dir):
    return token_file_digest(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark, sf_dir):
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark, sf_dir):
    return substring_digest(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    return bpe_digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return language_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing_digest(table(spark, sf_dir, "documents"))


def op11_url_filter(spark, sf_dir):
    return url_digest(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark, sf_dir):
    return runs_digest(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark, sf_dir):
    return phrase_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_near_join, op3_quality_rules, op4_sharding, op5_token_files, op6_embedding_dedup, op7_substring_dedup, op8_byte_bpe,
        op9_language_id, op10_packing, op11_url_filter, op12_periodic_runs, op13_phrase_mining,
    )
}


def _kind_sql(rule: SecretRule, place: int) -> str:
    """(doc_id, place, start, end) of a rule's matches: each starts after the gaps and matches before it."""
    pattern = rule.pattern.replace("'", "''")
    total = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {place} AS place, start, start + length(m[k]) AS stop FROM (
        SELECT doc_id, m, p, k, {total("g[1:k]")} + {total("m[1:k - 1]")} AS start FROM (
            SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS k FROM (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS m, regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.group}) AS p,
                       regexp_split_to_array(coalesce(text, ''), '{pattern}') AS g FROM documents))) WHERE length(p[k]) >= {rule.least}"""


KINDS = ", ".join(f"'{r.kind}'" for r in RULES)
SPANS = f"string_agg(concat(list_extract([{KINDS}], place + 1), ':', start, ':', stop), ',' ORDER BY start, place)"
SECRET_SQL = f"""
WITH s AS ({" UNION ALL ".join(_kind_sql(r, i) for i, r in enumerate(RULES))}),
     f AS (SELECT doc_id, count(*) FILTER (WHERE place = 0) AS a, count(*) FILTER (WHERE place = 1) AS b, count(*) FILTER (WHERE place = 2) AS c,
                  {SPANS} FILTER (WHERE place < 3) AS base, {SPANS} AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN f USING (doc_id)
"""
BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(QUALITY_RULES))
SOLE = " ".join(f"WHEN {1 << i} THEN '{r.name}'" for i, r in enumerate(QUALITY_RULES) if mask_of(PRODUCTION) >> i & 1)
QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
     g AS (SELECT doc_id, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
     r AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM (
                SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY 1),
     m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
                  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
     f AS (SELECT *, ({BITS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed, failed & {mask_of("base")} <> 0 AS base_failed,
       failed & {mask_of("base") | mask_of(PRODUCTION)} = 0 AS kept, failed & {mask_of("v1")} = 0 AS kept_v1, failed & {mask_of("v2")} = 0 AS kept_v2,
       sole_rule, CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY sole_rule) END AS n_sole
FROM (SELECT *, CASE failed & {mask_of(PRODUCTION)} {SOLE} END AS sole_rule FROM f)
"""
EMBEDDING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
     r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.m),
     c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1),
     n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
#: Rules in the order in which they win, as a list of DuckDB.
URL_LIST = ", ".join(f"{{'h': '{h}', 'p': '{p}', 'v': '{v}'}}" for h, p, v in sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -r[0].count("."))))
URL_HOSTS = ", ".join(f"'{h}'" for h in BLOCKED_HOSTS)
URL_SQL = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
     r AS (SELECT *, list_filter([{URL_LIST}], lambda x: (host = x.h OR ends_with(host, '.' || x.h)) AND starts_with(path, x.p))[1] AS own,
                  len(list_filter([{URL_HOSTS}], lambda x: host = x OR ends_with(host, '.' || x))) > 0 AS listed FROM u)
SELECT page_id, host, path, own.h || own.p AS rule, CASE WHEN own.v IS NOT NULL THEN own.v WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
PHRASE_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
     t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
     f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k)) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
     c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS s, n AS a FROM f WHERE k > 1),
     cuts AS (SELECT c.*, l.n AS l, r.n AS r, cut, (1000::HUGEINT * a * t.n) // (l.n::HUGEINT * r.n) AS score, t.n
              FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN t USING (lang)
              JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(s[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(s[cut + 1:], ' ')),
     best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     parts AS (SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(a) AS beyond
               FROM (SELECT lang, s, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) y(m) WHERE m < k) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best LEFT JOIN parts USING (lang, phrase) WHERE beyond IS NULL OR beyond < a QUALIFY rank <= 2000
"""
#: The others have no SQL: it has no tokenizer, MinHash, crc32 or language model; tests hold them against brute force.
SQL: dict[str, str] = {
    "op1_secret_scan": SECRET_SQL, "op3_quality_rules": QUALITY_SQL, "op6_embedding_dedup": EMBEDDING_SQL, "op11_url_filter": URL_SQL,
    "op13_phrase_mining": PHRASE_SQL,
}

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tableflow.llm.urls import RULES, SHARED

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY k) AS group_size,
         first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""


def _rule_case(value: str) -> str:
    longest_first = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    whens = " ".join(
        f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}') THEN "
        + (f"'{host}{path}'" if value == "rule" else f"'{verdict}'")
        for verdict, host, path in longest_first
    )
    return f"CASE {whens} END"


def _level(name: str, groups: str, parent: str) -> str:
    return f"""
{name}_in AS (SELECT g.*, prior FROM ({groups}) g, {parent}),
{name}_s AS (
  SELECT coalesce((1 - rho) / rho, 1.0) AS strength FROM (
    SELECT CASE WHEN sum((n - 1) * prior * (1 - prior)) > 0 THEN
      least(greatest((sum((bad - n * prior) * (bad - n * prior) / n) - sum(prior * (1 - prior)))
                     / sum((n - 1) * prior * (1 - prior)), 0.001), 0.999) END AS rho
    FROM {name}_in WHERE n > 0)),
{name} AS (SELECT *, bad + strength * prior AS a, n - bad + strength * (1 - prior) AS b FROM {name}_in, {name}_s)"""


OP3 = f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         try_cast(nullif(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]+)', 1), '') AS BIGINT) AS doc_id
  FROM pages
), h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(host, '.') AS parts
  FROM p LEFT JOIN (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id) l USING (doc_id)
  GROUP BY host
), h1 AS (
  SELECT *, CASE WHEN length(parts[-1]) = 2 AND parts[-2] IN ({", ".join(f"'{x}'" for x in SHARED)})
                 THEN parts[-2] || '.' || parts[-1] ELSE parts[-1] END AS suffix_ FROM h0
), h AS (
  SELECT host, n, bad, suffix_, array_to_string(parts[greatest(1, len(parts) - len(string_split(suffix_, '.'))) : ], '.') AS domain_ FROM h1
), top AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS prior FROM h),
{_level("s", "SELECT suffix_, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL", "top")},
{_level("d", "SELECT domain_, suffix_, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL",
        "(SELECT suffix_ AS k, a / (a + b) AS prior FROM s) WHERE k = g.suffix_")},
{_level("o", "SELECT * FROM h", "(SELECT domain_ AS k, a / (a + b) AS prior FROM d) WHERE k = g.domain_")},
known AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM o)
SELECT page_id, host, path, {_rule_case("rule")} AS rule,
       coalesce({_rule_case("verdict")}, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(low, 6) AS low
FROM p JOIN known USING (host)
"""

OP11 = """
WITH tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
             lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
         md5(concat_ws(':', '17', doc_id::VARCHAR)) AS drawn_at
  FROM documents, tbl
), f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY drawn_at) - 1
                 + (('0x' || md5(concat_ws(':', '17', source))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
               / count(*) OVER (PARTITION BY source) AS fraction FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, drawn_at) - 1 AS position, count(*) OVER () AS total FROM f
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 24 // total)::INT AS shard,
       position - ((position * 24 // total) * total + 23) // 24 AS slot, NULL::INT AS grown_shard
FROM p
"""


def _round(name: str, books: str) -> str:
    """The nearest entry of every part, the lower of equals."""
    return f"""
{name} AS (
  SELECT vec_id, part, p, struct_extract(nearest, 'd') AS d, struct_extract(nearest, 'entry') AS entry FROM (
    SELECT vec_id, part, any_value(v.p) AS p,
           min({{'d': list_sum(list_transform(list_zip(v.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': b.entry}}) AS nearest
    FROM parts v JOIN {books} b USING (part) GROUP BY vec_id, part))"""


def _moved(name: str, books: str, assigned: str) -> str:
    """Every entry as the mean of its parts, rounded down."""
    return f"""
{name} AS (
  SELECT part, entry, coalesce(m.p, b.p) AS p FROM {books} b LEFT JOIN (
    SELECT part, entry, list(x ORDER BY i) AS p FROM (
      SELECT part, entry, i, floor(sum(p[i])::DOUBLE / count(*))::BIGINT AS x
      FROM {assigned}, range(1, (SELECT max(len(p)) + 1 FROM parts)) r(i) GROUP BY part, entry, i)
    GROUP BY part, entry) m USING (part, entry))"""


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP12 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS c FROM embeddings WHERE {_USABLE}
), parts AS (
  SELECT vec_id, part, c[part * (len(c) // 16) + 1 : (part + 1) * (len(c) // 16)] AS p FROM v, range(16) r(part)
), firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64
), b0 AS (SELECT part, entry, p FROM parts JOIN firsts USING (vec_id)),
{_round("a0", "b0")},
{_moved("b1", "b0", "a0")},
{_round("a1", "b1")},
{_moved("b2", "b1", "a1")},
{_round("a2", "b2")},
coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', entry::INT)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id
), books AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books
"""

OP13 = f"""
WITH v AS (
  SELECT row_number() OVER () AS number, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS c
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_USABLE}
), s AS (
  SELECT a.number, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, a.number = o.number AS own,
         list_sum(list_transform(list_zip(a.c, o.c), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v o WHERE a.vec_id % 100 = 0
), p AS (
  SELECT number, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS nth
  FROM s WHERE same AND NOT own QUALIFY nth <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.number, nth ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.number = s.number AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLES = {
    "op3_host_reputation": OP3,
    "op5_radix_dedup": OP5,
    "op11_interleaved_shards": OP11,
    "op12_pivot_codes": OP12,
    "op13_hard_negatives": OP13,
}

"""The queries' results in SQL (DuckDB), where SQL can express them."""

from __future__ import annotations

from sentika.llm import mixing

LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
),
hit AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, gram)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit
       FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (('0x' || substr(h, {at}, 5))::BIGINT >> {shift}) % 32 AS INTEGER), 1)"
BASE32 = " || ".join(_DIGIT.format(at=1 + 5 * k, shift=15 - 5 * j) for k in range(8) for j in range(4))

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, {BASE32} AS payload_digest
      FROM (SELECT page_id, html, sha1(html) AS h FROM p)),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


def _fill(name: str, source: str, above: list[str], level: str) -> str:
    """Common table expressions that split ``given`` over the children of each node."""
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    order = f"{part} ORDER BY cap / weight, {level} NULLS FIRST"
    keys = ", ".join([*above, level])
    return f"""
{name}_r AS (
  SELECT *, weight > 0 AND CAST(cap AS HUGEINT) * sum(weight) OVER (ORDER_ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (given - coalesce(sum(cap) OVER (ORDER_ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM {source}
),
{name}_s AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS used,
         sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}) AS open_weight FROM {name}_r
),
{name} AS (
  SELECT {keys}, CAST(CASE WHEN is_full THEN cap WHEN weight > 0
    THEN least(cap, CAST((given - used) AS HUGEINT) * weight // open_weight) ELSE 0 END AS BIGINT) AS budget FROM {name}_s
)""".replace("ORDER_ROWS", order + " ROWS")


def _same(a: str, b: str, keys: list[str]) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _weight(level: str) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in mixing.WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE 1 END"


def _mixing(share: float, epochs: int, seed: int) -> str:
    levels = list(mixing.LEVELS)
    steps = []
    for k, level in enumerate(levels):
        own, above = levels[: k + 1], levels[:k]
        given = f"JOIN b{k - 1} ON {_same('n', f'b{k - 1}', above)}" if above else ", (SELECT CAST(floor(sum(tokens) * %s) AS BIGINT) AS budget FROM leaves) AS root" % share
        budget = f"b{k - 1}.budget" if above else "root.budget"
        cols = ", ".join(own)
        steps.append(
            f"n{k} AS (SELECT n.*, {budget} AS given FROM (SELECT {cols}, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap, "
            f"{_weight(level)} AS weight FROM leaves GROUP BY {cols}) AS n {given})"
        )
        steps.append(_fill(f"b{k}", f"n{k}", above, level))
    keys = ", ".join(levels)
    last = f"b{len(levels) - 1}"
    return f"""
WITH d AS (
  SELECT doc_id, lang, source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'none'
         ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents
),
leaves AS (SELECT {keys}, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY {keys}),
{", ".join(steps)},
plan AS (
  SELECT l.*, b.budget, CASE WHEN l.tokens > 0 THEN b.budget // l.tokens ELSE 0 END AS epochs,
         CASE WHEN l.tokens > 0 THEN b.budget % l.tokens ELSE 0 END AS rest
  FROM leaves AS l JOIN {last} AS b ON {_same("l", "b", levels)}
),
h AS (
  SELECT d.*, p.budget, p.epochs, p.rest,
         ('0x' || substr(md5('{seed}:' || p.epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM d JOIN plan AS p ON {_same("d", "p", levels)}
),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY {keys} ORDER BY h) AS upto FROM h)
SELECT doc_id, {keys}, tokens, budget, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM c
"""

OP12 = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format(t="text")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
s AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM p),
e AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM s WHERE len(w) > 0),
g AS (
  SELECT lang, k, w[i] AS w1, CASE WHEN k > 1 THEN w[i + 1] END AS w2, CASE WHEN k > 2 THEN w[i + 2] END AS w3, count(*) AS f
  FROM e, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
),
u AS (SELECT lang, w1, f FROM g WHERE k = 1),
b AS (SELECT lang, w1, w2, f FROM g WHERE k = 2 AND f >= 10),
t AS (SELECT lang, w1, w2, w3, f FROM g WHERE k = 3 AND f >= 10),
longest AS (
  SELECT lang, w1, w2, max(f) AS longer
  FROM (SELECT lang, w1, w2, f FROM t UNION ALL SELECT lang, w2, w3, f FROM t) GROUP BY lang, w1, w2
),
c2 AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r
  FROM b JOIN u x USING (lang, w1) JOIN u y ON y.lang = b.lang AND y.w1 = b.w2
  LEFT JOIN longest z ON z.lang = b.lang AND z.w1 = b.w1 AND z.w2 = b.w2
  WHERE z.longer IS NULL OR 100 * z.longer < 50 * b.f
),
c3 AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, u1.f AS l1, b1.f AS r1, b2.f AS l2, u2.f AS r2,
         (1000000::HUGEINT * t.f * t.f) // (u1.f::HUGEINT * b1.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (b2.f::HUGEINT * u2.f) AS s2
  FROM t JOIN u u1 USING (lang, w1) JOIN u u2 ON u2.lang = t.lang AND u2.w1 = t.w3
  JOIN b b1 ON b1.lang = t.lang AND b1.w1 = t.w2 AND b1.w2 = t.w3 JOIN b b2 ON b2.lang = t.lang AND b2.w1 = t.w1 AND b2.w2 = t.w2
),
every AS (
  SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM c2
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM u GROUP BY lang) USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": OP2,
        "op6_warc_segments": OP6,
        "op8_hierarchical_mixing": _mixing(0.5, 4, 1),
        "op12_collocations": OP12,
    }

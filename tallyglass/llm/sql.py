"""DuckDB statements that give the rows of the queries which SQL can express."""

from __future__ import annotations

from tallyglass.llm import url_filter as U

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Shares of the output's bytes; what they leave is shared by the other sources.
SOURCE_WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.02}


def _rules(value) -> str:
    whens = []
    for text in sorted(URL_RULES, key=lambda r: (-len(r), r)):
        host, slash, path = text.partition("/")
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{value(text)}'")
    return "CASE " + " ".join(whens) + " END"


def _url_filter() -> str:
    n = U.ORDER + 1
    levels = []
    for k in range(n):
        above = f"level{k - 1}" if k else f"(SELECT gram, 1.0::DOUBLE / {U.SYMBOLS} AS pa, 1.0::DOUBLE / {U.SYMBOLS} AS pb FROM grams)"
        blend = ", ".join(
            f"CASE WHEN n{m} > 0 THEN (c{m} + t{m} * p{m}) / (n{m} + t{m})::DOUBLE ELSE p{m} END AS p{m}" for m in "ab"
        )
        levels.append(
            f"seen{k} AS (SELECT right(gram, {k + 1}) AS t, sum(allow)::BIGINT AS ca, sum(block)::BIGINT AS cb FROM grams GROUP BY 1),\n"
            f"above{k} AS (SELECT left(t, {k}) AS x, sum(ca)::BIGINT AS na, sum(cb)::BIGINT AS nb, "
            f"count(*) FILTER (WHERE ca > 0) AS ta, count(*) FILTER (WHERE cb > 0) AS tb FROM seen{k} GROUP BY 1),\n"
            f"level{k} AS (SELECT gram, {blend} FROM {above} p JOIN seen{k} s ON s.t = right(p.gram, {k + 1}) "
            f"JOIN above{k} a ON a.x = left(s.t, {k}))"
        )
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
named AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{U.UPPER}', '{U.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
parsed AS (
  SELECT row_number() OVER () AS rid, page_id, host, path, {_rules(lambda t: t)} AS rule, {_rules(URL_RULES.get)} AS verdict,
         left(md5(rest), 1) IN ('0', '4', '8', 'c') AS calibrates,
         '{"^" * U.ORDER}' || regexp_replace(regexp_replace(translate(rest, '{U.UPPER}', '{U.LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./?=&#_%:-]', '~', 'g') || '$' AS s
  FROM named
),
exploded AS (
  SELECT rid, verdict, calibrates, unnest(list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n}))) AS gram FROM parsed
),
grams AS (
  SELECT gram, count(*) FILTER (WHERE verdict = 'allow' AND NOT calibrates) AS allow, count(*) FILTER (WHERE verdict = 'block' AND NOT calibrates) AS block
  FROM exploded GROUP BY gram
),
{(","+chr(10)).join(levels)},
model AS (SELECT gram, CAST(round({U.UNIT} * (ln(pa) - ln(pb))) AS BIGINT) AS llr FROM level{n - 1}),
scored AS (
  SELECT rid, CAST(floor(sum(llr)::DOUBLE / count(*)) AS BIGINT) AS score FROM exploded JOIN model USING (gram)
  WHERE verdict IS NULL OR calibrates GROUP BY rid
),
stepped AS (
  SELECT rid, verdict, score, CAST(greatest(-{U.STEPS}, least({U.STEPS}, floor(score / {U.STEP}::DOUBLE))) AS INTEGER) AS step
  FROM scored JOIN parsed USING (rid)
),
known AS (SELECT step, verdict FROM stepped WHERE verdict IS NOT NULL),
totals AS (SELECT count(*) FILTER (WHERE verdict = 'allow') AS na, count(*) FILTER (WHERE verdict = 'block') AS nb FROM known),
tried AS (
  SELECT t, (SELECT count(*) FROM known WHERE verdict = 'allow' AND step < t) * nb + (SELECT count(*) FROM known WHERE verdict = 'block' AND step >= t) * na AS error
  FROM totals, range(-{U.STEPS}, {U.STEPS + 1}) r(t)
),
chosen AS (
  SELECT CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE (SELECT t FROM tried ORDER BY error, abs(t), t LIMIT 1) END AS threshold FROM totals
)
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.verdict, CASE WHEN s.step >= threshold THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN p.verdict IS NULL THEN s.score END AS score
FROM parsed p LEFT JOIN stepped s USING (rid) CROSS JOIN chosen"""


_BALL_TREE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


def _poisson_mix() -> str:
    given = "CASE source " + " ".join(f"WHEN '{s}' THEN CAST({w} AS DOUBLE)" for s, w in SOURCE_WEIGHTS.items()) + " END"
    rest = max(0.0, 1.0 - sum(SOURCE_WEIGHTS.values()))
    return f"""
WITH d AS (SELECT *, strlen(coalesce(text, '')) + 1 AS b, 'mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS key FROM documents),
sizes AS (SELECT source, CAST(sum(b) AS BIGINT) AS bytes, {given} AS given FROM d GROUP BY source),
facts AS (
  SELECT sum(bytes)::DOUBLE AS everything, sum(bytes) FILTER (WHERE given IS NULL)::DOUBLE AS free,
         coalesce(sum(given), 0) + CASE WHEN count(*) FILTER (WHERE given IS NULL) > 0 THEN {rest!r}::DOUBLE ELSE 0 END AS whole
  FROM sizes
),
rates AS (
  SELECT source, coalesce(given, {rest!r}::DOUBLE * bytes / free) / whole * everything / bytes AS mean FROM sizes, facts
),
drawn AS (SELECT source, mean, CAST(greatest(ceil(mean / 8), 1) AS INTEGER) AS draws FROM rates),
terms AS (
  SELECT source, i, sum(exp(-mean / draws) * pow(mean / draws, i) / gamma(i + 1)) OVER (PARTITION BY source ORDER BY i) AS cdf
  FROM drawn, range(0, 48) t(i)
),
tries AS (
  SELECT d.doc_id, d.key, w.source, unnest(range(1, w.draws + 1)) AS draw FROM d JOIN drawn w ON d.source IS NOT DISTINCT FROM w.source
),
uniform AS (SELECT *, (CAST('0x' || substr(md5(key || '|' || draw), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u FROM tries),
counted AS (
  SELECT key, CAST(count(*) AS INTEGER) AS copies FROM uniform u JOIN terms t ON u.source IS NOT DISTINCT FROM t.source AND u.u > t.cdf GROUP BY key
),
copied AS (SELECT d.*, copies, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy_no FROM d JOIN counted USING (key))
SELECT doc_id, text, lang, source, n_chars, copy_no, copies, md5(key || '|' || copy_no) AS shuffle_key FROM copied"""


_WARC_BUNDLES = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS kept FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to
FROM r"""

_EXACT_DEDUP = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _url_filter(),
    "op3_ball_tree": _BALL_TREE,
    "op5_poisson_mix": _poisson_mix(),
    "op8_warc_bundles": _WARC_BUNDLES,
    "op12_exact_dedup": _EXACT_DEDUP,
}

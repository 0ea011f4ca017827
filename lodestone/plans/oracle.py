"""SQL for the roles and modes, as common table expressions that the registered oracles share."""

from __future__ import annotations

from lodestone.operators import encoder
from lodestone.operators.metrics import CUTS
from lodestone.operators.stats import MODES

WORDS = "'[a-z0-9]+'"

ITEMS = """items AS (SELECT p_partkey AS uuid, p_name AS name, p_type || ' ' || p_brand AS classification, p_type AS class, p_brand AS brand, p_size AS size FROM part),
corpus AS (SELECT * FROM items WHERE uuid % 10 <> 0),
queries0 AS (SELECT *, uuid AS query_id, CAST(uuid % length(name) AS INT) AS spot FROM items WHERE uuid % 10 = 0),
queries1 AS (SELECT *, CASE WHEN uuid % 20 = 0 THEN substr(name, 1, spot) || substr(name, spot + 2) ELSE name END AS text FROM queries0),
queries AS (SELECT *, text || ' ' || class AS enriched FROM queries1)"""

def encoded(name: str, source: str) -> str:
    """CTE {name} (text, v) of the different texts of source."""
    sums = ", ".join(f"CAST(sum(w * (2 * (({'b' if j >= 32 else 'a'} >> {j % 32}) & 1) - 1)) AS DOUBLE)" for j in range(encoder.DIMS))
    digest = f"md5('{encoder.SEED}:' || f)"
    return f"""{name}_f AS ({features(source)}), {name}_w AS (SELECT text, (CASE WHEN f LIKE 'w:%' THEN {encoder.WORD} ELSE 1 END) * CAST(round({encoder.UNIT} * ln(1 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE))) AS BIGINT) AS w,
  CAST('0x' || substr({digest}, 1, 8) AS BIGINT) AS a, CAST('0x' || substr({digest}, 9, 8) AS BIGINT) AS b FROM {name}_f LEFT JOIN vocab USING (f), n_texts),
{name}_v AS (SELECT text, [{sums}] AS v FROM {name}_w GROUP BY text), {name} AS (SELECT text, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM {name}_v)"""


def features(source: str) -> str:
    return f"""SELECT text, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(lower(text), {WORDS}), lambda w: 'w:' || w), list_transform(range(1, length(text) - 1), lambda i: 'g:' || substr(lower(text), i, 3))))) AS f FROM (SELECT DISTINCT text FROM ({source}))"""


DOCS = "docs AS (SELECT uuid, name || ' ' || classification AS text FROM corpus)"
VECTORS = f"""{DOCS}, vocab AS (SELECT f, count(*) AS df FROM ({features('SELECT text FROM docs')}) GROUP BY f), n_texts AS (SELECT count(DISTINCT text) AS n FROM docs),
{encoded('dv', 'SELECT text FROM docs')}, {encoded('qv', 'SELECT text FROM queries UNION ALL SELECT enriched FROM queries')}, cv AS (SELECT uuid, v FROM docs JOIN dv USING (text))"""

TRUTH = """groups AS (SELECT name, list(uuid ORDER BY uuid) AS acceptable FROM corpus GROUP BY name),
truth AS (SELECT query_id, CASE WHEN query_id % 70 = 0 THEN 'skipped' WHEN acceptable IS NOT NULL THEN 'match' ELSE 'no_match' END AS label, class,
  acceptable[1] AS correct_uuid, coalesce(acceptable, CAST([] AS BIGINT[])) AS acceptable FROM queries LEFT JOIN groups USING (name))"""

STATS = f"""toks AS (SELECT uuid, 1 AS is_name, unnest(regexp_extract_all(lower(name), {WORDS})) AS term FROM corpus
  UNION ALL SELECT uuid, 0, unnest(regexp_extract_all(lower(classification), {WORDS})) FROM corpus),
post AS (SELECT uuid, term, sum(is_name) AS tfn, sum(1 - is_name) AS tfc FROM toks GROUP BY uuid, term),
lens AS (SELECT uuid, len(regexp_extract_all(lower(name), {WORDS})) AS ln, len(regexp_extract_all(lower(classification), {WORDS})) AS lc FROM corpus),
avgs AS (SELECT count(*) AS n_docs, avg(ln) AS avg_name, avg(lc) AS avg_class FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def lexical(name: str, asked: str) -> str:
    """CTEs {name}_terms (explanations), {name} (scores) for rows (query_id, text) of asked."""
    return f"""{name}_qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM {asked}),
{name}_ex AS (SELECT query_id, term AS source, term, 0 AS distance FROM {name}_qt WHERE term IN (SELECT term FROM dfs)
  UNION ALL SELECT q.query_id, q.term, d.term, CAST(levenshtein(q.term, d.term) AS INT) FROM {name}_qt q, dfs d WHERE q.term NOT IN (SELECT term FROM dfs) AND levenshtein(q.term, d.term) <= 2),
{name}_tf AS (SELECT query_id, uuid, source, term, distance, 1 / CAST(1 + distance AS DOUBLE) AS weight, ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf,
  2.0::DOUBLE * tfn / (0.25::DOUBLE + 0.75::DOUBLE * ln / avg_name) + tfc / (0.25::DOUBLE + 0.75::DOUBLE * lc / avg_class) AS tf
  FROM {name}_ex JOIN dfs USING (term) JOIN post USING (term) JOIN lens USING (uuid), avgs),
{name}_terms AS (SELECT *, weight * idf * tf / (1.2::DOUBLE + tf) AS contribution FROM {name}_tf),
{name} AS (SELECT query_id, uuid, round(sum(contribution), 6) AS score FROM {name}_terms GROUP BY query_id, uuid)"""


def fuzzy(name: str, asked: str) -> str:
    """CTE {name} (query_id, uuid)."""
    return f"""{name}_w AS (SELECT DISTINCT uuid, unnest(regexp_extract_all(lower(name), {WORDS})) AS word FROM corpus),
{name}_t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS t FROM {asked}),
{name}_n AS (SELECT query_id, count(*) AS need FROM {name}_t GROUP BY query_id),
{name} AS (SELECT query_id, uuid FROM {name}_t JOIN {name}_w ON contains(word, t) OR levenshtein(word, t) <= CASE WHEN length(t) >= 8 THEN 2 WHEN length(t) >= 4 THEN 1 ELSE 0 END
  JOIN {name}_n USING (query_id) GROUP BY query_id, uuid, need HAVING count(DISTINCT t) = need)"""


def order(rows: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) AS rank FROM ({rows}))"


REGEX = "regex AS (SELECT q.query_id, c.uuid FROM queries q, corpus c WHERE regexp_matches(c.name || ' ' || c.classification, q.text, 'i'))"


def semantic(name: str, context: bool) -> str:
    return f"{name} AS (SELECT query_id, c.uuid, round(list_inner_product(qv.v, c.v), 6) AS score FROM queries q JOIN qv ON qv.text = q.{'enriched' if context else 'text'}, cv c)"


def fuse(name: str, left: str, right: str) -> str:
    """CTE {name} (query_id, uuid, left_rank, right_rank, raw, normalised, rank)."""
    return f"""{name}_b AS (SELECT query_id, uuid, l.rank AS left_rank, r.rank AS right_rank, round(coalesce(1 / (60 + l.rank)::DOUBLE, 0) + coalesce(1 / (60 + r.rank)::DOUBLE, 0), 9) AS raw
  FROM {order(left)} l FULL JOIN {order(right)} r USING (query_id, uuid)),
{name} AS (SELECT *, least(1.0::DOUBLE, round(raw / (2 / 61::DOUBLE), 6)) AS normalised, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, uuid) AS rank FROM {name}_b)"""


def rerank(name: str, first: str, keys: str = "query_id", text: str = "q.text") -> str:
    """CTE {name} ({keys}, uuid, score, rank, logit, rank_before, fallback, moved) from {first} ({keys}, uuid, score, rank)."""
    grams = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3)))"
    a, b = grams.format(text), grams.format("c.name")
    own = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return f"""{name}_h AS (SELECT {own}, f.uuid, f.score, f.rank AS rank_before, CASE WHEN f.query_id % 130 <> 0 AND f.rank <= 20 THEN
  round(4.0::DOUBLE * len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) - 2, 6) END AS logit
  FROM {first} f JOIN queries q USING (query_id) JOIN corpus c ON c.uuid = f.uuid),
{name}_f AS (SELECT *, rank_before <= 20 AND count(logit) OVER (PARTITION BY {keys}) < least(20, count(*) OVER (PARTITION BY {keys})) AS fallback FROM {name}_h),
{name} AS (SELECT *, rank_before - rank AS moved FROM (SELECT *, CASE WHEN rank_before > 20 THEN rank_before ELSE
  row_number() OVER (PARTITION BY {keys}, rank_before <= 20 ORDER BY CASE WHEN fallback THEN 0 ELSE logit END DESC, rank_before) END AS rank FROM {name}_f))"""


def modes(context: bool = False, tag: str = "") -> str:
    """CTEs up to modes{tag} (mode, query_id, uuid, score, rank)."""
    t = tag
    text = f"asked{t} AS (SELECT query_id, {'enriched' if context else 'text'} AS text FROM queries)"
    hits = lambda x: order(f"SELECT f.query_id, f.uuid, coalesce(l.score, 0) AS score FROM {x} f LEFT JOIN lex l USING (query_id, uuid)")
    pool = "SELECT l.* FROM lex l JOIN fuz0 USING (query_id, uuid)"
    parts = [text, *([] if t else [VECTORS]), fuzzy(f"fuz{t}", f"asked{t}"), semantic(f"sem{t}", context), fuse(f"hyb{t}", pool, f"SELECT * FROM sem{t}")]
    parts += [f"hybm{t} AS (SELECT query_id, uuid, normalised AS score, rank FROM hyb{t})", f"semm{t} AS {order(f'SELECT * FROM sem{t}')}", rerank(f"hybr{t}", f"hybm{t}"), rerank(f"semr{t}", f"semm{t}")]
    pick = lambda m, src: f"SELECT '{m}' AS mode, query_id, uuid, score, rank FROM {src}"
    union = [pick("fuzzy", hits(f"fuz{t}")), pick("semantic", f"semm{t}"), pick("hybrid", f"hybm{t}"), pick("hybrid+rerank", f"hybr{t}"), pick("semantic+rerank", f"semr{t}")]
    if not context:
        union.insert(0, pick("regex", hits("regex")))
    parts.append(f"modes{t} AS ({' UNION ALL '.join(union)})")
    return ",\n".join(parts)


BASE = ",\n".join([ITEMS, TRUTH, STATS, lexical("lex", "queries"), REGEX, "asked0 AS (SELECT query_id, text FROM queries)", fuzzy("fuz0", "asked0")])


def evaluated(tag: str = "", names: tuple[str, ...] = MODES) -> str:
    """CTE pq{tag} (mode, query_id, label, class, hit_rank, hit_rank_correct, ndcg)."""
    t, values = tag, ", ".join(f"('{m}')" for m in names)
    return f"""pq{t}_h AS (SELECT mode, query_id, min(rank) AS hit_rank, min(rank) FILTER (uuid = correct_uuid) AS hit_rank_correct,
  sum(CASE WHEN uuid = correct_uuid THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END / log2(rank + 1)) FILTER (rank <= 10) AS dcg
  FROM modes{t} JOIN (SELECT query_id, unnest(acceptable) AS uuid, correct_uuid FROM truth) USING (query_id, uuid) GROUP BY mode, query_id),
pq{t} AS (SELECT mode, query_id, label, class, hit_rank, hit_rank_correct, CASE WHEN len(acceptable) > 0 THEN round(coalesce(dcg, 0) /
  (3 + coalesce(list_sum(list_transform(range(1, least(len(acceptable) - 1, 9) + 1), lambda i: 1 / log2(i + 2))), 0)), 6) ELSE 0 END AS ndcg
  FROM truth CROSS JOIN (VALUES {values}) AS m(mode) LEFT JOIN pq{t}_h USING (mode, query_id))"""


FULL = ",\n".join([BASE, modes(), evaluated()])
CELLS = ", ".join(f"count(*) FILTER (label = 'match' AND hit_rank <= {k}) AS r{k}" for k in CUTS)


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"

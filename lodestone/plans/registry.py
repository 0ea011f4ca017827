"""Every registered query of the engine beside its SQL: name -> (plan, sql)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import numbers, text
from lodestone.operators import context, enrichment, lexical, metrics, placing, ranking, stats, truth
from lodestone.operators.sizes import few_broadcasts
from lodestone.plans import oracle
from lodestone.plans.oracle import BASE, CELLS, FULL, ITEMS, STATS, over
from lodestone.plans.roles import Roles, together
from lodestone.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
#: Queries whose re-ranking service is down in the registered runs, so that falling back shows.
FAILING = "query_id % 130 = 0"
REGISTRY: dict[str, tuple[Query, str]] = {}
VECTORS = """vs AS (SELECT q.vec_id AS query_id, c.vec_id AS uuid, q.label = c.label AS relevant, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) AS rank FROM vs)"""
HITS = "vh AS (SELECT query_id, min(rank) FILTER (relevant) AS hit_rank FROM vr GROUP BY query_id)"


def registered(sql: str, large: bool = False) -> Callable[[Callable[[Roles], DataFrame]], Callable[[Roles], DataFrame]]:
    """A plan and its SQL. The steps that a plan has written are removed once its result is; a large result is not written, so its steps stay until the driver ends."""

    def add(plan: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with few_broadcasts(spark):
                roles = Roles(spark, sf_dir, failing=FAILING)
                out = plan(roles)
                return roles.finished(out) if roles.steps and not large else out

        REGISTRY[plan.__name__] = (run, sql)
        return plan

    return add


# vectors alone


@registered(over(VECTORS, "SELECT query_id, uuid, score, CAST(rank AS INT) AS rank FROM vr WHERE rank <= 10"))
def semantic_topk(r: Roles) -> DataFrame:
    return ranking.ranked(ranking.score_vectors(r.vector_queries, r.vector_corpus, 10), k=10)


@registered(over(f"{VECTORS}, {HITS}", "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (hit_rank <= {k}) AS r{k}" for k in metrics.CUTS) + ", round(avg(coalesce(1 / hit_rank::DOUBLE, 0)), 6) AS mrr FROM vh"))
def recall_at_k(r: Roles) -> DataFrame:
    hits = ranking.vector_first_hits(r.vector_queries, r.vector_corpus)
    return hits.agg(F.count("*").alias("n"), *[F.count_if(F.col("hit_rank") <= k).alias(f"r{k}") for k in metrics.CUTS], F.round(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"))


@registered(over(VECTORS, "SELECT query_id, uuid, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, uuid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) AS rank FROM vs WHERE score >= 0.2) WHERE rank <= 5"))
def threshold_topk(r: Roles) -> DataFrame:
    return ranking.threshold_top(ranking.score_vectors(r.vector_queries, r.vector_corpus, 5), 0.2, 5)


@registered(over(VECTORS, """SELECT query_id, coalesce(uuid, -1) AS uuid, score, CAST(coalesce(rank, 0) AS INT) AS rank, uuid IS NULL AS placeholder
  FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 10 = 0) LEFT JOIN (SELECT query_id, uuid, score, rank FROM vr WHERE score >= 0.4 AND rank <= 5) USING (query_id)"""))
def empty_group_placeholder(r: Roles) -> DataFrame:
    top = ranking.threshold_top(ranking.score_vectors(r.vector_queries, r.vector_corpus, 5), 0.4, 5)
    return r.vector_queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("uuid", F.lit(-1)).alias("uuid"), "score", F.coalesce("rank", F.lit(0)).alias("rank"), F.col("uuid").isNull().alias("placeholder"))


@registered(over(VECTORS, "SELECT CASE WHEN score >= 0.85 THEN 'near identical' WHEN score >= 0.7 THEN 'strong' WHEN score >= 0.5 THEN 'related' WHEN score >= 0.3 THEN 'weak' ELSE 'unrelated' END AS band, count(*) AS n FROM vs GROUP BY 1"))
def cosine_bands(r: Roles) -> DataFrame:
    return ranking.score_vectors(r.vector_queries, r.vector_corpus).groupBy(numbers.cosine_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


# lexical retrieval


@registered(over(f"{ITEMS}, {STATS}", "SELECT term, df, n_docs, round(avg_name, 6) AS avg_name, round(avg_class, 6) AS avg_class FROM dfs, avgs"))
def corpus_stats(r: Roles) -> DataFrame:
    return lexical.corpus_stats(r.corpus).withColumns({"avg_name": F.round("avg_name", 6), "avg_class": F.round("avg_class", 6)})


@registered(over(BASE, f"SELECT query_id, uuid, score, CAST(rank AS INT) AS rank FROM {oracle.order('SELECT * FROM lex')} WHERE rank <= 10"))
def bm25f_topk(r: Roles) -> DataFrame:
    return r.lexical_top(10)


@registered(over(BASE, "SELECT query_id, uuid, source, term, distance, round(weight, 6) AS weight, round(idf, 6) AS idf, round(tf, 6) AS tf, round(contribution, 6) AS contribution FROM lex_terms"), large=True)
def bm25f_explain(r: Roles) -> DataFrame:
    rounded = lambda terms: terms.withColumns({c: F.round(c, 6) for c in ("weight", "idf", "tf", "contribution")})
    return lexical.every_term(r.queries, r.corpus, keep=r.cut, change=rounded).select("query_id", "uuid", "source", "term", "distance", "weight", "idf", "tf", "contribution")


@registered(over(BASE, "SELECT query_id, source, term, distance, round(1 / CAST(1 + distance AS DOUBLE), 6) AS weight FROM lex_ex"))
def typo_expansion(r: Roles) -> DataFrame:
    return lexical.typo_expansion(lexical.query_terms(r.queries), lexical.vocabulary(r.corpus)).withColumn("weight", F.round("weight", 6))


GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3)))"
GA, GB = GRAMS.format("q.text"), GRAMS.format("q.name")


@registered(over(BASE, f"SELECT query_id, CAST(len(list_intersect({GA}, {GB})) AS INT) AS shared, round(len(list_intersect({GA}, {GB})) / len(list_distinct(list_concat({GA}, {GB})))::DOUBLE, 6) AS jaccard FROM queries q"))
def trigram_overlap(r: Roles) -> DataFrame:
    return lexical.trigram_overlap(r.queries.select("query_id", "text", "name"), "text", "name").select("query_id", "shared", "jaccard")


@registered(over(BASE, "SELECT query_id, uuid FROM regex"), large=True)
def regex_search(r: Roles) -> DataFrame:
    return lexical.regex_search(r.queries, r.corpus, keep=r.cut)


@registered(over(BASE, "SELECT query_id, uuid FROM fuz0"), large=True)
def fuzzy_search(r: Roles) -> DataFrame:
    return lexical.fuzzy_search(r.queries, r.corpus, keep=r.cut)


@registered("SELECT p_partkey AS uuid, regexp_matches(p_type || ' ' || p_name, 'm.*ring$', 'i') AS by_regex FROM part WHERE contains(lower(p_type || ' ' || p_name), 'rin') AND contains(lower(p_type || ' ' || p_name), 'o')")
def token_filter(r: Roles) -> DataFrame:
    shown = r.table("part").select(F.col("p_partkey").alias("uuid"), F.concat_ws(" ", "p_type", "p_name").alias("display_name"))
    return context.filter_catalog(shown, "rin O").select("uuid", text.regex_match(F.col("display_name"), "m.*ring$").alias("by_regex"))


# modes, fusion, re-ranking


@registered(over(FULL, "SELECT query_id, uuid, raw, CAST(rank AS INT) AS rank FROM hyb WHERE rank <= 20"))
def rrf_fusion(r: Roles) -> DataFrame:
    return r.hybrid_first(20).select("query_id", "uuid", "raw", "rank")


@registered(over(FULL + ", " + oracle.fuse("symm", "SELECT * FROM lex", "SELECT * FROM sem"), "SELECT query_id, uuid, raw, CAST(rank AS INT) AS rank FROM symm WHERE rank <= 20"))
def rrf_symmetric(r: Roles) -> DataFrame:
    return r.hybrid_first(20, symmetric=True).select("query_id", "uuid", "raw", "rank")


@registered(over(FULL, """SELECT query_id, uuid, coalesce(CAST(left_rank AS VARCHAR), '(absent)') AS lexical_rank, coalesce(CAST(right_rank AS VARCHAR), '(absent)') AS dense_rank,
  round(coalesce(1 / (60 + left_rank)::DOUBLE, 0), 9) AS lexical_part, round(coalesce(1 / (60 + right_rank)::DOUBLE, 0), 9) AS dense_part FROM hyb WHERE rank <= 10"""))
def rrf_explain(r: Roles) -> DataFrame:
    part = lambda c: F.round(F.coalesce(1.0 / (ranking.RRF_K + F.col(c)), F.lit(0.0)), 9)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(absent)"))
    return r.hybrid_first(10).select("query_id", "uuid", shown("left_rank").alias("lexical_rank"), shown("right_rank").alias("dense_rank"), part("left_rank").alias("lexical_part"), part("right_rank").alias("dense_part"))


@registered(over(FULL, "SELECT query_id, max(normalised) AS best, count(*) AS n, min(normalised) AS least FROM hyb GROUP BY query_id"))
def rrf_normalised(r: Roles) -> DataFrame:
    """A form's last row stands behind its others in both relations, so the worst row is one of these."""
    best = r.fused_first(1).where("rank = 1").select("query_id", F.col("normalised").alias("best"))
    worst = placing.fused_last(r.left(), r.levels("semantic"), r.parameters.fusion, r.cut)
    done = best.join(worst, "query_id").join(r.sizes("hybrid"), "query_id").select("query_id", "best", F.col("rows").alias("n"), "least")
    return r.to_queries(r.cut(done), by="pair")


@registered(over(BASE, "SELECT query_id, uuid, round(least(0.97::DOUBLE, 1 / (1 + exp(-(0.6::DOUBLE * score - 1.5)))), 6) AS confidence FROM lex"), large=True)
def calibrated_score(r: Roles) -> DataFrame:
    calibrated = lambda scores: scores.select("bag", "form", ranking.calibrated(F.col("score"), "bm25f", r.parameters.curves).alias("confidence"))
    return lexical.every_score(r.queries, r.corpus, r.parameters.bm25, r.cut, calibrated)


@registered(over(FULL, "SELECT query_id, uuid, CAST(rank_before AS INT) AS rank_before, CAST(rank AS INT) AS rank, logit, CAST(moved AS INT) AS moved FROM semr WHERE rank <= 25"))
def rerank_head(r: Roles) -> DataFrame:
    """The first 25 rows; the heads of queries whose logits fail stay in their order, without logits."""
    done = r.reranked(r.first("semantic", deep="top").where("rank <= 25"))
    return r.to_queries(done.select("query_id", "uuid", "rank_before", "rank", "logit", "moved"))


@registered(over(FULL, "SELECT query_id, bool_or(fallback) AS fallback, count(*) FILTER (moved <> 0) AS moved FROM hybr GROUP BY query_id"))
def rerank_fallback(r: Roles) -> DataFrame:
    out = r.reranked(r.first("hybrid", deep="top"))
    return r.to_queries(out.groupBy("query_id").agg(F.bool_or("fallback").alias("fallback"), F.count_if(F.col("moved") != 0).alias("moved")))


@registered(over(FULL, "SELECT count(*) AS failures, min(query_id) AS first_query, 'no logits for query ' || min(query_id) AS first_error FROM (SELECT query_id FROM semr GROUP BY query_id HAVING bool_or(fallback))"))
def first_error(r: Roles) -> DataFrame:
    failed = r.to_queries(r.reranked(r.first("semantic", deep="top")).where("fallback").select("query_id").distinct())
    error = F.min_by(F.concat(F.lit("no logits for query "), F.col("query_id")), "query_id")
    return failed.agg(F.count("*").alias("failures"), F.min("query_id").alias("first_query"), error.alias("first_error"))


@registered(over(FULL, """SELECT mode, query_id, uuid, CASE WHEN length(name) > 8 THEN substr(name, 1, 8) || '...' ELSE name END AS title, CAST(greatest(0, least(100, round(score * 100))) AS INT) || '%' AS shown,
  CASE WHEN uuid = correct_uuid THEN '**' WHEN list_contains(acceptable, uuid) THEN '*' ELSE '' END AS mark, CAST(rank AS INT) AS rank
  FROM modes JOIN corpus USING (uuid) JOIN truth USING (query_id) WHERE rank <= 5 AND mode IN ('semantic', 'hybrid')"""))
def candidate_cards(r: Roles) -> DataFrame:
    rows = r.graded(r.first_modes(("semantic", "hybrid"), k=5), only_hits=False).join(r.corpus.select("uuid", "name"), "uuid")
    shown = F.concat(numbers.percent(F.col("score")).cast("string"), F.lit("%"))
    mark = metrics.hit_mark(F.col("grade") == 2, F.col("grade") == 1)
    return rows.select("mode", "query_id", "uuid", text.truncated(F.col("name"), 8, "...").alias("title"), shown.alias("shown"), mark.alias("mark"), "rank")


@registered(over(FULL, """SELECT CASE WHEN p IS NULL THEN 'none' WHEN p < 15 THEN 'very low' WHEN p < 30 THEN 'low' WHEN p < 45 THEN 'medium' WHEN p < 70 THEN 'high' ELSE 'very high' END AS tier, count(*) AS n
  FROM (SELECT score * 100 AS p FROM modes WHERE mode = 'hybrid') GROUP BY 1"""))
def value_tiers(r: Roles) -> DataFrame:
    """Rows that may reach the second tier are fused; all others are counted as of the lowest."""
    fusion = r.parameters.fusion
    asked = r.cases().groupBy(F.col("pair").alias("query_id")).agg(F.count("*").alias("times"))
    high = r.cut(r.fused_first(0, least=0.1499 * (fusion.w_bm25 + fusion.w_sem) / (fusion.k + 1)).join(asked, "query_id").groupBy("query_id", numbers.tier(F.col("normalised") * 100).alias("tier")).agg(F.count("*").alias("rows"), F.sum("times").alias("n")))
    rest = r.sizes("hybrid").join(asked, "query_id").join(high.groupBy("query_id").agg(F.sum("rows").alias("seen")), "query_id", "left")
    rest = rest.select(numbers.tier(F.lit(0.0)).alias("tier"), (F.col("times") * (F.col("rows") - F.coalesce("seen", F.lit(0)))).alias("n"))
    return high.select("tier", "n").unionByName(rest.where("n > 0")).groupBy("tier").agg(F.sum("n").alias("n"))


@registered(over(FULL, "SELECT mode, query_id, arg_min(uuid, rank) AS best_uuid, arg_min(score, rank) AS best_score FROM modes GROUP BY mode, query_id"))
def best_candidate(r: Roles) -> DataFrame:
    return r.first_modes(k=1).select("mode", "query_id", F.col("uuid").alias("best_uuid"), F.col("score").alias("best_score"))


# evaluation


@registered(over(FULL, f"SELECT mode, count(*) AS n_scope, count(*) FILTER (label = 'match') AS denom, {CELLS.replace('hit_rank', 'hit_rank_correct')}, count(*) FILTER (label = 'match' AND hit_rank_correct IS NOT NULL) AS rall FROM pq GROUP BY mode"))
def recall_exact(r: Roles) -> DataFrame:
    return metrics.recall(r.evaluated(), "hit_rank_correct")


@registered(over(FULL, f"SELECT mode, count(*) AS n_scope, count(*) FILTER (label = 'match') AS denom, {CELLS}, count(*) FILTER (label = 'match' AND hit_rank IS NOT NULL) AS rall FROM pq GROUP BY mode"))
def recall_modes(r: Roles) -> DataFrame:
    return metrics.recall(r.evaluated(correct=False))


MRR = "SELECT mode, round(avg(coalesce(1 / hit_rank::DOUBLE, 0)), 6) AS mrr, round(avg(coalesce(1 / hit_rank_correct::DOUBLE, 0)), 6) AS mrr_correct FROM pq WHERE label = 'match' GROUP BY mode"


@registered(over(FULL, MRR))
def mrr(r: Roles) -> DataFrame:
    return metrics.mean_reciprocal_rank(r.evaluated())


@registered(over(FULL, "SELECT mode, round(avg(ndcg), 6) AS ndcg10 FROM pq WHERE label = 'match' GROUP BY mode"))
def ndcg10(r: Roles) -> DataFrame:
    return metrics.matched(r.evaluated(correct=False)).groupBy("mode").agg(F.round(F.avg("ndcg"), 6).alias("ndcg10"))


def _cells(column: str) -> str:
    return f"{CELLS.replace('hit_rank', column)}, count(*) FILTER (label = 'match' AND {column} IS NOT NULL) AS rall"


@registered(over(FULL + f", w0 AS (SELECT mode, 'acceptable' AS kind, count(*) FILTER (label = 'match') AS denom, {_cells('hit_rank')} FROM pq GROUP BY mode UNION ALL SELECT mode, 'exact', count(*) FILTER (label = 'match'), {_cells('hit_rank_correct')} FROM pq GROUP BY mode), w1 AS (UNPIVOT w0 ON r1, r3, r5, r10, r20, rall INTO NAME cell VALUE hits), w2 AS (SELECT mode, kind, cell, hits, denom, hits / denom::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM w1)", """SELECT mode, kind, cell, hits, denom, round(p, 6) AS share,
  round(greatest(0, (p + z*z/(2*denom) - z*sqrt(p*(1-p)/denom + z*z/(4.0::DOUBLE*denom*denom))) / (1 + z*z/denom)), 6) AS low, round(least(1, (p + z*z/(2*denom) + z*sqrt(p*(1-p)/denom + z*z/(4.0::DOUBLE*denom*denom))) / (1 + z*z/denom)), 6) AS high FROM w2"""))
def wilson_recall(r: Roles) -> DataFrame:
    return metrics.wilson_recall(r.evaluated())


@registered(over(FULL, """SELECT mode, bin, place, count(*) FILTER (label = 'match' AND bin = CASE WHEN hit_rank IS NULL THEN 'miss' WHEN hit_rank = 1 THEN '1' WHEN hit_rank <= 3 THEN '2-3' WHEN hit_rank <= 5 THEN '4-5' WHEN hit_rank <= 10 THEN '6-10' ELSE '>10' END) AS n
  FROM pq, (VALUES ('1', 0), ('2-3', 1), ('4-5', 2), ('6-10', 3), ('>10', 4), ('miss', 5)) AS b(bin, place) GROUP BY mode, bin, place"""))
def rank_bins(r: Roles) -> DataFrame:
    return metrics.rank_bins(r.evaluated(correct=False))


@registered(over(FULL, """SELECT *, CAST(row_number() OVER (PARTITION BY mode ORDER BY n DESC, class) AS INT) AS place FROM (SELECT mode, coalesce(nullif(trim(class), ''), '(unknown)') AS class, count(*) AS n,
  count(*) FILTER (hit_rank <= 1) AS r1, count(*) FILTER (hit_rank <= 10) AS r10, count(hit_rank) AS rall FROM pq WHERE label = 'match' GROUP BY 1, 2)"""))
def class_breakdown(r: Roles) -> DataFrame:
    return metrics.class_breakdown(r.evaluated(correct=False))


PART = "CASE WHEN label <> 'match' THEN 'skipped' WHEN hit_rank <= 5 THEN 'hit' ELSE 'miss' END"


@registered(over(FULL, f"SELECT mode, query_id, CAST(hit_rank AS INT) AS hit_rank, part, CAST(row_number() OVER (PARTITION BY mode, part ORDER BY CASE WHEN part = 'hit' THEN hit_rank ELSE 0 END, query_id) AS INT) AS place FROM (SELECT *, {PART} AS part FROM pq)"))
def hits_misses(r: Roles) -> DataFrame:
    return metrics.hits_misses(r.evaluated(correct=False))


@registered(over(FULL, """SELECT mode, query_id, CASE WHEN label IS NULL THEN 'not in truth' WHEN label <> 'match' THEN 'skipped: ' || label WHEN hit_rank IS NULL THEN 'miss' WHEN hit_rank <= 5 THEN 'hit at ' || hit_rank ELSE 'hit beyond 5' END AS status FROM pq"""))
def hit_status(r: Roles) -> DataFrame:
    return r.evaluated(correct=False).select("mode", "query_id", metrics.hit_status(F.col("label"), F.col("hit_rank"), 5).alias("status"))


@registered(over(FULL, "SELECT query_id, uuid, CASE WHEN uuid = correct_uuid THEN '**' WHEN list_contains(acceptable, uuid) THEN '*' ELSE '' END AS mark FROM modes JOIN truth USING (query_id) WHERE mode = 'fuzzy' AND rank <= 20"))
def hit_marker(r: Roles) -> DataFrame:
    rows = r.graded(r.first_modes(("fuzzy",), k=20), only_hits=False)
    return rows.select("query_id", "uuid", metrics.hit_mark(F.col("grade") == 2, F.col("grade") == 1).alias("mark"))


@registered(over(FULL, "SELECT mode, query_id, acceptable[1] AS expected FROM pq JOIN (SELECT query_id, acceptable FROM truth) USING (query_id) WHERE label = 'match' AND (hit_rank IS NULL OR hit_rank > 5)"))
def expected_answer(r: Roles) -> DataFrame:
    missed = r.evaluated(correct=False).where("label = 'match' and (hit_rank is null or hit_rank > 5)")
    return missed.join(r.truth.select("query_id", "correct_uuid"), "query_id").select("mode", "query_id", F.col("correct_uuid").alias("expected"))


@registered(over(FULL + f", s AS ({MRR})", "SELECT mode, mrr, place, round(mrr - lag(mrr) OVER (ORDER BY place), 6) AS delta FROM (SELECT mode, mrr, CAST(list_position(['regex', 'fuzzy', 'semantic', 'hybrid', 'hybrid+rerank', 'semantic+rerank'], mode) AS INT) AS place FROM s)"))
def mode_delta(r: Roles) -> DataFrame:
    return stats.mode_delta(metrics.mean_reciprocal_rank(r.evaluated(correct=False), ("hit_rank",)), "mrr")


def p_value(b: str, c: str) -> str:
    n = f"({b} + {c})"
    return f"CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0::DOUBLE))))), 6) END"


HIT1 = "h1 AS (SELECT mode, query_id, coalesce(hit_rank <= 1, false) AS hit FROM pq WHERE label = 'match')"


@registered(over(f"{FULL}, {HIT1}, mc AS (SELECT a.mode AS mode_a, z.mode AS mode_b, count(*) FILTER (a.hit AND NOT z.hit) AS b, count(*) FILTER (z.hit AND NOT a.hit) AS c FROM h1 a JOIN h1 z USING (query_id) WHERE a.mode < z.mode GROUP BY 1, 2)", f"SELECT *, p < 0.05 AS significant, CASE WHEN p < 0.001 THEN '<.001' ELSE printf('%.3f', round_even(p, 3)) END AS shown FROM (SELECT *, {p_value('b', 'c')} AS p FROM mc)"))
def mcnemar_matrix(r: Roles) -> DataFrame:
    return stats.mcnemar_matrix(r.evaluated(correct=False), 1)


DRAW = "CAST('0x' || substr(md5('42:' || i || ':' || j), 1, 12) AS BIGINT) % n"


@registered(over(f"""{FULL}, bx AS (SELECT mode, query_id, coalesce(1 / hit_rank::DOUBLE, 0) AS mrr, coalesce(1 / hit_rank_correct::DOUBLE, 0) AS mrr_correct, ndcg AS ndcg10, row_number() OVER (PARTITION BY mode ORDER BY query_id) - 1 AS place FROM pq WHERE label = 'match'),
bn AS (UNPIVOT bx ON mrr, mrr_correct, ndcg10 INTO NAME measure VALUE x),
bs AS (SELECT mode, measure, count(*) AS n, avg(x) AS point FROM bn GROUP BY mode, measure), bd AS (SELECT n, i, {DRAW} AS place FROM (SELECT n, i, unnest(range(1, n + 1)) AS j FROM (SELECT n, unnest(range(1, 1001)) AS i FROM (SELECT DISTINCT n FROM bs)))),
bm AS (SELECT mode, measure, i, avg(x) AS m FROM bs JOIN bd USING (n) JOIN bn USING (mode, measure, place) GROUP BY mode, measure, i)""", "SELECT mode, measure, round(any_value(point), 6) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM bm JOIN bs USING (mode, measure) GROUP BY mode, measure"))
def bootstrap_quality(r: Roles) -> DataFrame:
    return stats.ranking_intervals(metrics.matched(r.evaluated()))


@registered(over(FULL, """SELECT mode, scored, r10, mrr FROM (SELECT mode, count(*) AS scored FROM modes GROUP BY mode) JOIN (SELECT mode, count(*) FILTER (label = 'match' AND hit_rank <= 10) AS r10,
  round(avg(coalesce(1 / hit_rank::DOUBLE, 0)) FILTER (label = 'match'), 6) AS mrr FROM pq GROUP BY mode) USING (mode)"""))
def latency_quality(r: Roles) -> DataFrame:
    """Rows scored stand for seconds, which no oracle could repeat."""
    done, asked = r.evaluated(correct=False), r.cases().groupBy(F.col("pair").alias("query_id")).agg(F.count("*").alias("times"))
    scored = [r.sizes(m).join(asked, "query_id").agg(F.sum(F.col("rows") * F.col("times")).alias("scored")).where("scored > 0").withColumn("mode", F.lit(m)) for m in stats.MODES]
    quality = metrics.recall(done).select("mode", "r10").join(metrics.mean_reciprocal_rank(done, ("hit_rank",)), "mode")
    return reduce(DataFrame.unionByName, scored).join(quality, "mode")


DUAL = ("fuzzy", "semantic", "hybrid", "hybrid+rerank", "semantic+rerank")


@registered(over(f"{FULL}, {oracle.modes(True, 'x')}, {oracle.evaluated('x', DUAL)}, dp AS (SELECT mode, count(*) AS n, avg(coalesce(1 / a.hit_rank::DOUBLE, 0)) AS before, avg(coalesce(1 / z.hit_rank::DOUBLE, 0)) AS after, count(*) FILTER (coalesce(z.hit_rank <= 1, false) AND NOT coalesce(a.hit_rank <= 1, false)) AS gained, count(*) FILTER (coalesce(a.hit_rank <= 1, false) AND NOT coalesce(z.hit_rank <= 1, false)) AS lost FROM pq a JOIN pqx z USING (mode, query_id) WHERE a.label = 'match' GROUP BY mode)",
  f"SELECT mode, n, round(before, 6) AS mrr_name_only, round(after, 6) AS mrr_context, gained, lost, {p_value('lost', 'gained')} AS p, CASE WHEN round(after, 6) - round(before, 6) > 0.002 THEN 'lifted' WHEN abs(round(after, 6) - round(before, 6)) <= 0.002 THEN 'flat' ELSE 'lowered' END AS verb FROM dp"))
def context_dual_pass(r: Roles) -> DataFrame:
    rank = lambda df, c: metrics.matched(df).select("mode", "query_id", F.col("hit_rank").alias(c))
    before, after = together(lambda: r.evaluated(DUAL, correct=False), lambda: r.evaluated(DUAL, context=True, correct=False))
    both = rank(before, "a").join(rank(after, "z"), ["mode", "query_id"])
    top = lambda c: F.coalesce(F.col(c) <= 1, F.lit(False))
    mean = lambda c: F.round(F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0))), 6)
    out = both.groupBy("mode").agg(F.count("*").alias("n"), mean("a").alias("mrr_name_only"), mean("z").alias("mrr_context"), F.count_if(top("z") & ~top("a")).alias("gained"), F.count_if(top("a") & ~top("z")).alias("lost"))
    return out.withColumn("p", stats.mcnemar(F.col("lost"), F.col("gained"))).withColumn("verb", stats.moved(F.col("mrr_context") - F.col("mrr_name_only")))


# ladder

FIELD_SQL = [
    ("name", None), ("class", "class"), ("description", "brand"), ("concrete_grade", "'C' || size"),
    ("structural_class", "CASE WHEN class IN ('LARGE', 'PROMO') THEN 'Concrete' WHEN class = 'SMALL' THEN 'Metal' ELSE 'Generic' END"),
    ("host_categories", "CASE size % 3 WHEN 0 THEN 'Walls' WHEN 1 THEN 'Floors' ELSE 'Roofs, Walls' END"),
    ("density", "(size * 100)"), ("thermal_conductivity", "'0.' || size"), ("host_types", "'Type ' || (query_id % 7)"),
]


def _asked() -> str:
    """Every query's text at each step: the chosen fields in the order in which a text holds them, not that of the ladder."""
    rows = []
    for i, (label, _) in enumerate(FIELD_SQL):
        held = {f: x for f, x in FIELD_SQL[1 : i + 1]}
        rows.append(f"SELECT query_id, {i} AS step, '{label}' AS label, " + " || ' ' || ".join(["trim(text)", *[f"({held[f]})" for f in enrichment.FIELDS if f in held]]) + " AS text FROM queries")
    return "asked AS (" + " UNION ALL ".join(rows) + ")"


LADDER = f"""{BASE}, {oracle.VECTORS}, {_asked()}, once AS (SELECT DISTINCT text AS query_id, text FROM asked), {oracle.lexical('ll', 'once')}, {oracle.fuzzy('lf', 'once')},
{oracle.encoded('le', 'SELECT text FROM asked')}, lds AS (SELECT le.text, cv.uuid, round(list_inner_product(le.v, cv.v), 6) AS score FROM le, cv),
{oracle.fuse('lh', 'SELECT a.query_id * 100 + a.step AS query_id, lex.uuid, lex.score FROM asked a JOIN lex USING (query_id)', 'SELECT a.query_id * 100 + a.step AS query_id, lds.uuid, lds.score FROM asked a JOIN lds USING (text)')},
lhs AS (SELECT a.query_id, a.step, a.text, lh.uuid, lh.rank, 0 AS score FROM asked a JOIN lh ON lh.query_id = a.query_id * 100 + a.step),
{oracle.rerank('lrr', '(SELECT * FROM lhs WHERE rank <= 20)', 'query_id, step', 'f.text')},
lrk AS (SELECT 'fuzzy' AS mode, a.step, a.query_id, f.uuid, f.rank FROM asked a JOIN {oracle.order('SELECT ll.* FROM ll JOIN lf USING (query_id, uuid)')} f ON f.query_id = a.text
  UNION ALL SELECT 'semantic', a.step, a.query_id, s.uuid, s.rank FROM asked a JOIN {oracle.order('SELECT text AS query_id, uuid, score FROM lds')} s ON s.query_id = a.text
  UNION ALL SELECT 'hybrid', step, query_id, uuid, rank FROM lhs UNION ALL SELECT 'reranker', step, query_id, uuid, rank FROM lhs WHERE rank > 20 UNION ALL SELECT 'reranker', step, query_id, uuid, rank FROM lrr),
lt AS (SELECT query_id, acceptable, correct_uuid, len(acceptable) AS n FROM truth WHERE label = 'match'), lm AS (SELECT query_id, correct_uuid, unnest(acceptable) AS uuid FROM lt),
lb AS (SELECT k.mode, k.step, k.query_id, min(k.rank) AS hit, sum(CASE WHEN k.uuid = lm.correct_uuid THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END / log2(k.rank + 1)) FILTER (k.rank <= 10) AS dcg FROM lrk k JOIN lm USING (query_id, uuid) GROUP BY ALL),
lq AS (SELECT m.mode, a.step, a.label, hit, round(coalesce(dcg, 0) / (3 + coalesce(list_sum(list_transform(range(1, least(n - 1, 9) + 1), lambda i: 1 / log2(i + 2))), 0)), 6) AS ndcg
  FROM asked a JOIN lt USING (query_id) CROSS JOIN (VALUES ('fuzzy'), ('semantic'), ('hybrid'), ('reranker')) AS m(mode) LEFT JOIN lb ON lb.query_id = a.query_id AND lb.step = a.step AND lb.mode = m.mode),
ladder AS (SELECT mode, step, label, round(avg(coalesce(1 / hit::DOUBLE, 0)), 6) AS mrr, round(avg(coalesce(hit <= 1, false)::INT), 6) AS r1, round(avg(coalesce(hit <= 5, false)::INT), 6) AS r5, round(avg(coalesce(hit <= 10, false)::INT), 6) AS r10, round(avg(ndcg), 4) AS ndcg FROM lq GROUP BY mode, step, label)"""


@registered(over(LADDER, "SELECT mode, step, label, mrr, r1, r5, r10, ndcg, round(mrr - first_value(mrr) OVER (PARTITION BY mode ORDER BY step), 6) AS delta, round(mrr - lag(mrr) OVER (PARTITION BY mode ORDER BY step), 6) AS marginal FROM ladder"))
def field_ladder(r: Roles) -> DataFrame:
    return stats.ladder_steps(r.ladder()).drop("best")


@registered(over(LADDER, "SELECT mode, step, label, mrr FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY mrr DESC, step) AS n FROM ladder) WHERE n = 1"))
def ladder_best(r: Roles) -> DataFrame:
    return stats.ladder_steps(r.ladder()).where("best").select("mode", "step", "label", "mrr")


@registered(over(LADDER + ", lg AS (SELECT *, round(mrr - lag(mrr) OVER (PARTITION BY mode ORDER BY step), 6) AS marginal FROM ladder WHERE mode <> 'fuzzy'), lv AS (SELECT step, label, round(avg(marginal), 6) AS mean_delta, count(*) FILTER (marginal > 0) AS positives FROM lg WHERE marginal IS NOT NULL GROUP BY step, label)",
  "SELECT *, CASE WHEN label IN ('density', 'thermal_conductivity', 'host_types') THEN 'noise' WHEN mean_delta <= -0.015 THEN CASE WHEN label = 'categories' THEN 'hurts: too broad' ELSE 'hurts' END WHEN mean_delta >= 0.015 AND positives >= 2 THEN 'helps' ELSE 'neutral' END AS verdict FROM lv"))
def step_verdict(r: Roles) -> DataFrame:
    return stats.step_verdicts(r.ladder(), noise=enrichment.NOISE)


@registered(over(f"{ITEMS}, {_asked()}", "SELECT step, count(DISTINCT text) AS n_distinct, count(*) AS n FROM asked GROUP BY step"))
def distinct_enriched(r: Roles) -> DataFrame:
    return r.ladder_texts().groupBy("step").agg(F.count_distinct("text").alias("n_distinct"), F.count("*").alias("n"))


# truth

SCOPE = """scope AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_name) || ' ' WHEN 1 THEN p_name || ' panel' WHEN 2 THEN string_split(p_name, ' ')[2] ELSE 'zz ' || (p_partkey % 7) END AS name FROM part),
ent AS (SELECT p_name AS name, min(p_partkey) AS ordinal FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name), entries AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN 'skipped' ELSE 'match' END AS label, lower(trim(name)) AS key FROM ent),
ex AS (SELECT s.name, lower(trim(s.name)) AS key, e.ordinal, e.label FROM scope s LEFT JOIN entries e ON e.key = lower(trim(s.name))),
nr AS (SELECT x.key, min(e.ordinal) AS o, arg_min(e.label, e.ordinal) AS l FROM ex x JOIN entries e ON contains(x.key, e.key) OR contains(e.key, x.key) WHERE x.ordinal IS NULL AND x.key <> '' GROUP BY x.key)"""


def _scope(r: Roles) -> tuple[DataFrame, DataFrame]:
    part, key = r.table("part"), F.col("p_partkey") % 4
    name = F.when(key == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).when(key == 1, F.concat("p_name", F.lit(" panel"))).when(key == 2, F.split("p_name", " ")[1]).otherwise(F.concat(F.lit("zz "), (F.col("p_partkey") % 7).cast("string")))
    entries = part.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ordinal")).withColumn("label", F.when(F.col("ordinal") % 3 == 0, "skipped").otherwise("match"))
    return part.select(name.alias("name")).distinct(), entries


@registered(over(SCOPE, "SELECT ex.name, coalesce(ex.ordinal, nr.o) AS ordinal, coalesce(ex.label, nr.l) AS label, CASE WHEN ex.ordinal IS NOT NULL THEN 'exact' WHEN nr.o IS NOT NULL THEN 'substring' ELSE 'none' END AS how FROM ex LEFT JOIN nr ON nr.key = ex.key AND ex.ordinal IS NULL"))
def scope_truth_join(r: Roles) -> DataFrame:
    return truth.scope_truth_join(*_scope(r), keep=r.cut)


@registered("SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def truth_substring_join(r: Roles) -> DataFrame:
    items = r.table("benchmark").select("item_id", F.col("text").alias("passage"))
    return truth.containment_join(r.table("documents").select("doc_id", "text"), items)


@registered(over(ITEMS, """SELECT name, CAST(count(DISTINCT uuid) AS BIGINT) AS n, bool_or(uuid = correct) AS holds FROM (SELECT name, uuid, min(uuid) OVER (PARTITION BY name) AS correct FROM corpus WHERE name IN (SELECT name FROM queries)) GROUP BY name"""))
def acceptable_union(r: Roles) -> DataFrame:
    """The entries' acceptable rows, without the correct ones, united with these."""
    named = r.corpus.join(r.queries.select("name").distinct(), "name", "left_semi")
    correct = r.groups.select("name", F.col("correct_uuid").alias("uuid")).join(r.queries.select("name").distinct(), "name", "left_semi")
    marks = named.select("name", "uuid").join(correct, ["name", "uuid"], "left_anti")
    united = truth.acceptable_rows(marks, correct, "name").join(correct.withColumnRenamed("uuid", "correct"), "name")
    return united.groupBy("name").agg(F.count("*").alias("n"), F.bool_or(F.col("uuid") == F.col("correct")).alias("holds"))


# context


def _hosts(r: Roles) -> tuple[DataFrame, DataFrame]:
    lines = r.table("lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_partkey").alias("material_id"))
    elements = r.table("orders").select(F.col("o_orderkey").alias("element_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("type_name"))
    return lines, elements


@registered("""SELECT l_partkey AS material_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS categories, coalesce(string_agg(DISTINCT nullif(s, ''), ',' ORDER BY nullif(s, '')), '') AS types
  FROM lineitem JOIN (SELECT *, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS s FROM orders) ON o_orderkey = l_orderkey WHERE l_partkey > 0 GROUP BY 1""")
def host_map(r: Roles) -> DataFrame:
    lines, elements = _hosts(r)
    return context.host_map(context.edges(lines), elements).select("material_id", F.array_join("categories", ",").alias("categories"), F.array_join("types", ",").alias("types"))


@registered("SELECT DISTINCT l_orderkey AS element_id, m AS material_id FROM (SELECT l_orderkey, unnest([l_partkey, CASE WHEN l_linenumber = 1 THEN l_suppkey END, CASE WHEN l_returnflag = 'R' THEN -1 END]) AS m FROM lineitem) WHERE m > 0")
def edge_union(r: Roles) -> DataFrame:
    lines = r.table("lineitem")
    edge = lambda c: lines.select(F.col("l_orderkey").alias("element_id"), c.cast("long").alias("material_id"))
    return context.edges(edge(F.col("l_partkey")), edge(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))), edge(F.when(F.col("l_returnflag") == "R", F.lit(-1))))


def _materials(r: Roles) -> DataFrame:
    structural = F.when(F.col("p_type").isin("LARGE", "PROMO"), "Concrete").when(F.col("p_type") == "SMALL", "Metal").otherwise("Generic")
    value = F.col("p_retailprice")
    part = r.table("part").withColumn("s", structural)
    physical = F.struct(
        F.when(F.col("p_size") > 5, context.numeric("density_kg_m3", value)).alias("density_kg_m3"), F.when(F.col("p_size") > 5, F.col("s")).alias("structural_class"),
        context.conditional("concrete_compression_mpa", F.when(F.col("p_size") > 5, F.col("p_size").cast("double")), F.col("s")).alias("concrete_compression_mpa"),
        context.conditional("poissons_ratio", F.when(F.col("p_size") > 5, (F.col("p_size") % 3).cast("double")), F.col("s")).alias("poissons_ratio"),
        numbers.clean_number(value / F.lit(1e9)).alias("thermal_expansion_inv_C"),
    )
    return part.select(F.col("p_partkey").alias("revit_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type")).alias("class"), F.col("p_brand").alias("manufacturer"), physical.alias("physical"), "s")


MATERIAL = """m AS (SELECT *, CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 'Concrete' WHEN p_type = 'SMALL' THEN 'Metal' ELSE 'Generic' END AS s FROM part)"""


@registered(over(MATERIAL, """SELECT p_partkey AS revit_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS class, p_name AS name, CASE WHEN p_size > 5 THEN CAST(round(p_retailprice, 2) AS DOUBLE) END AS density, CASE WHEN p_size > 5 THEN s END AS structural, p_size > 5 AS has_asset FROM m"""))
def property_projection(r: Roles) -> DataFrame:
    done = context.project(_materials(r), ["identity.class", "physical.density_kg_m3", "physical.structural_class"])
    at = lambda path: F.get_json_object("record", f"$.{path}")
    return done.select("revit_id", at("class").alias("class"), at("name").alias("name"), at("physical_asset.density_kg_m3").cast("double").alias("density"), at("physical_asset.structural_class").alias("structural"), at("physical_asset").isNotNull().alias("has_asset"))


@registered(over(MATERIAL, """SELECT p_partkey AS revit_id, CASE WHEN s = 'Concrete' AND p_size > 5 THEN p_size::DOUBLE END AS compression, CASE WHEN p_size > 5 THEN nullif((p_size % 3)::DOUBLE, 0) END AS poisson,
  CAST(printf('%.3e', p_retailprice / 1e9) AS DOUBLE) AS expansion FROM m"""))
def conditional_properties(r: Roles) -> DataFrame:
    p = F.col("physical")
    return _materials(r).select("revit_id", p["concrete_compression_mpa"].alias("compression"), p["poissons_ratio"].alias("poisson"), p["thermal_expansion_inv_C"].alias("expansion"))


@registered("""SELECT o.o_orderkey AS element_id, coalesce(nullif(CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE n.n_name END, ''), nullif(CASE WHEN o.o_orderkey % 6 = 0 THEN '' ELSE c.c_mktsegment END, ''), r.r_name, '') AS type_name
  FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey LEFT JOIN region r ON r_regionkey = n_regionkey""")
def lookup_chain(r: Roles) -> DataFrame:
    orders = r.table("orders").join(r.table("customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(r.table("nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(F.broadcast(r.table("region")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    names = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("n_name")), F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.col("c_mktsegment")), F.col("r_name")
    return orders.select(F.col("o_orderkey").alias("element_id"), text.first_filled(*names).alias("type_name"))


@registered("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY 1, 2")
def nested_properties(r: Roles) -> DataFrame:
    return r.table("events").select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@registered("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, replace(replace(replace(text, '|', '\\|'), chr(13), ' '), chr(10), ' ') AS cell FROM documents")
def report_escapes(r: Roles) -> DataFrame:
    whole = F.col("text")
    return r.table("documents").select("doc_id", text.html_escaped(whole).alias("html"), text.markdown_cell(whole).alias("cell"))


@registered("SELECT count(*) AS total, count(*) FILTER (p_size > 25) AS selected, p_type AS category FROM part GROUP BY p_type")
def property_counts(r: Roles) -> DataFrame:
    return r.table("part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 25).alias("selected"))


@registered("SELECT p_name AS name, min(p_partkey) AS material_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY p_name")
def material_scope(r: Roles) -> DataFrame:
    from lodestone.sources.readers import material_scope as scope

    materials = r.table("part").select(F.col("p_partkey").alias("material_id"), F.col("p_name").alias("name"))
    return scope(materials, _hosts(r)[0])


# enrichment and texts


@registered(over(BASE, "SELECT query_id, text || ' ' || class || CASE WHEN size % 3 = 0 THEN '' ELSE ' ' || brand END || ' ' || size AS enriched FROM queries"))
def enriched_query(r: Roles) -> DataFrame:
    columns = {"class": F.col("class"), "description": F.when(F.col("size") % 3 == 0, "").otherwise(F.col("brand")), "density": F.col("size")}
    return r.queries.select("query_id", enrichment.enriched_query(F.col("text"), ["density", "description", "class"], columns).alias("enriched"))


@registered("SELECT p_partkey AS ordinal, p_name AS name, p_name || ' ' || p_type AS preview, true AS added, true AS stale FROM part WHERE p_partkey % 3 = 1 ORDER BY p_partkey LIMIT 1")
def preview_entry(r: Roles) -> DataFrame:
    entries = r.table("part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"), "p_type", F.when(F.col("p_partkey") % 3 == 1, "match").otherwise("skipped").alias("label"))
    return enrichment.preview(entries, ["class"], {"class": F.col("p_type")}, applied=["class", "density"])


@registered("SELECT p_partkey AS uuid, lower(p_name || ' ' || CASE p_type WHEN 'PROMO' THEN 'Werbung' WHEN 'SMALL' THEN 'Klein' ELSE p_type END || ' / ' || p_brand) AS search FROM part")
def search_texts(r: Roles) -> DataFrame:
    path = F.concat_ws(" / ", "p_type", "p_brand")
    return r.table("part").select(F.col("p_partkey").alias("uuid"), enrichment.search_text(F.col("p_name"), path, {"PROMO": "Werbung", "SMALL": "Klein"}).alias("search"))


@registered("SELECT p_partkey AS uuid, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_type || ' ' || p_brand END), ''), p_name) AS doc FROM part")
def semantic_texts(r: Roles) -> DataFrame:
    given = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    return r.table("part").select(F.col("p_partkey").alias("uuid"), enrichment.semantic_text(given, F.col("p_name")).alias("doc"))


@registered(f"""WITH {oracle.BASE}, {oracle.VECTORS}, every AS (SELECT DISTINCT text FROM (SELECT text FROM docs UNION ALL SELECT text FROM queries UNION ALL SELECT enriched FROM queries))
SELECT text, array_to_string(list_transform(coalesce(dv.v, qv.v), lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ' ') AS millionths FROM every LEFT JOIN dv USING (text) LEFT JOIN qv USING (text)""")
def text_vectors(r: Roles) -> DataFrame:
    """The vector of every different text of items and queries, in millionths."""
    column = lambda df, c: df.select(F.col(c).alias("text"))
    texts = column(r.documents, "doc").unionByName(column(r.queries, "text")).unionByName(column(r.queries, "enriched"))
    return r.encoder.encode(texts).select("text", F.array_join(F.transform("v", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), " ").alias("millionths"))


@registered("""SELECT o_orderkey AS element_id, coalesce(nullif(n_name, ''), nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END, ''), nullif(o_orderpriority, ''), '') AS type_name FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 50""")
def element_type_names(r: Roles) -> DataFrame:
    own = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    elements = r.table("orders").select(F.col("o_orderkey").alias("element_id"), (F.col("o_custkey") % 50).alias("type_id"), own.alias("own_name"), F.col("o_orderpriority").alias("family"))
    types = r.table("nation").select(F.col("n_nationkey").cast("long").alias("type_id"), F.col("n_name").alias("name"))
    return context.type_names(elements, types).select("element_id", "type_name")


@registered("SELECT p_partkey AS key FROM part WHERE p_size = 7 UNION SELECT p_partkey FROM part WHERE contains(lower(p_type || ' ' || p_name), 'ring')")
def visible_selection(r: Roles) -> DataFrame:
    part = r.table("part").withColumnRenamed("p_partkey", "key")
    return context.select_visible(part.withColumn("display_name", F.concat_ws(" ", "p_type", "p_name")), part.where("p_size = 7"), "RING")


@registered("""SELECT l_partkey AS material_id, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) || coalesce(' (' || string_agg(DISTINCT nullif(s, ''), ', ' ORDER BY nullif(s, '')) || ')', '') AS hosts
  FROM lineitem JOIN (SELECT *, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS s FROM orders) ON o_orderkey = l_orderkey WHERE l_partkey > 0 GROUP BY 1""")
def host_strings(r: Roles) -> DataFrame:
    lines, elements = _hosts(r)
    return context.host_map(context.edges(lines), elements).select("material_id", enrichment.host_string(F.col("categories"), F.col("types")).alias("hosts"))


@registered("SELECT uuid, coalesce(a, b) AS name FROM (SELECT p_partkey AS uuid, p_name AS a FROM part WHERE p_partkey % 2 = 0) FULL JOIN (SELECT p_partkey AS uuid, p_brand AS b FROM part WHERE p_partkey % 3 = 0) USING (uuid)")
def merged_items(r: Roles) -> DataFrame:
    part = r.table("part").withColumnRenamed("p_partkey", "uuid")
    return enrichment.merged_items(part.where("uuid % 2 = 0").withColumnRenamed("p_name", "name"), part.where("uuid % 3 = 0").withColumnRenamed("p_brand", "name"))


@registered(over(VECTORS, """SELECT cosine, count(*) AS n, round(least(0.97::DOUBLE, 1 / (1 + exp(-(8.0::DOUBLE * cosine - 2)))), 6) AS confidence
  FROM (SELECT floor(10 * score) / 10::DOUBLE AS cosine FROM vs) GROUP BY cosine"""))
def cosine_table(r: Roles) -> DataFrame:
    """The cosines of all queries and rows, down to tenths: how many reach each, and what confidence it stands for."""
    scored = ranking.score_vectors(r.vector_queries, r.vector_corpus).select((F.floor(10 * F.col("score")) / F.lit(10.0)).alias("cosine"))
    return scored.groupBy("cosine").agg(F.count("*").alias("n")).withColumn("confidence", ranking.calibrated(F.col("cosine"), "semantic", r.parameters.curves))


@registered(over(FULL, f"SELECT mode, mode || ' finds ' || CAST(round(100.0::DOUBLE * rall / greatest(denom, 1), 1) AS VARCHAR) || ' % anywhere and ' || CAST(round(100.0::DOUBLE * r1 / greatest(denom, 1), 1) AS VARCHAR) || ' % at rank 1' AS sentence FROM (SELECT mode, count(*) FILTER (label = 'match') AS denom, {CELLS}, count(*) FILTER (label = 'match' AND hit_rank IS NOT NULL) AS rall FROM pq GROUP BY mode)"))
def executive_summary(r: Roles) -> DataFrame:
    return enrichment.executive_summary(metrics.recall(r.evaluated(correct=False)))


@registered(over(FULL, "SELECT query_id, coalesce(uuid, -1) AS uuid, score, CAST(coalesce(rank, 0) AS INT) AS rank, label, CASE WHEN label <> 'match' THEN 'skipped: ' || label WHEN hit_rank IS NULL THEN 'miss' WHEN hit_rank <= 5 THEN 'hit at ' || hit_rank ELSE 'hit beyond 5' END AS status FROM (SELECT * FROM pq WHERE mode = 'hybrid') LEFT JOIN (SELECT query_id, uuid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) AS rank FROM modes WHERE mode = 'hybrid' AND score >= 0.5) USING (query_id) WHERE coalesce(rank, 0) <= 5"))
def result_grid(r: Roles) -> DataFrame:
    """Candidates above the threshold, numbered anew, below each query's status; a query without any has one placeholder row."""
    done = r.evaluated(("hybrid",), correct=False)
    status = done.select("query_id", "label", metrics.hit_status(F.col("label"), F.col("hit_rank"), 5).alias("status"))
    fusion = r.parameters.fusion
    high = r.fused_first(0, least=0.4999 * (fusion.w_bm25 + fusion.w_sem) / (fusion.k + 1)).withColumnRenamed("normalised", "score")
    shown = r.to_queries(r.cut(ranking.threshold_top(high.select("query_id", "uuid", "score", "rank"), 0.5, 5)), by="pair")
    rows = status.join(shown, "query_id", "left")
    return rows.select("query_id", F.coalesce("uuid", F.lit(-1)).alias("uuid"), "score", F.coalesce("rank", F.lit(0)).alias("rank"), "label", "status")


@registered("SELECT DISTINCT o_orderpriority AS category, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INT) AS place FROM orders WHERE o_orderstatus <> 'P'")
def category_list(r: Roles) -> DataFrame:
    names = r.table("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("category")).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy("category")))


@registered("SELECT p_partkey AS material_id, s_name AS structural_asset, n_name AS thermal_asset FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 200 LEFT JOIN nation ON n_nationkey = p_size")
def asset_lookup(r: Roles) -> DataFrame:
    part = r.table("part").withColumn("structural", F.col("p_partkey") % 200)
    both = part.join(r.table("supplier"), F.col("s_suppkey") == F.col("structural"), "left").join(F.broadcast(r.table("nation")), F.col("n_nationkey") == F.col("p_size"), "left")
    return both.select(F.col("p_partkey").alias("material_id"), F.col("s_name").alias("structural_asset"), F.col("n_name").alias("thermal_asset"))


@registered(over(BASE, "SELECT query_id, uuid, CAST(row_number() OVER (PARTITION BY query_id, uuid ORDER BY contribution DESC, term, source) AS INT) AS place, term, contribution FROM (SELECT query_id, uuid, term, source, round(contribution, 6) AS contribution FROM lex_terms)"), large=True)
def top_terms(r: Roles) -> DataFrame:
    """Terms are numbered once for each different text and form, before these are spread out to queries and rows."""
    w = Window.partitionBy("bag", "form").orderBy(F.desc("contribution"), "term", "source")
    placed = lambda terms: terms.withColumn("contribution", F.round("contribution", 6)).select("bag", "form", F.row_number().over(w).alias("place"), "term", "contribution")
    return lexical.every_term(r.queries, r.corpus, keep=r.cut, change=placed).select("query_id", "uuid", "place", "term", "contribution")


@registered("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def metric_over_time(r: Roles) -> DataFrame:
    return windows.metric_over_time(r.table("events"), "ts", "value", "1 day", "1 hour", "event_type")


def queries() -> dict[str, Query]:
    return {name: plan for name, (plan, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items()}

"""Registered plans against their SQL. All pairs are compared by the driver; here those that end quickly."""

import math

import duckdb
import pytest

from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
QUICK = ["text_vectors", "semantic_topk", "recall_at_k", "threshold_topk", "empty_group_placeholder", "corpus_stats", "bm25f_topk", "typo_expansion", "trigram_overlap", "regex_search", "fuzzy_search", "rrf_fusion", "rerank_head", "rerank_fallback",
  "recall_modes", "mcnemar_matrix", "scope_truth_join", "truth_substring_join", "acceptable_union", "host_map", "edge_union", "property_projection", "conditional_properties", "lookup_chain", "nested_properties", "material_scope", "step_verdict",
  "enriched_query", "preview_entry", "search_texts", "merged_items", "cosine_table", "result_grid", "category_list", "asset_lookup", "metric_over_time"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations benchmark".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(([None if isinstance(v, float) and math.isnan(v) else v for v in r] for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_plan_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    said = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in said.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in said.fetchall()]
    assert plain([r[c] for c in columns] for r in got.collect()) == plain(want)
    spark.catalog.clearCache()

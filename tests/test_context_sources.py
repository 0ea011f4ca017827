import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import context, enrichment
from lodestone.plans import report
from lodestone.plans.roles import Roles
from lodestone.sources import readers, services, writers
from lodestone.streaming.windows import metric_over_time


def test_hosts_are_sorted_sets_without_empty_types(spark):
    links = context.edges(spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, -1)], "element_id long, material_id long"))
    elements = spark.createDataFrame([(1, "Walls", "B"), (2, "Floors", "")], "element_id long, category string, type_name string")
    assert context.host_map(links, elements).collect() == [(10, ["Floors", "Walls"], ["B"])]


def test_scopes_leave_out_links_and_curtain_hosts(spark):
    rows = spark.createDataFrame([(1, "Walls", 7, False), (2, "RVT Links", 7, None), (3, "Walls", 8, True), (4, None, 7, None), (5, "Floors", 8, None)], "element_id long, category string, view_id long, has_curtain_grid boolean")
    ids = lambda df: [r["element_id"] for r in df.orderBy("element_id").collect()]
    assert ids(context.scoped_elements(rows)) == [1, 5]
    assert ids(context.scoped_elements(rows, view=8)) == [5]
    assert ids(context.scoped_elements(rows, categories=["Walls"])) == [1]
    assert ids(context.scoped_elements(rows, picked=[5])) == [5]


def test_projection_follows_the_selection(spark):
    rows = spark.createDataFrame([(1, "C25 12.30001", "", "M", (2400.0, None)), (2, "W", "Wood", "", (None, None))], "revit_id long, name string, class string, manufacturer string, physical struct<density_kg_m3: double, poissons_ratio: double>")
    got = [json.loads(r["record"]) for r in context.project(rows, ["identity.class", "physical.density_kg_m3"]).collect()]
    assert got == [{"revit_id": 1, "name": "C25 12.30001", "physical_asset": {"density_kg_m3": 2400.0}}, {"revit_id": 2, "name": "W", "class": "Wood"}]
    with pytest.raises(ValueError):
        context.project(rows, ["identity.name"])


def test_catalog_has_thirty_five_properties():
    assert len(context.catalog_keys()) == 35


def test_conditional_properties(spark):
    rows = spark.createDataFrame([(30.0, "Concrete"), (30.0, "Wood")], "x double, s string")
    assert [r[0] for r in rows.select(context.conditional("concrete_compression_mpa", F.col("x"), F.col("s"))).collect()] == [30.0, None]
    assert rows.select(context.conditional("poissons_ratio", F.lit(0.0), F.col("s")).alias("v")).first()["v"] is None


def test_corpus_and_truth_readers(spark, tmp_path):
    (tmp_path / "ds_cache_v2_a2_sphera_en.json").write_text(json.dumps({"results": [{"uuid": "u1", "name": "n", "classification": "a / b"}, {"uuid": "u0", "name": "m", "classification": None}]}))
    got = readers.read_corpus(spark, str(tmp_path), "a2_sphera", "en").orderBy("ordinal").collect()
    assert [(r["uuid"], r["ordinal"]) for r in got] == [("u1", 0), ("u0", 1)]
    assert readers.read_corpus(spark, str(tmp_path), "a2_sphera", "de").count() == 0
    (tmp_path / "gt.json").write_text(json.dumps({"version": "1", "entries": [{"name": "x", "label": "match", "acceptable_uuids": ["u1"], "top_10": [{"uuid": "u1"}]}]}))
    entries, header = readers.read_truth(spark, str(tmp_path / "none.json"), str(tmp_path / "gt.json"))
    assert entries.first()["acceptable"] == ["u1"] and header.first()["version"] == "1"
    assert readers.read_vectors(spark, str(tmp_path / "none")).count() == 0


def test_ladder_of_a_missing_language_is_empty(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"lang": "en", "out": {"semantic": [{"label": "name", "mrr": 0.5}, {"label": "class", "mrr": 0.6}]}}]))
    assert [(r["step"], r["mrr"]) for r in readers.read_ladder(spark, str(tmp_path / "l.json"), "en").orderBy("step").collect()] == [(0, 0.5), (1, 0.6)]
    assert readers.read_ladder(spark, str(tmp_path / "l.json"), "de").count() == 0


def test_settings_and_parameters(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"version": 1, "context": True, "threshold": 400, "other": 1}))
    got = readers.Settings.load(str(path))
    assert (got.context, got.threshold, got.top) == (False, 100, 5)
    got.save(str(path))
    assert readers.Settings.load(str(path)) == got
    assert readers.read_parameters(str(tmp_path / "no"), {"k": 1}) == ({"k": 1}, "default")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}')], "revit_id long, record string")
    writers.write_records(rows, str(tmp_path / "r"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"a":1}', '{"a":2}']
    writers.write_back(rows, spark.createDataFrame([(1, True), (2, None)], "revit_id long, read_only boolean"), str(tmp_path / "w"))
    assert [r["revit_id"] for r in spark.read.parquet(writers.current(spark, str(tmp_path / "w"))).collect()] == [2]
    assert writers.write_report(str(tmp_path / "x.MD"), "<p>", "# m") == "markdown" and (tmp_path / "x.MD").read_text() == "# m"


def test_report_escapes_and_says_what_is_cut(spark, monkeypatch):
    monkeypatch.setattr(report, "MOST_ROWS", 1)
    table = {"T": spark.createDataFrame([("<a|b>",), ("c",)], "x string")}
    assert "&lt;a|b&gt;" in report.html(table) and "<a\\|b>" in report.markdown(table) and "Only the first 1" in report.markdown(table)


def test_material_scope_keeps_the_first_of_equal_names(spark):
    materials = spark.createDataFrame([(3, "b"), (1, "b"), (2, "a"), (4, "")], "material_id long, name string")
    links = spark.createDataFrame([(9, 1), (9, 2)], "element_id long, material_id long")
    assert [tuple(r) for r in readers.material_scope(materials).collect()] == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in readers.material_scope(materials, links, picked=["b"]).collect()] == [("b", 1)]


def test_windows_in_batch_and_stream_agree(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", 1.0), ("2024-01-01 02:00:00", 3.0), ("2024-01-02 01:00:00", 5.0)], "t string, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "e"))
    batch = metric_over_time(rows, "t", "v").collect()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = metric_over_time(stream, "t", "v").writeStream.outputMode("complete").format("memory").queryName("over_time").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(batch) == sorted(spark.table("over_time").collect()) and len(batch) == 2


def test_roles_hold_their_shape(spark):
    roles = Roles(spark, "/root/testdata/sf0.001")
    assert roles.truth.count() == roles.queries.count() and roles.corpus.where("uuid % 10 = 0").count() == 0


def test_services_fall_back_on_failure(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "query_id long, text string")
    got = {r["query_id"]: r["v"] for r in services.with_vectors(asked, lambda: lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {1: [1.0], 2: [1.0], 3: None}

    def broken():
        raise OSError("no service")

    assert not services.available(broken) and services.available(lambda: lambda texts: [[1.0]])
    pairs = spark.createDataFrame([(1, "q", 1, "d"), (1, "q", 2, "dd"), (2, "q", 3, "d")], "query_id long, text string, uuid long, document string")
    got = services.with_logits(pairs, lambda: lambda q, docs: [1.0, 2.0]).collect()
    assert {r["uuid"]: r["logit"] for r in got if r["query_id"] == 1} == {1: 1.0, 2: 2.0}
    assert [(r["logit"], r["error"]) for r in got if r["query_id"] == 2] == [(None, "2 logits for 1 rows")]


def test_modes_say_what_they_lack():
    got = services.usable_modes(10, stats=False, vectors=True, embedding=True, reranker=True)
    assert got["semantic+rerank"] == "" and got["hybrid"] == "corpus statistics" and got["regex"] == ""
    assert services.cost_minutes(54) == (1, 3) and services.cost_minutes(1) == (1, 2)


def test_enrichment_keeps_the_registry_order(spark):
    rows = spark.createDataFrame([(" Wall ", "Concrete", "", 2400.0)], "name string, a string, b string, d double")
    columns = {"class": F.col("a"), "description": F.col("b"), "density": F.col("d")}
    assert rows.select(enrichment.enriched_query(F.col("name"), ["density", "description", "class", "other"], columns)).first()[0] == "Wall Concrete 2400.0"
    assert rows.select(enrichment.host_string(F.array(F.lit("Walls")), F.expr("cast(array() as array<string>)"))).first()[0] == "Walls"
    entries = spark.createDataFrame([(0, "x", "skipped", "c"), (1, "y", "match", "")], "ordinal int, name string, label string, a string")
    show = lambda applied: tuple(enrichment.preview(entries, ["class"], {"class": F.col("a")}, applied).first())
    assert show(None) == show(["class"]) == (1, "y", "y", False, False) and show(["density"]) == (1, "y", "y", False, True)


def test_provenance_reads_file_times(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "c"))
    assert enrichment.provenance(spark.read.parquet(str(tmp_path / "c"))).count() >= 1


def test_missing_truth_has_no_entries(spark, tmp_path):
    entries, header = readers.read_truth(spark, str(tmp_path / "no.json"), str(tmp_path / "none.json"))
    assert entries.count() == 0 and header is None and {"ordinal", "name", "acceptable"} <= set(entries.columns)


def test_parameters_reach_the_modes(spark, tmp_path):
    (tmp_path / "bm25_params_v1.json").write_text(json.dumps({"params": {"k1": 0.5, "other": 1}}))
    (tmp_path / "hybrid_params_a2_sphera_en.json").write_text(json.dumps({"params": {"pool": "symmetric", "k": 10, "w_sem": 2}}))
    (tmp_path / "confidence_hybrid_a2_sphera_en.json").write_text(json.dumps({"a": 2, "b": -1}))
    (tmp_path / "calibration_a2_sphera_en.json").write_text(json.dumps({"x": [0, 5], "y": [0.1, 0.8]}))
    (tmp_path / "confidence_reranker_a2_sphera_en.json").write_text("{")
    got = readers.load_parameters(str(tmp_path), "a2_sphera", "en")
    assert got.bm25.k1 == 0.5 and (got.fusion.pool, got.fusion.k, got.fusion.w_sem, got.fusion.w_bm25) == ("symmetric", 10, 2.0, 1.0)
    assert got.curves["hybrid"] == (2.0, -1.0) and got.curves["bm25f"] == [(0.0, 0.1), (5.0, 0.8)] and got.curves["semantic"] == (8.0, -2.0)
    assert got.notes["confidence_semantic_a2_sphera_en.json"] == "default" and got.notes["confidence_reranker_a2_sphera_en.json"].startswith("default:")
    assert readers.load_parameters(str(tmp_path), "a1_sphera", "de").fusion == readers.Fusion()
    tuned, plain = (Roles(spark, "/root/testdata/sf0.001", p) for p in (got, None))
    best = lambda r: r.hybrid().agg(F.max("raw")).first()[0]
    assert 2 / 11 < best(tuned) <= 3 / 11 + 1e-6 and best(plain) < 2 / 60
    assert tuned.lexical().agg(F.sum("score")).first()[0] > plain.lexical().agg(F.sum("score")).first()[0]
    tuned.close(), plain.close()
    assert not tuned.kept


def test_services_have_a_time_limit(spark):
    import time

    start = time.monotonic()
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    slow = lambda: lambda texts: time.sleep(20)
    assert "no answer within 300 ms" in services.with_vectors(asked, slow, milliseconds=300).first()["error"]
    pairs = spark.createDataFrame([(1, "q", 1, "d")], "query_id long, text string, uuid long, document string")
    assert "no answer" in services.with_logits(pairs, lambda: lambda q, docs: time.sleep(20), milliseconds=300).first()["error"]
    assert time.monotonic() - start < 19


def test_a_failed_write_leaves_the_old_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a":1}')], "revit_id long, record string")
    path = str(tmp_path / "r")
    writers.write_records(rows, path)
    with pytest.raises(Exception, match="broken"):
        writers.write_records(rows.withColumn("record", F.raise_error(F.lit("broken")).cast("string")), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ['{"a":1}']
    writers.write_records(rows.withColumn("record", F.lit("{}")), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["{}"] and [p.name for p in tmp_path.iterdir()] == ["r"]


def test_a_reader_sees_the_old_or_the_new_version_at_every_step(spark, tmp_path):
    path, seen = str(tmp_path / "w"), []
    numbers = lambda: sorted(r["id"] for r in spark.read.parquet(writers.current(spark, path)).collect())
    write = lambda n: lambda to: spark.range(n).write.parquet(to)
    with pytest.raises(FileNotFoundError):
        writers.current(spark, path)
    first = writers.committed(spark, path, write(1))
    assert numbers() == [0] and writers.current(spark, path) == first

    def watched(to):
        seen.append(numbers())
        write(2)(to)
        seen.append(numbers())

    held = writers.current(spark, path)
    second = writers.committed(spark, path, watched)
    assert seen == [[0], [0]] and numbers() == [0, 1] and spark.read.parquet(held).count() == 1
    with pytest.raises(RuntimeError):
        writers.committed(spark, path, lambda to: (write(3)(to), (_ for _ in ()).throw(RuntimeError("ended"))))
    assert writers.current(spark, path) == second and len(list((tmp_path / "w").iterdir())) == 3
    write(5)(f"{path}/vleft")  # a driver that ended before it committed
    assert numbers() == [0, 1]
    for n in (3, 4, 5):
        writers.committed(spark, path, write(n))
    assert numbers() == [0, 1, 2, 3, 4] and [n for n, _ in writers.versions(spark, path)] == [4, 5]


def test_ladders_follow_the_registry_order():
    steps = enrichment.ladder(["density", "class", "unknown", "description"])
    assert steps == [("name", [], False), ("class", ["class"], False), ("description", ["class", "description"], False), ("density", ["class", "description", "density"], True)]


def test_selection_of_all_that_is_visible(spark):
    catalog = spark.createDataFrame([(1, "Red ring"), (2, "Anvil"), (3, "ring")], "key long, display_name string")
    chosen = spark.createDataFrame([(2,), (3,)], "key long")
    assert {r["key"] for r in context.select_visible(catalog, chosen, "RING").collect()} == {1, 2, 3}
    assert {r["key"] for r in context.select_visible(catalog, chosen, "(", regex=True).collect()} == {2, 3}


def test_a_report_is_written_whole_in_the_form_of_its_path(spark, tmp_path, monkeypatch):
    """The sections are made small here: what a run computes is tested by itself."""
    monkeypatch.setattr(report, "sections", lambda roles, settings=None: {"Summary": roles.keep(spark.range(2)), "Method": spark.createDataFrame([("a|b",)], "term string")})
    for name, kind, heads in (("r.md", "markdown", ["## Summary", "## Method"]), ("r.html", "html", ["<h2>Summary</h2>", "<h2>Method</h2>"])):
        roles = Roles(spark, "/root/testdata/sf0.001")
        assert report.write(roles, str(tmp_path / name)) == kind and roles.kept == []
        text = (tmp_path / name).read_text()
        assert all(h in text for h in heads)


def test_report_shows_seconds_by_mode(spark):
    got = report.mode_seconds(Roles(spark, "/root/testdata/sf0.001"), readers.Settings()).collect()
    assert {r["mode"] for r in got} == set(report.stats.MODES) and all(r["seconds"] > 0 for r in got)

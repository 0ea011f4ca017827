"""Readers with explicit schemas: corpus, ground truth, vectors, ladder reference, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lexical import Bm25f
from lodestone.operators.ranking import CURVES, Fusion

# Field names, stocks, languages and file names of the files that are read.
CORPUS = "results array<struct<uuid: string, name: string, classification: string>>"
ENTRY = (
    "struct<name: string, label: string, class: string, description: string, correct_uuid: string, acceptable_uuids: array<string>, host_categories: array<string>, host_types: array<string>, "
    "expected_classification_path: string, lca_reasoning: string, top_10: array<struct<name: string, uuid: string, classification: string, rationale: string>>, "
    "concrete_grade: string, structural_class: string, density: string, thermal_conductivity: string>"
)
TRUTH = (
    f"entries array<{ENTRY}>, version string, dataset_count string, matched_count string, skipped_count string, source_revit_model string, validation_status string, methodology string, ranking_basis array<string>"
)
LADDER = "lang string, out map<string, array<struct<label: string, mrr: double>>>"
STOCKS = ("a2_sphera", "a1_sphera", "a2_ecoinvent", "project_epds")
LANGUAGES = ("en", "de")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_corpus(spark: SparkSession, root: str, stock: str, lang: str) -> DataFrame:
    """Rows (uuid, name, classification, ordinal) of a stock and language; a missing file gives none."""
    path = f"{root}/ds_cache_v2_{stock}_{lang}.json"
    if not exists(spark, path):
        return spark.createDataFrame([], "uuid string, name string, classification string, ordinal long")
    rows = spark.read.schema(CORPUS).json(path, multiLine=True).select(F.posexplode("results").alias("ordinal", "r"))
    return rows.select("r.uuid", "r.name", "r.classification", F.col("ordinal").cast("long").alias("ordinal"))


def read_truth(spark: SparkSession, path: str, fallback: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(entries with ordinal, header). The fallback is read where path is missing; where both are, there are no entries and no header."""
    path = next((x for x in (path, fallback) if x and exists(spark, x)), None)
    if path is None:
        entries = spark.createDataFrame([], f"ordinal int, e {ENTRY}")
        return entries.select("ordinal", "e.*").withColumnRenamed("acceptable_uuids", "acceptable"), None
    whole = spark.read.schema(TRUTH).json(path, multiLine=True)
    entries = whole.select(F.posexplode("entries").alias("ordinal", "e")).select("ordinal", "e.*").withColumnRenamed("acceptable_uuids", "acceptable")
    return entries, whole.drop("entries")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Rows (uuid, v) from Parquet; a missing path gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "uuid string, v array<float>")
    return spark.read.schema("uuid string, v array<float>").parquet(path)


def read_parameters(path: str, default: dict) -> tuple[dict, str]:
    """(parameters, note): the file's params over the default; the note says when a file is missing or broken."""
    try:
        return default | json.loads(Path(path).read_text())["params"], ""
    except FileNotFoundError:
        return dict(default), "default"
    except (ValueError, KeyError, TypeError) as error:
        return dict(default), f"default: {error}"


CALIBRATED = ("bm25f", "semantic", "hybrid", "reranker")


@dataclass(frozen=True)
class Parameters:
    """What the modes are tuned with: lexical and fusion parameters, confidence curves by mode (see ranking.calibrated), and where each came from."""

    bm25: Bm25f = Bm25f()
    fusion: Fusion = Fusion()
    curves: dict = field(default_factory=lambda: dict(CURVES))
    notes: dict = field(default_factory=dict)


def _curve(found: dict) -> tuple | list:
    """A curve from a fitted file: breakpoints x and y (steps), or slope a and offset b of a sigmoid."""
    if "x" in found:
        return sorted(zip(map(float, found["x"]), map(float, found["y"]), strict=True))
    return float(found["a"]), float(found["b"])


def load_parameters(root: str, stock: str, lang: str) -> Parameters:
    """The parameters of a stock and language from bm25_params_v1.json, hybrid_params_*, confidence_{mode}_* and, for the lexical mode, calibration_* below root.

    A missing file leaves the default; a broken one does too, and notes say so. Unknown names in a file are left out.
    """
    notes: dict[str, str] = {}

    def tuned(name: str, default: object) -> object:
        known = vars(default)
        found, notes[name] = read_parameters(f"{root}/{name}", known)
        try:
            return type(default)(**{k: type(known[k])(v) for k, v in found.items() if k in known})
        except (TypeError, ValueError) as error:
            notes[name] = f"default: {error}"
            return default

    curves = dict(CURVES)
    names = [("bm25f", f"calibration_{stock}_{lang}.json")] + [(mode, f"confidence_{mode}_{stock}_{lang}.json") for mode in CALIBRATED]
    for mode, name in names:
        try:
            curves[mode] = _curve(json.loads(Path(f"{root}/{name}").read_text()))
            notes[name] = ""
        except FileNotFoundError:
            notes[name] = "default"
        except (ValueError, KeyError, TypeError) as error:
            notes[name] = f"default: {error}"
    return Parameters(tuned("bm25_params_v1.json", Bm25f()), tuned(f"hybrid_params_{stock}_{lang}.json", Fusion()), curves, notes)


def read_ladder(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Rows (mode, step, label, mrr) of the record of lang; nothing when there is none."""
    rows = spark.read.schema(LADDER).json(path, multiLine=True).where(F.col("lang") == lang)
    return rows.select(F.explode("out").alias("mode", "steps")).select("mode", F.posexplode("steps").alias("step", "s")).select("mode", "step", "s.label", "s.mrr")


@dataclass
class Settings:
    """What a run is set to. A context flag counts only from schema version 2 on."""

    stock: str = STOCKS[0]
    lang: str = "en"
    scope: str = "project_materials"
    top: int = 5
    threshold: int = 50
    truth_path: str = ""
    version: int = 3
    context: bool = False
    fields: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> "Settings":
        try:
            raw = json.loads(Path(path).read_text())
        except (OSError, ValueError):
            return cls()
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        if raw.get("version", 1) < 2:
            known.pop("context", None)
            known.pop("fields", None)
        out = cls(**known)
        out.threshold, out.version = max(0, min(100, int(out.threshold))), 3
        return out

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.__dict__, indent=2))


def material_scope(materials: DataFrame, links: DataFrame | None = None, elements: DataFrame | None = None, picked: list[str] | None = None) -> DataFrame:
    """Distinct names in order: of all materials, of those used by elements, or of picked names (of equal names the first material stays)."""
    if links is not None:
        used = links if elements is None else links.join(elements.select("element_id"), "element_id", "left_semi")
        materials = materials.join(used.select("material_id").distinct(), "material_id", "left_semi")
    if picked is not None:
        materials = materials.where(F.col("name").isin(*picked))
    return materials.where("name <> ''").groupBy("name").agg(F.min("material_id").alias("material_id")).orderBy("name")

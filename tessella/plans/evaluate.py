"""Evaluation runs: which models to score, and accuracy reports over labelled sets."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import filters
from tessella.functions.dims import canonical, with_canonical, with_lang
from tessella.operators import reports

# fixed values: bands of accuracy in reports
BANDS = (("good", 0.85), ("fair", 0.70), ("weak", 0.50))


@dataclass(frozen=True)
class Run:
    name: str
    model: str
    dataset: str
    active: bool = True
    batch: int = 32
    sample: int | None = 10_000
    runner_up: float = 0.9


def runs(manifest: Any) -> list[Run]:
    """Runs of a manifest, which is a list of runs, or an object with runs and defaults; names must differ."""
    if isinstance(manifest, dict):
        defaults, rows = manifest.get("defaults", {}), manifest.get("runs", [])
    else:
        defaults, rows = {}, manifest or []
    known = Run.__dataclass_fields__
    out = [Run(**{k: v for k, v in {**defaults, **row}.items() if k in known}) for row in rows]
    if len({r.name for r in out}) < len(out):
        raise ValueError("two runs have the same name")
    return out


def active(manifest: Any, names: list[str] | None = None) -> list[Run]:
    """Active runs, or those named."""
    found = runs(manifest)
    if names:
        missing = set(names) - {r.name for r in found}
        if missing:
            raise KeyError(f"no such run: {sorted(missing)}")
        return [r for r in found if r.name in names]
    return [r for r in found if r.active]


def labelled_set(df: DataFrame, label: str, text: str = "text", key: str = "doc") -> DataFrame:
    """(doc, text, true_lang) of rows whose label is a known language in its own script; xxx_Script labels are split."""
    rows = df.withColumn("lang", F.substring_index(label, "_", 1)).withColumn("_label", F.col(label))
    rows = with_lang(with_canonical(rows)).where(F.col("lang_group").isNotNull() & filters.label_script_ok("_label"))
    return rows.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.col("lang").alias("true_lang"))


def evaluated(truth: DataFrame, spans: DataFrame, ratio: float = 0.9) -> dict[str, DataFrame]:
    """Predictions, accuracy with bands, the first errors of each language, and the best language."""
    found = reports.predictions(reports.span_coverage(spans), truth.select("doc", "true_lang"), ratio)
    acc = reports.accuracy(found)
    band = F.lit("poor")
    for name, least in reversed(BANDS):
        band = F.when(F.col("accuracy") >= least, name).otherwise(band)
    return {"predictions": found, "accuracy": acc.withColumn("band", band), "errors": reports.first_errors(found), "best": reports.best_language(acc)}


def multilabel_spans(scores: DataFrame) -> DataFrame:
    """Label scores (doc, pos, lang, score) as spans of equal length, so that rank scores order like the scores."""
    lang = F.regexp_replace(F.lower("lang"), "^[bi]-", "")
    return scores.select("doc", "pos", lang.alias("lang"), F.lit(0).alias("start"), F.lit(100).alias("end"), "score")


def code_of(label: str) -> str:
    return canonical(label.split("_")[0])


def write_mismatches(predictions: DataFrame, path: str) -> None:
    """Rows with a wrong prediction, as JSON lines."""
    predictions.where(F.col("true_lang") != F.col("pred_lang")).write.mode("overwrite").json(path)


def output_path(run: Run, folder: str, name: str | None = None) -> str:
    """Where a run's results go: an absolute path or URI as it is, others below the folder, named after the run if they have no name."""
    name = name or f"{run.name}.json"
    return name if name.startswith("/") or "://" in name else f"{folder.rstrip('/')}/{name}"

"""Whole runs: any subset of the twelve stages, in their fixed order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from canopygrid.grid import GridSpec
from canopygrid.operators import classify as cls
from canopygrid.plans import phases as ph
from canopygrid.sources.results import ResultStore

# The twelve stages as (model, kind, phase), in running order.
STAGES = {
    "BCM Calibration (CAL)": ("benchmark", "fit", "CAL"),
    "BCM Confirmation (CNF)": ("benchmark", "predict", "CNF"),
    "BCM Evaluation CAL": ("benchmark", "evaluate", "CAL"),
    "BCM Evaluation CNF": ("benchmark", "evaluate", "CNF"),
    "BCM Historical Reference (HRP)": ("benchmark", "fit", "HRP"),
    "BCM Validity Period (VP)": ("benchmark", "predict", "VP"),
    "ALT Calibration (CAL)": ("alternative", "fit", "CAL"),
    "ALT Confirmation (CNF)": ("alternative", "predict", "CNF"),
    "ALT Evaluation CAL": ("alternative", "evaluate", "CAL"),
    "ALT Evaluation CNF": ("alternative", "evaluate", "CNF"),
    "ALT Historical Reference (HRP)": ("alternative", "fit", "HRP"),
    "ALT Validity Period (VP)": ("alternative", "predict", "VP"),
}


@dataclass
class RunResult:
    """Outcomes by ``(model, phase)``."""

    nrt: int | None = None
    fits: dict[tuple[str, str], ph.Fit] = field(default_factory=dict)
    predictions: dict[tuple[str, str], ph.Prediction] = field(default_factory=dict)
    evaluations: dict[tuple[str, str], ph.Evaluation] = field(default_factory=dict)


def check(stages: set[str], params: ph.Params, store: ResultStore | None, columns: list[str]) -> list[str]:
    """Problems that keep the chosen stages from running."""
    problems = [f"unknown stage: {s}" for s in sorted(stages - set(STAGES))]
    chosen = {STAGES[s] for s in stages & set(STAGES)}
    if not chosen and not problems:
        problems.append("choose at least one stage")

    def available(model: str, kind: str, phase: str, table: str) -> bool:
        return (model, kind, phase) in chosen or (store is not None and store.has(table, model, phase))

    for model, kind, phase in sorted(chosen):
        if kind == "predict" and not available(model, "fit", ph.FITTED_BY[phase], "frequency"):
            problems.append(f"{model} {phase} needs {model} {ph.FITTED_BY[phase]} first")
        if kind == "evaluate":
            made_by = "fit" if phase == "CAL" else "predict"
            if not available(model, made_by, phase, "density"):
                problems.append(f"{model} evaluation {phase} needs {model} {phase} first")
        if model == "benchmark" and kind != "evaluate" and (kind, phase) != ("fit", "CAL"):
            if not available("benchmark", "fit", "CAL", "threshold"):
                problems.append(f"benchmark {phase} needs the risk threshold of benchmark CAL first")
        if model == "alternative" and kind != "evaluate" and ph.PHASES[phase].potential not in columns:
            problems.append(f"alternative {phase} needs the layer {ph.PHASES[phase].potential}")
        if phase == "VP" and not (params.expected_deforestation and params.expected_deforestation > 0):
            problems.append("VP needs a positive expected deforestation")
        if phase == "VP" and not (params.vp_years and params.vp_years > 0):
            problems.append("VP needs a positive length in years")
        if kind == "evaluate" and not params.evaluation_grid_area > 0:
            problems.append("evaluation needs a positive grid area")
        if kind != "evaluate" and not params.max_iterations > 0:
            problems.append("fitting and prediction need a positive number of iterations")
    return list(dict.fromkeys(problems))


def run(
    stages: Iterable[str],
    layers: DataFrame,
    grid: GridSpec,
    params: ph.Params = ph.Params(),
    store: ResultStore | None = None,
) -> RunResult:
    """Run the chosen stages over one wide layer table; write results when a store is given."""
    wanted = set(stages)
    problems = check(wanted, params, store, layers.columns)
    if problems:
        raise ValueError("; ".join(problems))
    chosen = [STAGES[name] for name in STAGES if name in wanted]
    needed = sorted(
        {ph.PHASES[phase].distance for model, kind, phase in chosen if model == "benchmark" and kind != "evaluate"}
        | ({"t1_distance"} if ("benchmark", "fit", "CAL") in chosen else set())
    )
    pixels = ph.prepare(layers, grid, params.area_value, tuple(needed))
    result = RunResult()
    coverage = None
    if params.strict_cells and any(kind == "evaluate" for _, kind, _ in chosen):
        coverage = ph.strict_coverage(pixels, grid, params.evaluation_grid_area)
    for model, kind, phase in chosen:
        if model == "benchmark" and result.nrt is None and kind != "evaluate":
            result.nrt = _threshold(pixels, grid, params, store, (kind, phase))
        if kind == "fit":
            done = ph.fit(pixels, model, phase, grid, params.n_classes, result.nrt)
            result.fits[model, phase] = done
            if store is not None:
                store.write_frequency(done.frequency, model, phase)
                store.write(done.pixels.select("row", "col", "risk_class", "region_id", "density"), "density", model, phase)
        elif kind == "predict":
            result.predictions[model, phase] = _predict(pixels, model, phase, grid, params, store, result)
        else:
            result.evaluations[model, phase] = _evaluate(pixels, model, phase, grid, params, store, result, coverage)
    return result


def _threshold(pixels, grid, params, store, step) -> int:
    if step != ("fit", "CAL"):
        return store.read_threshold()
    bins = cls.cumulative_share(ph.distance_histogram(pixels, grid))
    found = cls.risk_threshold(bins.select("bin", "bin_start", "bin_end", "n"))
    nrt = cls.threshold_value(found)
    if store is not None:
        store.write_threshold(found)
        store.write(bins, "distance_histogram", "benchmark", "CAL")
        edges = cls.benchmark_edges(nrt, params.n_classes, grid.step)
        store.write(cls.edge_table(pixels.sparkSession, edges), "class_edges", "benchmark", "CAL")
    return nrt


def _predict(pixels, model, phase, grid, params, store, result) -> ph.Prediction:
    source = ph.FITTED_BY[phase]
    fitted = result.fits.get((model, source))
    frequency = fitted.frequency if fitted is not None else store.read_frequency(model, source, revision=0)
    expected, years = (params.expected_deforestation, params.vp_years) if phase == "VP" else (None, None)
    done = ph.predict(
        pixels, frequency, model, phase, grid, params.n_classes, result.nrt,
        expected, years, params.max_iterations, params.tolerance,
    )
    if store is not None:
        store.add_frequency_revision(done.frequency, model, source)
        store.write(
            done.pixels.select("row", "col", "risk_class", "region_id", "density", "adjusted"), "density", model, phase
        )
        store.write(done.unseen, "unseen_zones", model, phase)
        store.write(done.adjustment.log_table(), "adjustment_log", model, phase)
    return done


def _evaluate(pixels, model, phase, grid, params, store, result, coverage) -> ph.Evaluation:
    density = "density" if phase == "CAL" else "adjusted"
    made = result.fits.get((model, phase)) if phase == "CAL" else result.predictions.get((model, phase))
    if made is not None:
        source = made.pixels
    else:
        stored = store.read("density", model, phase).select("row", "col", density)
        source = pixels.join(stored, ["row", "col"], "left")
    done = ph.evaluate(source, phase, grid, params.evaluation_grid_area, density, coverage)
    if store is not None:
        store.write(done.cells, "evaluation_cells", model, phase)
        store.write(done.metrics, "evaluation_metrics", model, phase)
    return done

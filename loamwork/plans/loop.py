"""The regeneration loop: propose field maps, score them on samples and fixtures, promote or escalate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators.agree import agreement_detail, best_candidate, failure_report, score_candidates
from loamwork.operators.fieldmap import apply_fieldmap
from loamwork.operators.validate import validate
from loamwork.sources.schemas import Schema

MIN_ORACLES, MAX_ROUNDS, PER_ROUND = 3, 3, 2


@dataclass(frozen=True)
class LoopResult:
    ok: bool
    fieldmap: dict | None
    rounds: int
    reason: str


def candidate_runs(samples: DataFrame, oracle: DataFrame, candidates: list[dict], schema: Schema, kind: str = "sample") -> DataFrame:
    """Runs of each candidate on each sample, as score_candidates reads them.

    samples: (page_id, json); oracle: (page_id, item_ix, fields as text). A field map gives one record a page.
    """
    names, runs = schema.names, None
    want = oracle.select("page_id", "item_ix", *[F.col(n).cast("string").alias(n) if n in oracle.columns else F.lit(None).cast("string").alias(n) for n in names])
    for i, spec in enumerate(candidates):
        got = apply_fieldmap(samples.select("page_id", "json"), {n: s for n, s in spec.items() if n in names})
        got = got.select("page_id", F.lit(0).alias("item_ix"), *[F.col(n) if n in spec else F.lit(None).cast("string").alias(n) for n in names])
        detail = agreement_detail(got, want, ["page_id"], schema.align_key, "item_ix", names, schema.volatile)
        ok = validate(got, schema, "page_id", samples).select("page_id", F.col("ok").alias("schema_ok"))
        one = detail.join(ok, "page_id", "left").select(F.lit(f"c{i}").alias("candidate"), F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.lit(False).alias("error"), "schema_ok", "mean", "min_item", "count_match")
        runs = one if runs is None else runs.unionByName(one)
    return runs


def run_loop(samples: DataFrame, oracle: DataFrame, propose: Callable[[int, str], list[dict]], schema: Schema, fixtures: tuple[DataFrame, DataFrame] | None = None, max_rounds: int = MAX_ROUNDS, min_oracles: int = MIN_ORACLES) -> LoopResult:
    """Up to max_rounds: `propose(round, report of the last failures)` gives field maps, the best that passes is
    the result. Fewer than min_oracles samples with trusted records end it at once."""
    usable = oracle.select("page_id").distinct().count()
    if usable < min_oracles:
        return LoopResult(False, None, 0, f"only {usable} usable oracles")
    report = ""
    for n in range(1, max_rounds + 1):
        candidates = propose(n, report)[:PER_ROUND]
        if not candidates:
            continue
        runs = candidate_runs(samples, oracle, candidates, schema)
        if fixtures is not None:
            runs = runs.unionByName(candidate_runs(*fixtures, candidates, schema, "fixture"))
        scores = score_candidates(runs)
        best = best_candidate(scores).first()
        if best is not None:
            return LoopResult(True, candidates[best["ord"]], n, "promoted")
        report = failure_report(scores).first()["report"]
    return LoopResult(False, None, max_rounds, "no candidate passed")

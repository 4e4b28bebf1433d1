"""Alignment and agreement of two record lists, drift against history, candidate scores."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.functions.compare import EPSILON, columns_equal, kind_of, money_of

AGREEMENT_BAR, FIXTURE_BAR = 0.98, 1.0


def aligned_pairs(left: DataFrame, right: DataFrame, by: list[str], key: str | None, ix: str, fields: list[str]) -> DataFrame:
    """by, pair, and structs a and b (null where a side is shorter): rows of equal rank, each side sorted by
    the key's text, then by position. A missing key sorts as the empty text: where a side has a boolean column
    <key>_given, a null whose key was given sorts as the text None."""
    def side(df: DataFrame, name: str, other: DataFrame, empty: str) -> DataFrame:
        none = F.when(F.col(f"{key}_given"), "None").otherwise("") if f"{key}_given" in df.columns else F.lit("")
        text = F.coalesce(F.col(key).cast("string"), none) if key else F.lit("")
        own, none_of = F.struct(*fields), F.lit(None).cast(other.select(F.struct(*fields)).schema[0].dataType)
        return df.select(*by, F.lit(name).alias("_side"), text.alias("_text"), F.col(ix).alias(f"_{name}"), F.lit(None).cast(other.schema[ix].dataType).alias(f"_{empty}"), own.alias(name), none_of.alias(empty))

    # both sides in one exchange by `by`: ranks, pairs and what is made of them need no other
    both = side(left, "a", right, "b").unionByName(side(right, "b", left, "a"))
    ranked = both.withColumn("pair", F.row_number().over(Window.partitionBy(*by, "_side").orderBy("_text", "_a", "_b")))
    # as in a join, rows without a key have no partner
    apart = F.when(reduce(or_, [F.col(c).isNull() for c in by]), F.col("_side"))
    return ranked.groupBy(*by, "pair", apart.alias("_apart")).agg(F.first("a", True).alias("a"), F.first("b", True).alias("b")).drop("_apart")


def pair_agreement(pairs: DataFrame, fields: list[str], volatile: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """pairs with `agree` (equal fields) and `total`; a field null on both sides agrees."""
    a, b = (dict((f.name, f.dataType) for f in pairs.schema[s].dataType.fields) for s in ("a", "b"))
    # amounts are read once, in a projection of their own
    amounts = {f"_{s}{i}": money_of(F.lit(kind_of(t[n])), F.col(f"{s}.{n}").cast("string")) for i, n in enumerate(fields) for s, t in (("a", a), ("b", b))}
    agree = sum((columns_equal(F.col(f"a.{n}"), a[n], F.col(f"b.{n}"), b[n], n in volatile, money=(F.col(f"_a{i}"), F.col(f"_b{i}"))).cast("int") for i, n in enumerate(fields)), F.lit(0))
    return pairs.withColumns(amounts).withColumn("agree", agree).withColumn("total", F.lit(len(fields))).drop(*amounts)


def agreement_detail(left: DataFrame, right: DataFrame, by: list[str], key: str | None, ix: str, fields: list[str], volatile=frozenset()) -> DataFrame:
    """by, agree, total, mean, min_item, count_match, n_items: one row per list pair; an empty side gives 0."""
    scored = pair_agreement(aligned_pairs(left, right, by, key, ix, fields), fields, volatile)
    item = F.col("agree") / F.col("total")
    per = scored.groupBy(*by).agg(F.sum("agree").alias("agree"), F.sum("total").alias("total"), F.min(item).alias("min_item"), F.count("a").alias("n_left"), F.count("b").alias("n_items"))
    both = (F.col("n_left") > 0) & (F.col("n_items") > 0)
    return per.select(*by, "agree", "total", F.when(both, F.col("agree") / F.col("total")).otherwise(0.0).alias("mean"), F.when(both, F.col("min_item")).otherwise(0.0).alias("min_item"),
                      (F.col("n_left") == F.col("n_items")).alias("count_match"), "n_items")


def with_empty_pairs(detail: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """agreement_detail with a row for each of pages (by) for which both lists are empty: these agree wholly."""
    full = pages.select(*by).distinct().join(detail, by, "left")
    return full.select(*by, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("agree", 0), ("total", 0), ("mean", 1.0), ("min_item", 1.0), ("count_match", True), ("n_items", 0))])


def items_agreement(left: DataFrame, right: DataFrame, by: list[str], key: str | None, ix: str, fields: list[str], volatile=frozenset(), pages: DataFrame | None = None) -> DataFrame:
    """by, agreement: the mean of agreement_detail; with pages (by), 1.0 for those with no records on either side."""
    detail = agreement_detail(left, right, by, key, ix, fields, volatile)
    return (detail if pages is None else with_empty_pairs(detail, pages, by)).select(*by, F.col("mean").alias("agreement"))


def score_summary(scores: DataFrame) -> DataFrame:
    """scores with `summary`, a struct of what the audit keeps of a candidate's score."""
    names = ("schema_valid", "agreement", "fixture_pass", "min_item", "counts_match", "exec_errors", "passed")
    return scores.withColumn("summary", F.struct(*names))


def latest_history(history: DataFrame, by: list[str]) -> DataFrame:
    """The row of highest id for each key: one pre-aggregated maximum."""
    rest = [c for c in history.columns if c not in by]
    return history.groupBy(*by).agg(F.max_by(F.struct(*rest), "id").alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def history_jumps(pairs: DataFrame, fields: list[str], volatile, label: str, ratio: float = 0.5, by: list[str] = ()) -> DataFrame:
    """pairs' rows that moved: `by`, label, field, old and new amount, for volatile fields whose relative change is over ratio."""
    types = {f.name: f.dataType for f in pairs.schema["a"].dataType.fields}
    rows = [F.struct(F.lit(n).alias("field"), money_of(F.lit(kind_of(types[n])), F.col(f"a.{n}").cast("string")).alias("new"), money_of(F.lit(kind_of(types[n])), F.col(f"b.{n}").cast("string")).alias("old")) for n in fields if n in volatile]
    if not rows:
        return pairs.limit(0).select(*by, F.lit("").alias("label"), F.lit("").alias("field"), F.lit(0.0).alias("old"), F.lit(0.0).alias("new"))
    flat = pairs.select(*by, F.col(f"a.{label}").alias("label"), F.inline(F.array(*rows)))
    moved = F.abs(F.col("new").cast("double") - F.col("old").cast("double")) / F.greatest(F.abs(F.col("old").cast("double")), F.lit(EPSILON)) > ratio
    return flat.where(F.col("new").isNotNull() & F.col("old").isNotNull() & moved).select(*by, "label", "field", F.col("old").cast("double").alias("old"), F.col("new").cast("double").alias("new"))


def score_candidates(runs: DataFrame, bar: float = AGREEMENT_BAR, by: list[str] = ()) -> DataFrame:
    """One row per candidate (of each `by`) from its runs (candidate, ord, kind sample or fixture, error, schema_ok, mean, min_item, count_match).

    Agreement is the mean over samples and fixtures; a run with an error counts 0 and matches nothing. To
    pass: every sample valid, all counts equal, no item below the bar, fixtures reproduced, no error.
    """
    bad = F.coalesce(F.col("error"), F.lit(False))
    sample = F.col("kind") == "sample"
    per = runs.groupBy(*by, "candidate", "ord").agg(
        F.coalesce(F.bool_and(F.when(sample, F.coalesce(F.col("schema_ok"), F.lit(False)) & ~bad)), F.lit(False)).alias("schema_valid"),
        F.coalesce(F.avg(F.when(bad, 0.0).otherwise(F.col("mean"))), F.lit(1.0)).alias("agreement"),
        F.coalesce(F.avg(F.when(~sample, F.when(bad, 0.0).otherwise(F.col("mean")))), F.lit(1.0)).alias("fixture_pass"),
        F.coalesce(F.min(F.when(bad, 0.0).otherwise(F.col("min_item"))), F.lit(1.0)).alias("min_item"),
        F.coalesce(F.bool_and(~bad & F.col("count_match")), F.lit(True)).alias("counts_match"),
        F.count_if(bad).alias("exec_errors"))
    passed = F.col("schema_valid") & F.col("counts_match") & (F.col("min_item") >= bar) & (F.col("fixture_pass") >= FIXTURE_BAR) & (F.col("exec_errors") == 0)
    return per.withColumn("passed", passed)


def best_candidate(scores: DataFrame) -> DataFrame:
    """The passing candidate of highest agreement, the first of equals; no row if none passes."""
    return scores.where("passed").orderBy(F.desc("agreement"), "ord").limit(1)


def failure_report(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, report): lines of the failing candidates, in order; candidates of a round are few."""
    line = F.format_string("candidate %s: schema_valid=%s agreement=%.3f fixtures=%.3f min_item=%.3f errors=%s", "candidate", "schema_valid", "agreement", "fixture_pass", "min_item", "exec_errors")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return scores.where("not passed").groupBy(*by).agg(F.array_join(lines, "\n").alias("report"))

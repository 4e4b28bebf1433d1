"""What a fetch came to, what class of failure it is, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.functions.text import is_challenge

# Failure classes and the action on each.
ACTIONS = {"drift": "regenerate", "blocked_rate": "recover_access", "blocked_auth": "recover_access", "blocked_challenge": "recover_access", "transient": "retry", "gone": "report", "refused": "refuse"}


def outcome_kind(status: Column) -> Column:
    return F.when((status >= 200) & (status < 300), "ok").when(status.isin(401, 403, 429), "blocked").otherwise("error")


def blocked_marker(status: Column, body: Column) -> Column:
    return F.when(status == 429, "rate").when(status.isin(401, 403), F.when(F.coalesce(is_challenge(body), F.lit(False)), "challenge").otherwise("auth"))


def classify(kind: Column, status: Column, marker: Column, listed: Column, valid: Column) -> Column:
    """Failure class of a fetch and its validation; null for none. valid: null if it didn't come to that."""
    blocked = F.when(marker.isin("rate", "auth", "challenge"), F.concat(F.lit("blocked_"), marker)).otherwise("transient")
    return F.when(~listed, "refused").when(kind == "blocked", blocked).when(kind == "error", F.when(status.isin(404, 410), "gone").otherwise("transient")).when(valid, None).when(~valid, "drift")


def action(failure: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in ACTIONS.items():
        out = F.when(failure == k, v).otherwise(out)
    return out


def should_retry(kind: Column, marker: Column) -> Column:
    return (kind == "error") | ((kind == "blocked") & F.coalesce(marker == "rate", F.lit(False)))


def backoff(attempts: DataFrame, tries: int = 3, base: float = 0.1) -> DataFrame:
    """(request, used_attempt, waited_s) from attempts (request, attempt from 1, kind, marker): the first that
    needs no retry, or the last of `tries`; waits double."""
    final = F.min(F.when(~should_retry(F.col("kind"), F.col("marker")), F.col("attempt")))
    used = F.coalesce(final, F.max("attempt"))
    return attempts.where(F.col("attempt") <= tries).groupBy("request").agg(used.alias("used_attempt"), (base * (F.pow(F.lit(2.0), used - 1) - 1)).alias("waited_s"))


def strategy_ladder(domains: DataFrame, saved: DataFrame) -> DataFrame:
    """(domain, strategy, ord): the saved strategy first, then the configured ones, each once."""
    listed = domains.select("domain", F.posexplode("access_strategies").alias("ord", "s")).select("domain", F.col("s.kind").alias("strategy"), "ord")
    first = saved.where("working_strategy is not null").select("domain", F.col("working_strategy").alias("strategy"), F.lit(-1).alias("ord"))
    once = listed.unionByName(first.join(domains.select("domain"), "domain", "left_semi")).groupBy("domain", "strategy").agg(F.min("ord").alias("ord"))
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("domain").orderBy("ord")))


def choose_strategy(first: Column, saved: Column, render_js: Column) -> Column:
    """The strategy of an inline fetch: the saved one; a browser for pages that need one; the first configured."""
    return F.coalesce(saved, F.when(render_js & ~first.isin("browser", "stealth_browser"), "browser").otherwise(first))


def recover(attempts: DataFrame, max_rounds: int = 2) -> DataFrame:
    """(domain, ok, strategy, rounds, status) from attempts (domain, round, ord, strategy, kind): the first that
    got through; else the domain is escalated."""
    place = F.when(F.col("kind") == "ok", F.struct("round", "ord"))
    per = attempts.where(F.col("round") <= max_rounds).groupBy("domain").agg(F.min_by(F.struct("strategy", "round"), place).alias("won"), F.count(place).alias("n"))
    ok = F.col("n") > 0
    return per.select("domain", ok.alias("ok"), F.when(ok, F.col("won.strategy")).alias("strategy"), F.when(ok, F.col("won.round")).otherwise(max_rounds).alias("rounds"), F.when(ok, "working").otherwise("escalated").alias("status"))


# The kinds of access strategy that a configuration may name.
KINDS = ("plain", "backoff", "browser", "stealth_browser", "session", "bypass_token", "captcha_solver")


def checked_kinds(kinds: list[str]) -> list[str]:
    """kinds, all of which must be known."""
    for kind in kinds:
        if kind not in KINDS:
            raise ValueError(f"unknown access strategy kind: {kind!r}")
    return kinds


def strategy_params(domains: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (domain, strategy) with params: those of the first configured strategy of that kind, else an empty map."""
    listed = domains.select("domain", F.posexplode("access_strategies").alias("_ord", "s")).groupBy("domain", F.col("s.kind").alias("strategy")).agg(F.min_by("s.params", "_ord").alias("params"))
    none = F.create_map().cast(listed.schema["params"].dataType)
    return chosen.join(listed, ["domain", "strategy"], "left").withColumn("params", F.coalesce("params", none))


def saved_winners(recovered: DataFrame, now: Column | str) -> DataFrame:
    """Rows (domain, working_strategy, status, updated_at) to append to the access log after recover(): the winner
    of each domain that got through, and the status of all; a domain that did not keeps its strategy."""
    return recovered.select("domain", F.when(F.col("ok"), F.col("strategy")).alias("working_strategy"), "status", (now if isinstance(now, Column) else F.lit(now)).alias("updated_at"))

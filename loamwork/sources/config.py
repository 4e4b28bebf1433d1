"""Domain configuration and the allowlist."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.text import host
from loamwork.operators.failure import checked_kinds


class UnauthorizedDomain(PermissionError):
    pass


@dataclass(frozen=True)
class Domain:
    domain: str
    max_rps: float = 1.0
    render_js: bool = False
    note: str = ""
    access_strategies: tuple[tuple[str, dict], ...] = field(default=(("backoff", {}),))


def _strategy(entry) -> tuple[str, dict]:
    if isinstance(entry, str):
        return entry, {}
    if isinstance(entry, dict) and len(entry) == 1:
        kind, params = next(iter(entry.items()))
        if params is None or isinstance(params, dict):
            return kind, dict(params or {})
    raise ValueError(f"not a strategy: {entry!r}")


def parse_domain(raw: dict) -> Domain:
    listed = raw.get("access_strategies")
    if listed is not None and not isinstance(listed, list):
        raise ValueError("access_strategies must be a list")
    known = tuple(_strategy(x) for x in listed) if listed else (("backoff", {}),)
    return Domain(norm_host(str(raw["domain"])), float(raw.get("max_rps", 1.0)), bool(raw.get("render_js", False)), str(raw.get("note") or ""), known)


def load_config(path: str) -> list[Domain]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading configuration needs PyYAML") from e
    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    found = [parse_domain(x) for x in raw.get("domains") or []]
    for d in found:  # an unknown kind is an error before anything is fetched
        checked_kinds([kind for kind, _ in d.access_strategies])
    return found


def norm_host(name: str) -> str:
    return name.strip().lower().split(":")[0]


def domains_frame(spark: SparkSession, domains: list[Domain]) -> DataFrame:
    rows = [(d.domain, d.max_rps, d.render_js, d.note, [(k, {a: str(b) for a, b in p.items()}) for k, p in d.access_strategies]) for d in domains]
    return spark.createDataFrame(rows, "domain string, max_rps double, render_js boolean, note string, access_strategies array<struct<kind: string, params: map<string, string>>>")


def on_list(url: Column, domains: list[str]) -> Column:
    """Exact host match, port and case aside; subdomains don't count."""
    return host(url).isin([norm_host(d) for d in domains]) if domains else F.lit(False)


def authorized(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Pages of listed hosts."""
    return pages.join(domains.select(F.lower(F.split("domain", ":")[0]).alias("_host")), host(F.col("url")) == F.col("_host"), "left_semi")


def refused(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Pages of hosts that aren't listed."""
    return pages.join(domains.select(F.lower(F.split("domain", ":")[0]).alias("_host")), host(F.col("url")) == F.col("_host"), "left_anti")


def assert_authorized(url: str, domains: list[Domain]) -> None:
    from urllib.parse import urlparse

    if (urlparse(url).hostname or "").lower() not in {d.domain for d in domains}:
        raise UnauthorizedDomain(url)

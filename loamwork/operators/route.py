"""Routing of URLs to families, link harvesting, pagination and sampling."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.functions.text import absolutize, absolutize_rooted, host
from loamwork.operators.numbering import numbered
from loamwork.sources.shared import kept


def _java(pattern: str) -> str:
    """Python's spelling of named groups in Java's."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern))


def sound_patterns(patterns: list[str]) -> list[str]:
    """Those that compile here and in the engine, in its spelling; a malformed one never matches and breaks nothing."""
    compiled = SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile
    sound = []
    for p in patterns:
        try:
            re.compile(p)
            compiled(_java(p))
        except (re.error, Py4JJavaError):
            continue
        sound.append(_java(p))
    return sound


def route(pages: DataFrame, families: list[tuple[str, list[str]]]) -> DataFrame:
    """pages with `family`: the first family by name any of whose patterns is found in the URL, else null.

    The registry's families are few and on the driver, so each page's family is one expression over
    literals in the scan's stage: no join and no shuffle.
    """
    found = F.lit(None).cast("string")
    for family, patterns in sorted(families, key=lambda x: x[0].encode(), reverse=True):
        for p in sound_patterns(patterns):
            found = F.when(F.col("url").rlike(p), F.lit(family)).otherwise(found)
    return pages.withColumn("family", found)


def route_by_table(pages: DataFrame, families: DataFrame) -> DataFrame:
    """As route, for families in a table (host, family, url_patterns) too many for one expression: a host's families,
    few, come as one sorted list to its pages by an equi-join on the host, and the first that matches is taken; no row
    of pages is lost, repeated or grouped. Patterns are tested once, on the driver: one list per distinct pattern."""
    known = [r[0] for r in families.select(F.explode("url_patterns").alias("p")).where("p is not null").distinct().collect()]
    sound = {p: x for p in known for x in sound_patterns([p])}
    spelled = families.sparkSession.createDataFrame(list(sound.items()) or [(None, None)], "p string, _java string")
    flat = families.select(F.col("host").alias("_host"), "family", F.explode("url_patterns").alias("p")).join(spelled, "p").groupBy("_host", "family").agg(F.collect_set("_java").alias("patterns"))
    of = flat.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("family", "patterns"))).alias("_families"))
    tried = pages.withColumn("_host", host(F.col("url"))).join(of, "_host", "left")
    hit = F.filter("_families", lambda f: F.exists(f["patterns"], lambda p: F.regexp_like(F.col("url"), p)))
    return tried.withColumn("family", F.get(hit, F.lit(0))["family"]).select(*pages.columns, "family")


#: An anchor's target, quoted or not.
ANCHOR = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
TARGET = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))$"""
# The character references that occur in URLs.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#61;", "="), ("&#x3d;", "="), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    """text with the character references of ENTITIES decoded, the ampersand last."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def harvest_links(pages: DataFrame, full_urls: bool = False) -> DataFrame:
    """(page_id, url, link_ix, link): same-host link targets of each page, first occurrences in order.

    full_urls resolves every kind of reference, in Arrow batches; otherwise root-relative and absolute
    ones, in generated code.
    """
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(ANCHOR), 0), lambda x: decoded(F.concat(*[F.regexp_extract(x, TARGET, i) for i in (1, 2, 3)])))
    flat = pages.select("page_id", "url", F.posexplode(hrefs).alias("at", "href"))
    link = absolutize(F.col("url"), F.col("href")) if full_urls else absolutize_rooted(F.col("url"), F.col("href"))
    kept = flat.withColumn("link", link).where(F.col("link").isNotNull() & (host(F.col("link")) == host(F.col("url"))))
    first = kept.groupBy("page_id", "url", "link").agg(F.min("at").alias("at"))
    return first.withColumn("link_ix", F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1).select("page_id", "url", "link_ix", "link")


def frontier(links: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, ord): links not seen yet, each at its first place; one breadth-first step."""
    return links.groupBy(F.col("link").alias("url")).agg(F.min(F.struct("page_id", "link_ix")).alias("ord")).join(seen.select("url").distinct(), "url", "left_anti")


def follow(starts: DataFrame, edges: DataFrame, max_pages: int = 10, on: str = "url") -> DataFrame:
    """(start, depth, url): pages reached by next links from each start, until there is none or max_pages.

    Cycles go round until the cap, and repeat. edges: (url, next_url), one row per url. Where pages share URLs, `on` names a
    column that tells them apart, in place of url: edges are (on, next_<on>) then. max_pages bounds the joins of the plan.
    """
    step = starts.select(F.col(on).alias("start"), F.lit(1).alias("depth"), on)
    walked = step
    links = edges.select(on, f"next_{on}").where(F.col(f"next_{on}").isNotNull())
    for depth in range(2, max_pages + 1):
        step = step.join(links, on).select("start", F.lit(depth).alias("depth"), F.col(f"next_{on}").alias(on))
        walked = walked.unionByName(step)
    return walked


def collect_samples(pages: DataFrame, seeds: list[str], wanted: int = 3, attempts: int = 12) -> list[str]:
    """URLs of up to `wanted` stored pages, breadth first over same-host links from the seeds.

    The driver holds only the frontier, at most `attempts` URLs; pages stay in the table. A URL that is not
    stored counts as an attempt.
    """
    queue, tried, got = list(dict.fromkeys(seeds)), set(), []
    while queue and len(got) < wanted and len(tried) < attempts:
        level = [u for u in queue if u not in tried][: attempts - len(tried)]
        if not level:
            break
        tried.update(level)
        stored = pages.where(F.col("url").isin(level))
        here = {r["url"] for r in stored.select("url").distinct().collect()}
        got += [u for u in level if u in here]
        links = harvest_links(stored).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("link_ix", "link"))).alias("links"))
        by = {r["url"]: [x["link"] for x in r["links"][:attempts]] for r in links.select("url", F.slice("links", 1, attempts).alias("links")).collect()}
        queue = list(dict.fromkeys(x for u in level for x in by.get(u, ()) if x not in tried))
    return got[:wanted]


def sample_families(pages: DataFrame, seeds: DataFrame, wanted: int = 3, attempts: int = 12) -> DataFrame:
    """(family, sample, attempt, page_id, url): of each family up to `wanted` stored pages, found breadth first over same-host
    links from its seeds (family, url, ord), all families at once.

    A family tries its queue in order, each URL once, until it has `wanted` pages or has made `attempts` attempts; a URL that
    isn't stored is an attempt. A level of all queues is one job, written down: numbered within the families, cut where a family has
    what it wants, then the links of what was found, first ones first, without what was tried. There are `attempts` levels at
    most, and a family has no more rows in one than it has attempts left. Of pages stored twice the least page_id counts.
    """
    stored = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    level = seeds.groupBy("family", "url").agg(F.min(F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).alias("b"))).alias("ord"))
    tried = None
    for _ in range(attempts):
        if tried is not None:
            level = level.join(tried.select("family", "url"), ["family", "url"], "left_anti")
            counts = tried.groupBy("family").agg(F.count("*").alias("_n"), F.count("page_id").alias("_got"))
            level = level.join(counts, "family", "left")
        else:
            level = level.withColumns({"_n": F.lit(0).cast("long"), "_got": F.lit(0).cast("long")})
        rank = F.row_number().over(Window.partitionBy("family").orderBy("ord", "url"))
        level = level.na.fill(0, ["_n", "_got"]).withColumn("_r", rank).where(F.col("_r") <= attempts).withColumn("attempt", F.col("_n") + F.col("_r")).where(F.col("attempt") <= attempts)
        found = level.join(stored, "url", "left")
        before = F.col("_got") + F.coalesce(F.count("page_id").over(Window.partitionBy("family").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        made = kept(found.withColumn("_before", before).where(F.col("_before") < wanted).select("family", "url", "attempt", "page_id", F.col("_before").cast("int").alias("sample")), "tried")
        if made.isEmpty():
            break
        tried = made if tried is None else tried.unionByName(made)
        hits = made.where("page_id is not null").select("family", "page_id", "attempt")
        links = harvest_links(pages.join(hits.select("page_id").distinct(), "page_id", "left_semi")).select("page_id", "link_ix", "link")
        level = hits.join(links, "page_id").groupBy("family", F.col("link").alias("url")).agg(F.min(F.struct(F.col("attempt").alias("a"), F.col("link_ix").cast("int").alias("b"))).alias("ord"))
    return tried.where("page_id is not null").select("family", "sample", "attempt", "page_id", "url")


def recorded(walked: DataFrame, pages: DataFrame, on: str = "url") -> DataFrame:
    """(start, pages): what each walk (start, depth, url; or follow's `on` in place of url) saw, in order: an array of structs depth, page_id, url and the
    SHA-256 of the page. A walk has no more pages than follow's cap. URLs that are not stored were seen by nobody."""
    own = pages.groupBy(F.col(on).alias("_on")).agg(F.min_by(F.struct("page_id", "url", F.sha2(F.col("html"), 256).alias("sha")), "page_id").alias("p"))
    seen = walked.join(own, F.col(on) == F.col("_on")).select("start", F.struct("depth", "p.page_id", "p.url", "p.sha").alias("s"))
    return seen.groupBy("start").agg(F.array_sort(F.collect_list("s")).alias("pages"))


def with_provenance(records: DataFrame, walks: DataFrame) -> DataFrame:
    """records (start, page_id, ...) with `seen`: the pages of their walk up to and with their own, in order. Records keep
    it through ladder and merge, which leave other columns alone."""
    own = F.filter("pages", lambda p: p["page_id"] == F.col("page_id"))
    last = F.array_max(F.transform(own, lambda p: p["depth"]))
    return records.join(walks, "start").withColumn("seen", F.filter("pages", lambda p: p["depth"] <= last)).drop("pages")


def snapshots_of(served: DataFrame, due: DataFrame, pages: DataFrame) -> DataFrame:
    """(family, url, html): the pages that served records were made from (family, seen), of families whose snapshot is
    due (family, due); each page once."""
    own = served.join(due.where("due").select("family"), "family", "left_semi").select("family", F.explode("seen").alias("s")).select("family", "s.page_id").distinct()
    return own.join(pages.select("page_id", "url", "html"), "page_id").select("family", "url", "html")


def distinct_seeds(history: DataFrame, current: str, most: int = 20) -> DataFrame:
    """(url, ord): URLs of the newest `most` runs, newest first, and the current one, each once."""
    recent = history.orderBy(F.desc("id")).limit(most).select("url", (-F.col("id")).alias("ord"))
    now = history.sparkSession.createDataFrame([(current, 1 << 62)], "url string, ord long")
    return recent.union(now).groupBy("url").agg(F.min("ord").alias("ord"))


def rate_slots(requests: DataFrame, max_rps: Column | float = 1.0, taken: DataFrame | None = None) -> DataFrame:
    """requests (host, ord) with the earliest second at which each may go, hosts apart.

    A host's requests are numbered by range partitions, so that one host is as many tasks as it needs. `taken` (host, n): requests that
    hosts have made before; theirs come after."""
    rps = max_rps if isinstance(max_rps, Column) else F.lit(float(max_rps))
    order = [F.col(c) for c in ("ord", *sorted(c for c in requests.columns if c not in ("host", "ord") and requests.schema[c].dataType.typeName() in ("long", "integer", "string")))]
    slots = numbered(requests, order, ["host"]).withColumn("_n", F.col("place"))
    if taken is not None:
        slots = slots.join(taken.select("host", F.col("n").alias("_taken")), "host", "left").withColumn("_n", F.col("place") + F.coalesce("_taken", F.lit(0)))
    return slots.select(*requests.columns, (F.col("_n") / rps).alias("slot_s"))


def redirects(starts: DataFrame, hops: DataFrame, allowed: list[str], most: int = 5) -> DataFrame:
    """(start, final_url, n_hops, outcome): redirects followed by hand, each hop held against the allowlist.

    outcome is ok, refused (a hop leaves the list) or too_many.
    """
    from loamwork.sources.config import on_list

    at = starts.select(F.col("url").alias("start"), F.col("url").alias("final_url"), F.lit(0).alias("n_hops"), F.when(on_list(F.col("url"), allowed), F.lit("open")).otherwise("refused").alias("outcome"))
    nxt = hops.select(F.col("url").alias("final_url"), "location")
    for _ in range(most + 1):
        at = at.join(nxt, "final_url", "left").select(
            "start", F.when((F.col("outcome") == "open") & F.col("location").isNotNull(), F.col("location")).otherwise(F.col("final_url")).alias("final_url"),
            (F.col("n_hops") + F.when((F.col("outcome") == "open") & F.col("location").isNotNull(), 1).otherwise(0)).alias("n_hops"),
            F.when(F.col("outcome") != "open", F.col("outcome")).when(F.col("location").isNull(), "ok").when(~on_list(F.col("location"), allowed), "refused").otherwise("open").alias("outcome"))
    return at.withColumn("outcome", F.when((F.col("outcome") == "open") | (F.col("n_hops") > most), "too_many").otherwise(F.col("outcome")))

"""Order MinHash fingerprints, by DataFrame functions alone."""

from __future__ import annotations

import json
import random
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamwork.llm.common import SPACES, bucket_count, documents, saved

#: A long holds 40 bits of a k-mer's hash above 24 bits of its place in the text.
PLACE = 24
LOW = (1 << PLACE) - 1
#: The six white-space characters as SQL escapes.
BLANKS = r" \t\n\u000B\u000C\r"
#: A word of more than so many characters is read by characters: each begins a k-mer of CHARS of them.
LONG_WORD, CHARS = 24, 8
#: Characters of text that one range of keys is meant to hold.
RANGE_CHARS = 64_000_000
#: Lets a join use what is partitioned by one of its keys as it is.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def range_bounds(df: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Ascending cuts of (id, h) into about `ranges` ranges of like row counts; a sketch, not the rows, comes back.
    An id that fills several ranges comes as often among the cuts of ids, and is cut by h."""
    if ranges < 2:
        return []
    at = [i / ranges for i in range(1, ranges)]
    ids = df.agg(F.percentile_approx("id", at, max(10_000, 10 * ranges))).first()[0]
    return sorted((i, -(2**63) + (k << 64) // n) for i, n in Counter(ids or []).items() for k in range(n))


def with_range(df: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """df with a column range: how many bounds lie below (id, h), by binary search in them."""
    steps = ", ".join(str(1 << b) for b in reversed(range(len(bounds).bit_length())))
    if not bounds:
        return df.withColumn("range", F.lit(0))
    ids, cuts = (f"from_json('{json.dumps(x)}', 'array<bigint>')" for x in zip(*bounds))  # folded to one literal each
    below = f"low + step <= {len(bounds)} and (get({ids}, low + step - 1) < id or (get({ids}, low + step - 1) = id and get({cuts}, low + step - 1) < h))"
    return df.withColumn("range", F.expr(f"aggregate(array({steps}), 0, (low, step) -> if({below}, low + step, low))"))


def kmers(body: str, k: int) -> list[tuple[str, str]]:
    """(name, SQL) of the columns that lead from a text to its occurrence-numbered k-mers, one long each.

    A text is a list of items: its words, and the characters of its long words, with a blank before each, which no
    word has. A k-mer is k items from a word on, CHARS items from such a character on, whatever the rest of the text is."""
    words = ", ".join(f"get(w, i + {j})" for j in range(k))
    chars = ", ".join(f"get(w, i + {j})" for j in range(CHARS))
    blanks = SPACES.replace(chr(92), chr(92) * 2)
    at = f"sequence(0, greatest(size(w) - {k}, 0))"
    return [
        ("trimmed", f"btrim({body}, '{BLANKS}')"),
        ("w", f"if(trimmed = '', array(), split(trimmed, '{blanks}'))"),
        ("long_words", f"exists(w, x -> char_length(x) > {LONG_WORD})"),
        ("w", f"if(long_words, flatten(transform(w, x -> if(char_length(x) > {LONG_WORD}, transform(split(x, ''), c -> concat(' ', c)), array(x)))), w)"),
        ("scale", f"greatest(0, cast(ceil(log2(size(w) + 1)) as int) - {PLACE})"),
        ("s", f"""if(size(w) = 0, array(), sort_array(if(long_words,
            transform({at}, i -> (if(startswith(get(w, i), ' '), xxhash64({chars}), xxhash64({words})) & ~{LOW}L) | shiftright(cast(i as bigint), scale)),
            transform({at}, i -> (xxhash64({words}) & ~{LOW}L) | shiftright(cast(i as bigint), scale)))))"""),
        # how many equal ones stand before the i-th of a sorted list, by binary search in its run
        ("y", f"""transform(s, (v, i) -> if(i > 0 and (get(s, i - 1) & ~{LOW}L) = (v & ~{LOW}L),
            (xxhash64(v & ~{LOW}L, aggregate(sequence(cast(log2(size(s)) as int), 0, -1), 0, (r, b) ->
                if(i - r - shiftleft(1, b) >= 0 and (get(s, i - r - shiftleft(1, b)) & ~{LOW}L) = (v & ~{LOW}L), r + shiftleft(1, b), r))) & ~{LOW}L) | (v & {LOW}L), v))"""),
    ]


def _masks(n: int) -> list[int]:
    draw = random.Random(77001)
    return [(draw.getrandbits(64) - (1 << 63)) & ~LOW for _ in range(n)]


def signatures(df: DataFrame, keys: list[str], body: str, tuples: int, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """keys, keep (numbers or booleans) and sig, an array of `tuples` hashes, for each row; keys must tell rows apart.

    A tuple is the two least k-mers under one permutation, taken in text order; a lone k-mer is a tuple by itself.
    XOR with a random mask permutes hashes, and the least long carries the place of its k-mer. The least of each
    permutation comes from one pass over the k-mers, the least but it from a second, both minima that Spark
    computes in generated code; what is partitioned by one of the keys stays so.
    """
    for name, sql in kmers(body, k):
        df = df.withColumn(name, F.expr(sql))
    masks = _masks(tuples)
    flat = df.select(*keys, F.explode_outer("y").alias("y"))
    least = flat.groupBy(*keys).agg(*[F.expr(f"min(y ^ {m}L)").alias(f"a{i}") for i, m in enumerate(masks)])
    least = least.select(*keys, F.array(*[f"a{i}" for i in range(tuples)]).alias("least"))
    again = df.select(*keys, *keep, "y").join(least, keys).select(*keys, *keep, "least", F.explode_outer("y").alias("y"))
    both = again.groupBy(*keys).agg(*[F.max(c).alias(c) for c in keep], *[F.expr(x) for i, m in enumerate(masks) for x in (f"min(y ^ {m}L) as a{i}", f"min(if((y ^ {m}L) > get(least, {i}), y ^ {m}L, null)) as b{i}")])

    def one(i: int) -> str:
        a, b = (f"({x}{i} ^ {masks[i]}L)" for x in "ab")
        return f"if(a{i} is null, 0L, if(b{i} is null, xxhash64({a} & ~{LOW}L), if(({a} & {LOW}L) <= ({b} & {LOW}L), xxhash64({a} & ~{LOW}L, {b} & ~{LOW}L), xxhash64({b} & ~{LOW}L, {a} & ~{LOW}L))) & 4294967295L)"

    return both.select(*keys, *keep, F.expr(f"array({', '.join(one(i) for i in range(tuples))})").alias("sig"))


def likeness(a: str, b: str, tuples: int) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x) / {float(tuples)}D"


def text_of(sig: str) -> str:
    return f"array_join(transform({sig}, x -> lpad(lower(hex(x)), 8, '0')), '')"


def fingerprints(df: DataFrame, tuples: int = 32, k: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text is the text with its last third replaced by the start of the next document's, in
    descending key, after the last the first. K-mers are runs of k words (fewer words make one k-mer; within a word
    of more than LONG_WORD characters, as in texts without blanks, runs of CHARS characters from each of its characters
    on), numbered by occurrence, so a fingerprint tells order and repetition: its likeness to another, the share of
    equal tuples, falls with the edit distance. An edit changes the k-mers that it touches, and no others.

    Rows are dealt once into ranges of (key, hash of the text) of like size; the first row of each range also
    goes to the end of the range before it, so that the next document is always in the same partition. All that
    follows keeps that partitioning: windows, aggregates and the join of both passes need no further exchange.
    The result is a table in the shared folder.

    Null and empty texts are empty: 32 zero tuples, like each other (likeness 1). Null keys come last;
    rows of one key are ordered by a hash of the text. A lone row is its own next document. An empty
    table gives no rows. Other columns are left out. From 2 ** 24 k-mers on neighbouring places in the text are one
    place, and the order of two k-mers at one place is that of their hashes.
    """
    spark, lowest = df.sparkSession, -(2**63)
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.expr("-9223372036854775807L - 1L")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ranges = 3 * bucket_count(docs, "t", RANGE_CHARS)
    placed = with_range(docs, range_bounds(docs, ranges))
    # one row for each range: its first row, in descending key and ascending hash, and the range whose last row comes before it
    first = placed.groupBy("range").agg(F.min(F.struct((-1 - F.col("id")).alias("down"), F.col("h"))).alias("x")).select("range", F.expr("-1L - x.down").alias("head"), F.col("x.h").alias("head_h")).toArrow().sort_by("range")
    some = first.column("range").to_pylist()
    if not some:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    heads = spark.createDataFrame(list(zip(some, first.column("head").to_pylist(), first.column("head_h").to_pylist(), some[1:] + some[:1])), "range int, head long, head_h long, before int")
    places = "if(id = head and h = head_h, array(struct(range as range, false as extra), struct(before as range, true as extra)), array(struct(range as range, false as extra)))"
    dealt = placed.join(F.broadcast(heads), "range").select("id", "h", "t", F.expr(f"inline({places})")).repartition(len(some), "range")
    by = Window.partitionBy("range").orderBy("extra", F.desc("id"), "h")
    rows = dealt.select("range", "extra", "id", "t", F.char_length("t").cast("long").alias("n_chars"), F.row_number().over(by).alias("rn"), F.lead("t").over(by).alias("after"))
    third = "cast(floor(n_chars / 3) as int)"
    edited = rows.withColumn("edited", F.expr(f"concat(substring(t, 1, cast(n_chars as int) - {third}), substring(coalesce(after, ''), 1, {third}))"))
    both = edited.select("range", "rn", "extra", "id", "n_chars", F.expr("inline(if(extra, array(struct(0 as kind, t as body)), array(struct(0 as kind, t as body), struct(1 as kind, edited as body))))"))
    # an own number for each text of a range: twice its place, one more for the edited text
    both = both.withColumn("number", F.col("rn") * 2 + F.col("kind"))
    # the edited text's digest as longs of 15 hexadecimal digits at most, which aggregates hold in place
    cuts = range(1, 65, 15)
    both = both.withColumn("sha", F.expr("if(kind = 1, sha2(body, 256), null)")).select("*", *[F.expr(f"cast(conv(substring(sha, {i}, 15), 16, 10) as bigint) as sha{i}") for i in cuts]).drop("sha")
    sigs = signatures(both, ["range", "number"], "body", tuples, k, ("kind", "extra", "id", "n_chars", *[f"sha{i}" for i in cuts]))
    sigs = sigs.withColumn("sha", F.expr("concat(" + ", ".join(f"lpad(lower(hex(sha{i})), {min(15, 65 - i)}, '0')" for i in cuts) + ")"))
    along = Window.partitionBy("range").orderBy("number")
    seen = sigs.select("*", F.lead("sig").over(along).alias("edited_sig"), F.lead("sha").over(along).alias("edited_sha256"), F.lead("sig", 2).over(along).alias("next_sig"))
    out = seen.where("kind = 0 and not extra").select(
        F.expr("nullif(id, -9223372036854775807L - 1L)").alias("doc_id"), "n_chars", "edited_sha256",
        F.expr(text_of("sig")).alias("fingerprint"), F.expr(text_of("edited_sig")).alias("edited_fingerprint"),
        F.expr(likeness("sig", "edited_sig", tuples)).alias("near_edited"), F.expr(likeness("sig", "next_sig", tuples)).alias("near_next"),
    )
    before = spark.conf.get(CO_PARTITION, None)
    spark.conf.set(CO_PARTITION, "false")
    try:
        return saved(out, "fingerprints")
    finally:
        spark.conf.unset(CO_PARTITION) if before is None else spark.conf.set(CO_PARTITION, before)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))

"""Product codes of vectors: k-means in exact integers per part, entries found by Exponion search."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamwork.llm.common import batch, documents, forget, lean, saved, trim

#: Equal parts of a vector, entries of a part's codebook, rounds of k-means, steps of a component's unit.
PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Labels whose sums are broadcast have this share of all rows at least, so they are no more than its inverse.
HEAVY = 0.001
#: Rows assigned together.
AT_ONCE = 20_000


class Codebook:
    """Entries of one part, and for each the entries by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable").astype(np.int32)
        self.apart = np.take_along_axis(apart, self.order, 1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, of equally near ones the first, and its squared distance, from the row's
        entry of `before`.

        An entry nearer than that one, or as near, is at most twice as far from it as the row is; so the entries around it are
        scanned in order of their distance while its square is at most four times the row's. All in whole numbers.
        """
        best = before.astype(np.int32)
        far = ((x - self.entries[best]) ** 2).sum(1)
        # apart <= 4 * far, without leaving 64 bits
        quarter = (self.apart + 3) >> 2
        inside = np.empty(len(x), np.int32)
        for e in range(len(self.entries)):
            own = before == e
            inside[own] = np.searchsorted(quarter[e], far[own], side="right")
        rows = np.argsort(-inside, kind="stable")
        left = np.searchsorted(-inside[rows], -np.arange(len(self.entries)), side="left")  # rows that scan further than t entries
        for t in range(len(self.entries)):
            at = rows[: left[t]]
            if not len(at):
                break
            entry = self.order[before[at], t]
            d = ((x[at] - self.entries[entry]) ** 2).sum(1)
            nearer = (d < far[at]) | ((d == far[at]) & (entry < best[at]))
            at, entry, d = at[nearer], entry[nearer], d[nearer]
            best[at], far[at] = entry, d
        return best, far


def _vectors(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _round(label: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label), *T._parse_datatype_string("v array<long>, code binary, error long, part int, entry int, n long, sums array<long>").fields])


def _assigning(shared, width: int, parts: int, last: bool, schema: pa.Schema):
    """Rows with their codes under the books of `shared`, searched from the codes they have; and, per task, the number
    and the sums of the parts of each entry (rows of their own, at most entries x parts)."""
    size = width // parts

    def run(batches):
        books = [Codebook(b) for b in shared.value]
        k = len(books[0].entries) if books else 0
        many, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64)
        for whole in batches:
            for first in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(first, AT_ONCE)
                x = _vectors(b.column(2), width)
                raw = b.column(3).to_pylist()
                before = np.array([np.frombuffer(c, np.uint8) if c is not None else np.zeros(parts, np.uint8) for c in raw], np.int32).reshape(-1, parts)
                code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    own = np.ascontiguousarray(x[:, p * size : (p + 1) * size])
                    best, far = book.assign(own, before[:, p])
                    code[:, p] = best
                    error += far
                    if not last:
                        many[p] += np.bincount(best, minlength=k)
                        np.add.at(sums[p], best, own)
                none = [None] * len(x)
                yield batch(schema, b.column(0), b.column(1), b.column(2) if not last else none, [c.tobytes() for c in code], error, none, none, none, none)
        used = np.argwhere(many)
        if len(used):
            none = [None] * len(used)
            yield batch(schema, none, none, none, none, none, used[:, 0].astype(np.int32), used[:, 1].astype(np.int32), many[many > 0], [sums[p, e] for p, e in used])
        trim()

    return run


def _moved(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries moved to the floor of their parts' means; what comes to the driver is one row per used entry, whatever the rows."""
    width = books[0].shape[1]
    # sums per entry and place, exact beyond 64 bits
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = [b.copy() for b in books]
    for r in table.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code binary, error) of the vectors, and the codebooks: one array of entries per part.

    Components become floor(256 * x); a vector is cut into `parts` equal parts, each part is the nearest entry
    of its place's codebook. The books start as the parts of the `entries` least ids and move `rounds` times to the floor
    of the mean of what is nearest to them; an entry that nothing is nearest to stays. Each pass starts from the row's entry of
    the pass before and scans that entry's neighbours as far as any could be nearer (Exponion), the first pass from entry 0.
    Passes are written once, with the sums of each task beside the rows; sums meet by entry, so at most parts x
    entries rows, of a size that the vectors' width sets, reach the driver, and the books are as small.

    Vectors that are null or empty, hold null or non-finite components, or are of another than the most frequent length
    (of equally frequent ones the largest) take no part. Repeated rows count as often as they are there. A null id comes after all
    others; of equal ids the vector that is less comes first. Fewer vectors than entries give as many entries. A length that
    can't be cut into equal parts, more than 256 entries, or components so far apart that squared distances don't fit in 64
    bits raise ValueError. Other columns are left out. An empty table gives no rows and no books.
    """
    spark = df.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.where("size(x) > 0 and forall(x, y -> y is not null and not isnan(y) and abs(y) < double('infinity'))")
    widths = rows.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most"))
    found = widths.orderBy(F.desc("n"), F.desc("w")).limit(1).first()
    if found is None:
        return rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), []
    width, span = found["w"], STEPS * (found["most"] - found["least"]) + 2
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    if width * span**2 >= 2**62 or STEPS * max(abs(found["least"]), abs(found["most"])) >= 2**53:
        raise ValueError("squared distances don't fit in 64 bits")
    ints = rows.where(F.size("x") == width).select("id", "label", F.expr(f"transform(x, y -> cast(floor(y * {STEPS}D) as long))").alias("v"), F.lit(None).cast("binary").alias("code"))
    table = saved(ints, "vectors")
    first = table.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start, size = np.array([r["v"] for r in first], np.int64), width // parts
    kinds = _round(df.schema[label].dataType)
    books = [np.ascontiguousarray(start[:, p * size : (p + 1) * size]) for p in range(parts)]
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)
        now = saved(table.where("v is not null").select("id", "label", "v", "code").mapInArrow(lean(_assigning(shared, width, parts, n == rounds, to_arrow_schema(kinds))), kinds), "assigned")
        forget(table)
        table = now
        if n < rounds:
            books = _moved(table, books)
    return table.where("code is not null").select("id", "label", "code", "error"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors of all rows of its label, nulls together. The sums of the few labels with a
    thousandth of all rows or more are broadcast, so no label's rows are gathered in a task."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    total = coded.count()
    heavy = sums.where(F.col("_n") >= HEAVY * total).select(F.col("_label").alias("_heavy"), F.col("label_error").alias("_heavy_error"), F.lit(True).alias("_is"))
    marked = coded.join(F.broadcast(heavy), F.col("label").eqNullSafe(F.col("_heavy")), "left")
    light = marked.where("_is is null").join(sums.where(F.col("_n") < HEAVY * total), F.col("label").eqNullSafe(F.col("_label")))
    columns = [c for c in coded.columns]
    return marked.where("_is").select(*columns, F.col("_heavy_error").alias("label_error")).union(light.select(*columns, "label_error"))


def digest(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decode(codes: DataFrame, books: list[np.ndarray], code: str = "code", name: str = "decoded") -> DataFrame:
    """codes with a further column `name` (array<double>): the entries that the code names, as components. A null code gives null."""
    flat = F.lit([[x / STEPS for x in e] for b in books for e in b.tolist()])
    per = len(books[0]) if books else 1
    at = F.expr(f"transform(sequence(0, {len(books) - 1}), p -> p * {per} + cast(conv(hex(substring({code}, p + 1, 1)), 16, 10) as int))")
    return codes.withColumn(name, F.when(F.col(code).isNotNull(), F.flatten(F.transform(at, lambda i: F.get(flat, i)))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(documents(spark, sf_dir, "embeddings"))
    return label_errors(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Assignments by brute force: every part meets every entry."""
    size = "len(v) // 16"
    steps = [f"""
  vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  cut AS (SELECT vec_id, label, p, v[p * {size} + 1 : (p + 1) * {size}] AS own FROM vecs, range(16) r(p)),
  book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, own AS entry FROM cut WHERE vec_id IN (SELECT vec_id FROM vecs ORDER BY vec_id LIMIT 64))"""]
    for n in range(3):
        steps.append(f"""
  near{n} AS (SELECT vec_id, label, p, any_value(own) AS own, min(row(list_sum(list_transform(list_zip(own, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e)) AS best
              FROM cut JOIN book{n} USING (p) GROUP BY vec_id, label, p)""")
        if n < 2:
            steps.append(f"""
  moved{n} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM (
                SELECT p, best[2] AS e, i, sum(own[i])::BIGINT AS s, count(*) AS n FROM near{n}, range(1, 5) r(i) GROUP BY ALL) GROUP BY p, e),
  book{n + 1} AS (SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{n} b LEFT JOIN moved{n} m USING (p, e))""")
    return f"""WITH {",".join(steps)},
  coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near2 GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded"""


OP13_SQL = _sql()

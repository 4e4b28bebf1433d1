"""Product codes against k-means by brute force, in Python's whole numbers."""

import math
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.llm import catalogue, vector_codes


def coded_by_force(rows, parts=16, entries=64, rounds=2):
    """rows of (id, vector, label), all valid: ((id, label, code hex, error) of each, entries)."""
    ints = sorted(((i is None, i or 0, [math.floor(256 * x) for x in v]), i, label) for i, v, label in rows)
    size = len(ints[0][0][2]) // parts
    books = [[k[2][p * size : (p + 1) * size] for k, _, _ in ints[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for k, _, _ in ints:
                x = k[2][p * size : (p + 1) * size]
                own.setdefault(near(p, x)[1], []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*own[j])] if j in own else e for j, e in enumerate(books[p])]
    out = []
    for k, i, label in ints:
        best = [near(p, k[2][p * size : (p + 1) * size]) for p in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    return out, books


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_the_table_is_coded_as_by_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, books = coded_by_force(rows)
    got = catalogue.queries()["op13_vector_codes"](spark, sf).collect()
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert order((r.vec_id, r.code, r.error, r.label_error) for r in got) == order((i, c, e, sums[label]) for i, label, c, e in want)
    assert {r.codebooks_sha256 for r in got} == {sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=12), st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=30), st.integers(0, 1000))
def test_exponion_finds_the_first_nearest_entry_from_any_start(entries, rows, seed):
    """Few values: many ties, equal entries too."""
    book, x = vector_codes.Codebook(np.array(entries, np.int64)), np.array(rows, np.int64)
    before = np.random.default_rng(seed).integers(0, len(entries), len(x))
    best, far = book.assign(x, before)
    every = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
    assert best.tolist() == every.argmin(1).tolist() and far.tolist() == every.min(1).tolist()


def test_only_entries_inside_the_radius_are_scanned(monkeypatch):
    """Two far groups of entries: rows that start at the right one look at its group only."""
    entries = np.array([[i, j] for i in (0, 10_000) for j in range(32)], np.int64)
    book = vector_codes.Codebook(entries)
    quarter = (book.apart + 3) >> 2
    assert (np.searchsorted(quarter[5], 9, side="right")) < 14  # squared distance 9: entries up to 6 away
    best, far = book.assign(np.array([[3, 5], [10_000, 40]]), np.array([5, 63]))
    assert best.tolist() == [5, 63] and far.tolist() == [9, 81]


@pytest.mark.parametrize("parts,entries,rounds", [(2, 5, 2), (1, 3, 1), (4, 64, 3)])
def test_odd_vectors(spark, parts, entries, rounds):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=4).round(2)], f"l{i % 3}" if i % 4 else None) for i in range(60)]
    rows += [(3, rows[3][1], "l0")] * 4 + [(7, [0.5, -0.5, 0.25, 0.0], "l1"), (None, [1.0, 2.0, 3.0, -4.0], "l2"), (99, [0.0] * 4, None)]
    odd = [(200, None, "l1"), (-5, [1.0, None, 0.0, 0.0], "l1"), (-4, [float("nan")] * 4, "l1"), (-3, [float("inf")] * 4, None), (-2, [1.0], "l1"), (-1, [], "l1")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string").withColumn("code", F.lit(1)).withColumn("v", F.lit("x")).withColumn("part", F.lit(0)).withColumn("error", F.lit(3))
    coded, books = vector_codes.encode(df, parts=parts, entries=entries, rounds=rounds)
    want, plain = coded_by_force(rows, parts, entries, rounds)
    assert order((r.id, r.label, r.code.hex(), r.error) for r in coded.collect()) == order(want)
    assert [b.tolist() for b in books] == plain
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert {(r.label, r.label_error) for r in vector_codes.label_errors(coded).collect()} == set(sums.items())
    size = 4 // parts
    back = [r.decoded for r in vector_codes.decode(coded, books).where("id = 99").collect()]
    code = next(bytes.fromhex(c) for i, _, c, _ in want if i == 99)
    assert back == [[x / 256 for p in range(parts) for x in plain[p][code[p]]]] and len(back[0]) == size * parts


def test_rare_labels_beside_a_frequent_one(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HEAVY", 0.3)
    df = spark.createDataFrame([(i, None if i < 50 else i % 7, i) for i in range(100)], "id long, label long, error long")
    sums = {}
    for r in df.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    got = vector_codes.label_errors(df).collect()
    assert len(got) == 100 and all(r.label_error == sums[r.label] for r in got)


def test_what_cannot_be_coded(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode(df, parts=2)
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.encode(spark.createDataFrame([(1, [1e30, -1e30], 0)], df.schema), parts=2)
    with pytest.raises(ValueError, match="one byte"):
        vector_codes.encode(df, entries=300)
    coded, books = vector_codes.encode(df.where("false"))
    assert books == [] and vector_codes.label_errors(coded).count() == 0

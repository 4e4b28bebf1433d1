"""Quality classifier: EM over heuristic labellers, then a hashed linear scorer on posterior labels."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import batch, blocks, documents, lean, trim
from loamwork.llm.weak import LabelModel, feature, fit_linear

SIZE = 1 << 16
#: The scorer is fitted on about this many rows at most, those with the least hash; equal rows of one key are one.
FIT_ROWS = 12_000
TRAITS = ("repeats", "distinct", "bigrams", "upper", "symbols", "lines", "letters", "ends", "marked", "length")

def _kind_of(c: str) -> int:
    """0 white space, 1 lower or caseless letter, 2 capital, 3 digit, 4 stop or quote, 5 other."""
    return 0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:'\"?-()、。「」，！？：；" else 5


_KIND = np.array([_kind_of(chr(c)) for c in range(0x3000)], np.uint8)


def kinds_of(code: np.ndarray) -> np.ndarray:
    """The kind of each code point."""
    out = _KIND[np.minimum(code, len(_KIND) - 1)]
    high = code >= len(_KIND)
    if high.any():
        some, at = np.unique(code[high], return_inverse=True)
        out[high] = np.array([_kind_of(chr(c)) for c in some.tolist()], np.uint8)[at]
    return out


_ENDS = frozenset(".,;:'\"?-()!»”’…")


def traits(text: str | None) -> tuple[list[str], dict[str, float]]:
    """A text's words and the shares that labellers look at; 0 words give neutral shares."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return words, dict.fromkeys(TRAITS, 0.0) | {"distinct": 1.0, "letters": 1.0}
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(kinds_of(code), minlength=6)
    solid = max(1, int(kinds[1:].sum()))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return words, {
        "repeats": sum(map(str.__eq__, words, words[1:])) / n,
        "distinct": len(set(words)) / n,
        "bigrams": 1 - len(set(zip(words, words[1:]))) / max(1, n - 1),
        "upper": kinds[2] / max(1, kinds[1] + kinds[2]),
        "symbols": kinds[5] / solid,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters": (kinds[1] + kinds[2]) / solid,
        "ends": sum(w[-1] in ".!?" for w in words) / n,
        "marked": sum(not w[-1].isalnum() and w[-1] not in _ENDS for w in words) / n,
        "length": min(1.0, sum(map(len, words)) / n / 20),
    }


#: (polarity, test): 1 speaks for bad quality, -1 against it.
LABELLERS = (
    (1, lambda n, t: n >= 8 and t["repeats"] >= 0.2),
    (1, lambda n, t: n >= 20 and t["distinct"] < 0.35),
    (1, lambda n, t: n >= 20 and t["bigrams"] >= 0.4),
    (1, lambda n, t: n >= 8 and t["upper"] >= 0.35),
    (1, lambda n, t: t["symbols"] >= 0.08),
    (1, lambda n, t: t["lines"] >= 0.5),
    (1, lambda n, t: n >= 8 and t["letters"] < 0.88),
    (1, lambda n, t: n >= 8 and t["marked"] >= 0.2),
    (1, lambda n, t: n >= 20 and not 0.01 <= t["ends"] <= 0.45),
    (-1, lambda n, t: 0.02 <= t["ends"] <= 0.3 and t["symbols"] < 0.03 and t["upper"] < 0.12),
    (-1, lambda n, t: t["distinct"] >= 0.45 and t["repeats"] < 0.1 and t["marked"] < 0.1),
    (-1, lambda n, t: t["upper"] < 0.12 and t["symbols"] < 0.03 and t["bigrams"] < 0.3),
)


def votes(n: int, t: dict[str, float]) -> int:
    return sum(1 << i for i, (_, test) in enumerate(LABELLERS) if test(n, t))


_RUN = re.compile(r"(.)\1+")


class _Marks(dict):
    """For str.translate: a, A or 0 for each letter or digit, other characters as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        x = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return x


_MARKS = _Marks()


def shape(word: str) -> str:
    """a for lower-case, A for capital letters, 0 for digits; runs of one kind become one character."""
    return _RUN.sub(r"\1", word.translate(_MARKS))


@lru_cache(50_000)
def _of_marks(marks: str) -> int:
    return feature("s:" + _RUN.sub(r"\1", marks), SIZE)


@lru_cache(50_000)
def _of_edge(edge: str) -> int:
    return feature(edge, SIZE)


def _forget() -> None:
    """Empties the tables of hashed(), so that idle Python workers stay small."""
    _of_marks.cache_clear()
    _of_edge.cache_clear()


def hashed(word: str) -> tuple[int, int, int, int]:
    """Hashed features of a word: its shape, itself in lower case, its first and last three characters."""
    low = word.lower()
    marks = word.translate(_MARKS)
    return (_of_marks if len(marks) <= 64 else _of_marks.__wrapped__)(marks), feature("w:" + low, SIZE), _of_edge("3:" + low[:3]), _of_edge("e:" + low[-3:])


class _Shapes(dict):
    """Hashed features of each word, bounded like WordHash."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        x = self[word] = hashed(word)
        return x


class _Worth(dict):
    """The sum of the weights of each word's hashed features; bounded like _Shapes."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights.tolist(), most
        self.steps = {name: [self.weights[feature(f"t:{name}:{k}", SIZE)] for k in range(11)] for name in TRAITS}

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        weights, (a, b, c, d) = self.weights, hashed(word)
        x = self[word] = weights[a] + weights[b] + weights[c] + weights[d]
        return x


def worth(words: list[str], t: dict[str, float], by_word: _Worth) -> float:
    """What a text's features, as features() has them, add up to under the weights: word by word, none is counted."""
    own = 3 * sum(map(by_word.__getitem__, words)) / max(1, len(words))
    return own + sum(by_word.steps[name][min(10, int(t[name] * 10))] for name in TRAITS)


def features(words: list[str], t: dict[str, float], shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, words and character n-grams at their edges, and traits in ten steps each."""
    flat = np.fromiter(chain.from_iterable(map(shapes.__getitem__, words)), np.int32, 4 * len(words))
    f, n = np.unique(flat, return_counts=True)
    steps = [feature(f"t:{name}:{min(10, int(t[name] * 10))}", SIZE) for name in TRAITS]
    return np.r_[f, np.array(steps, np.int32)].astype(np.int32), np.r_[3 * n / max(1, len(words)), np.ones(len(steps))].astype(np.float32)


def unpacked(packed: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Votes and (features, amounts) of the sample's rows, in an order that doesn't depend on how they were dealt.

    Rows are views of a block's arrays, 6 bytes a cell."""
    unpack, found = pa.Codec("zstd").decompress, []
    for fired, sizes, own, amounts in packed:
        fired, sizes = np.frombuffer(fired, np.int32), np.frombuffer(sizes, np.int32)
        ends = np.cumsum(sizes)
        cells = int(sizes.sum())
        f, v = np.frombuffer(unpack(own, 2 * cells, asbytes=True), np.uint16), np.frombuffer(unpack(amounts, 4 * cells, asbytes=True), np.float32)
        for vote, a, z in zip(fired.tolist(), ends - sizes, ends):
            found.append((vote, hashlib.md5(f[a:z].tobytes() + v[a:z].tobytes()).digest(), f[a:z], v[a:z]))
    found.sort(key=lambda r: r[:2])
    return np.array([r[0] for r in found], np.int64), [r[2:] for r in found]


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> dict:
    """The scorer: weights, bias, and the label model behind them.

    Labellers vote on every row; votes are counted by pattern in Spark (at most 2 ** 12 patterns) and EM
    estimates labeller accuracies from these counts over the whole table. The linear scorer is fitted to
    the posteriors of a bounded sample, the rows of least hash, about fit_rows of them, of which equal rows of one key
    come once however often they occur; they come to the driver packed, a row for each block of texts.
    """
    docs = df.select(F.col(text).alias("text_body"), F.xxhash64(key, text).alias("h"))
    total = docs.count()
    share = min(1.0, fit_rows / max(1, total))
    edge = int(share * 2**40)
    schema = pa.schema([(name, pa.binary()) for name in ("votes", "sizes", "features", "amounts")])

    def vote(batches):
        out = pa.schema([("votes", pa.int32())])
        for rows in blocks(batches, 2_000_000, "text_body"):
            found = (traits(x) for x in rows["text_body"])
            yield batch(out, [votes(len(w), t) for w, t in found])

    def sample(batches):
        shapes, pack = _Shapes(), pa.Codec("zstd", 3).compress
        for rows in blocks(batches, 2_000_000, "text_body"):
            fired, own, amounts = [], [], []
            for x in rows["text_body"]:
                w, t = traits(x)
                f, v = features(w, t, shapes)
                fired.append(votes(len(w), t))
                own.append(f.astype(np.uint16))
                amounts.append(v)
            yield batch(schema, [np.array(fired, np.int32).tobytes()], [np.array([len(f) for f in own], np.int32).tobytes()],
                        [pack(np.concatenate(own).tobytes(), asbytes=True)], [pack(np.concatenate(amounts).tobytes(), asbytes=True)])
        _forget()

    counts = np.zeros(2 ** len(LABELLERS))
    for r in docs.select("text_body").mapInArrow(lean(vote), "votes int").groupBy("votes").count().collect():
        counts[r["votes"]] = r["count"]
    labels = LabelModel([p for p, _ in LABELLERS], silence=False).fit(counts)
    posterior = labels.posterior()
    parts = max(1, min(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = docs.where(F.pmod("h", F.lit(2**40)) < edge).groupBy("h").agg(F.first("text_body").alias("text_body")).select("text_body").repartition(parts)
    packed = some.mapInArrow(lean(sample), "votes binary, sizes binary, features binary, amounts binary").collect()
    fired, rows = unpacked(packed)
    del packed
    weights, bias = fit_linear(rows, posterior[fired], SIZE, l1=1e-5)
    del rows
    trim()
    return {"weights": weights.astype(np.float32), "bias": bias, "labels": labels}


def scorer(spark: SparkSession, model: dict):
    """A column function: probability that a text is of good quality."""
    shared = spark.sparkContext.broadcast((model["weights"], model["bias"]))

    @F.pandas_udf("double")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        by_word = _Worth(weights)
        for texts in batches:
            out = np.array([bias + worth(*traits(x), by_word) for x in texts])
            yield pd.Series(1 / (1 + np.exp(np.clip(out, -40, 40))))
            trim()
        by_word.clear()
        _forget()
        trim()

    return good


def classify(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, quality_score, predicted (1 good, 0 bad) of each row.

    Score: 1 - the linear scorer's probability of bad quality; predicted is 1 from `least` on. Null,
    empty and blank texts have no words, fire no labeller for bad quality and are scored by that; texts
    of any length are read whole; equal texts get equal scores; null keys are kept. An empty table gives
    no rows. Other columns are left out.
    """
    if not df.columns:
        raise ValueError("no columns")
    good = scorer(df.sparkSession, fit(df, text, key, fit_rows))
    return df.select(F.col(key).alias("doc_id"), good(F.col(text)).alias("quality_score")).withColumn("predicted", (F.col("quality_score") >= least).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))

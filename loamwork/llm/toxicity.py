"""Toxicity: a label model over lexicon and pattern voters, then a linear classifier on its posteriors."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import batch, blocks, documents, lean, saved, trim
from loamwork.llm.weak import LabelModel, feature, fit_linear

SIZE = 1 << 18
#: The classifier is fitted on this many rows at most, those of least hash: LABELLED of them with a label (the induced
#: lexicons' rows), the others without; where one kind is short, fewer.
FIT_ROWS, LABELLED = 12_000, 0.75
#: Entries of the induced lexicons together, at most.
INDUCED = 600

# Words that insult.
INSULTS = "idiot idiots moron morons stupid dumb fool imbecile cretin dimwit".split()
CONTEMPT = "loser losers pathetic worthless clown trash garbage scum disgusting filth vermin".split()
HOSTILE = "hate despise shut kill die hell damn bastard bitch crap".split()
FOREIGN = "idiota estupido estúpido imbécil tonto basura asqueroso idiote stupide connard salaud ordure dumm dummkopf trottel abschaum müll ekelhaft".split()
_LISTS = [frozenset(x) for x in (INSULTS, CONTEMPT, HOSTILE, FOREIGN)]
_AIMED = re.compile(r"\b(?:you|your|he|she|they|it|is|are)\b(?:\s+\w+){0,2}?\s+(?:" + "|".join(INSULTS + CONTEMPT) + r")\b")
_WORDS = re.compile(r"\w+")
_SHOUT = re.compile(r"!{2,}|\b[A-Z]{4,}\b")
#: Voters: the four lists, two hits of any, aimed insult, shouting, four induced lexicons, three hits of these.
POLARITY = [1] * 12


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, its first 4 and 5 letters."""
    f = [feature("w:" + word, SIZE)]
    if len(word) > 4:
        f.append(feature("4:" + word[:4], SIZE))
    if len(word) > 5:
        f.append(feature("5:" + word[:5], SIZE))
    return f


class _Words(dict):
    """What `of` says of each word; forgets all beyond `most` words."""

    def __init__(self, of, most: int = 200_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        x = self[word] = self.of(word)
        return x


def marks(induced: frozenset):
    """Of a word: bits of the lists that have it, and its induced lexicon's number + 1 or 0; None for neither."""

    def of(word: str):
        lists = sum(1 << i for i, x in enumerate(_LISTS) if word in x)
        hit = next((1 + x % 4 for x in word_features(word) if x in induced), 0)
        return (lists, hit) if lists or hit else None

    return of


def distinct(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def votes(text: str | None, words: set[str], table: _Words) -> int:
    """Bits of the voters that fire; table is of marks."""
    hits, induced, out = 0, [0, 0, 0, 0], 0
    for mark in filter(None, map(table.__getitem__, words)):
        lists, hit = mark
        if lists:
            hits += 1
            out |= lists
        if hit:
            induced[hit - 1] += 1
    out |= (hits >= 2) << 4
    if hits:
        out |= (_AIMED.search(text.lower()) is not None) << 5
    out |= (bool(text) and len(_SHOUT.findall(text)) * 20 >= len(words)) << 6
    for i, n in enumerate(induced):
        out |= (n > 0) << (7 + i)
    return out | (sum(induced) >= 3) << 11


def features(words: set[str], table: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct words per hashed feature, 3 at most; table is of word_features."""
    flat = np.fromiter(chain.from_iterable(map(table.__getitem__, words)), np.int32)
    f, n = np.unique(flat, return_counts=True)
    return f, np.minimum(n, 3).astype(np.uint8)


def induce(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> frozenset:
    """Features that labelled toxic rows have far oftener than others: the induced lexicons, split by number."""
    seen = [np.bincount(np.concatenate([f for (f, _), y in zip(rows, label) if y == k] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=SIZE) for k in (0, 1)]
    n = [max(1, int((label == k).sum())) for k in (0, 1)]
    ratio = (seen[1] / n[1]) / ((seen[0] + 0.5) / n[0])
    good = np.flatnonzero((seen[1] >= 3) & (ratio >= 8))
    best = good[np.lexsort((good, -ratio[good] * np.sqrt(seen[1][good])))][:INDUCED]
    return frozenset(int(x) for x in best)


def fit(df: DataFrame, labels: DataFrame, learn: str, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> dict:
    """The classifier's weights, bias and label model.

    Only labels of rows for which SQL `learn` holds are read. A bounded sample, three quarters labelled rows and one quarter
    rows without a label, both by least hash, is what the classifier is fitted to, a text an id, of least hash; its
    labelled rows give the induced lexicons. All voters vote once on all rows for which `learn` holds, labelled or not; counts by pattern and label,
    at most 3 * 2 ** 12, go to EM. The target of every sampled row is its posterior by its votes, to which a label
    adds its own evidence.
    """
    spark = df.sparkSession
    docs = df.where(learn).select(F.col(key).alias("id"), F.col(text).alias("text_body"), F.xxhash64(text).alias("h"))
    named = labels.select(F.col("doc_id").alias(key), "toxic")
    known = named.where(learn).where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max("toxic").alias("toxic"))
    # at most fit_rows ids and labels
    ids = docs.select("id").where("id is not null").distinct().join(known, "id", "left")
    some = int(fit_rows * LABELLED)
    chosen = saved(ids.where("toxic is not null").orderBy(F.xxhash64("id"), "id").limit(some).union(ids.where("toxic is null").orderBy(F.xxhash64("id"), "id").limit(fit_rows - some)), "chosen")
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("toxic", pa.int32()), ("features", pa.binary()), ("amounts", pa.binary())])

    def sample(batches):
        table = _Words(word_features)
        for rows in blocks(batches, 2_000_000, "text_body"):
            out = []
            for i, h, y, x in zip(rows["id"], rows["h"], rows["toxic"], rows["text_body"]):
                f, v = features(distinct(x), table)
                out.append((i, h, y, f.tobytes(), v.tobytes()))
            yield batch(schema, *zip(*out))

    # at most fit_rows ids and labels are broadcast; a row of each id comes back, however many it has
    parts = max(1, min(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    one = docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("toxic").cast("int").alias("toxic"), F.min(F.struct("h", "text_body")).alias("x"))
    one = one.select(F.col("id").cast("long"), F.col("x.h").alias("h"), "toxic", F.col("x.text_body").alias("text_body")).repartition(parts)
    got = one.mapInArrow(lean(sample), "id long, h long, toxic int, features binary, amounts binary").collect()
    got.sort(key=lambda r: r["id"])
    rows = [(np.frombuffer(r["features"], np.int32), np.frombuffer(r["amounts"], np.uint8)) for r in got]
    label = np.array([-1 if r["toxic"] is None else r["toxic"] > 0 for r in got], int)
    induced = induce(rows, label)
    shared = spark.sparkContext.broadcast(induced)

    def vote(batches):
        table = _Words(marks(shared.value))
        out = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("votes", pa.int32())])
        for r in blocks(batches, 2_000_000, "text_body"):
            yield batch(out, r["id"], r["h"], [votes(x, distinct(x), table) for x in r["text_body"]])

    counts = np.zeros((3, 2 ** len(POLARITY)))
    polled = saved(docs.select(F.col("id").cast("long"), "h", "text_body").mapInArrow(lean(vote), "id long, h long, votes int"), "votes")
    for r in polled.join(known, "id", "left").groupBy("votes", "toxic").count().collect():
        counts[0 if r["toxic"] is None else 1 + (r["toxic"] > 0), r["votes"]] += r["count"]
    model = LabelModel(POLARITY, prior=0.12, trust=0.999).fit(*counts)

    trust = np.log(model.trust / (1 - model.trust))
    believed = {y: model.posterior(e) for y, e in ((-1, 0.0), (0, -trust), (1, trust))}
    # the votes of each sampled id's own text: ids and hashes, at most fit_rows, are broadcast
    read = spark.createDataFrame([(r["id"], r["h"]) for r in got], "id long, h long")
    own = {r["id"]: r["votes"] for r in polled.join(F.broadcast(read), ["id", "h"]).groupBy("id").agg(F.min("votes").alias("votes")).collect()}
    target = np.array([believed[int(y)][own[r["id"]]] for r, y in zip(got, label)])
    # a strong penalty picks the features, a weak one fits their weights
    picked = fit_linear(rows, target, SIZE, l1=2e-3)[0] != 0
    rows = [(f[picked[f]], v[picked[f]]) for f, v in rows]
    weights, bias = fit_linear(rows, target, SIZE, l1=1e-4)
    return {"weights": weights.astype(np.float32), "bias": bias, "labels": model}


def scorer(spark: SparkSession, model: dict):
    """A column function: probability that a text is toxic."""
    weights = model["weights"]
    used = np.flatnonzero(weights)
    shared = spark.sparkContext.broadcast((dict(zip(used.tolist(), weights[used].tolist())), model["bias"]))

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        own, bias = shared.value
        table = _Words(lambda word: [f for f in word_features(word) if f in own])
        out = np.empty(len(texts))
        for i, x in enumerate(texts):
            count: dict[int, int] = {}
            for f in chain.from_iterable(filter(None, map(table.__getitem__, distinct(x)))):
                count[f] = count.get(f, 0) + 1
            out[i] = bias + sum(own[f] * min(n, 3) for f, n in sorted(count.items()))
        trim()
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return toxic


def classify(df: DataFrame, labels: DataFrame, held_out: str, text: str = "text", key: str = "doc_id", least: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `least` on) of each row.

    A score depends on the text alone; held_out is SQL of the rows that nothing is learned from. Null,
    empty and blank texts have no words and get the score of the bias; texts of any length are read
    whole; equal texts get equal scores; null keys are kept, and their votes counted, but the sample has none of them;
    of several rows of one key the sample has one. Without labels the score is that of a model without features. Repeated labels of one id count once, the
    greater. An empty table gives no rows. Other columns are left out.
    """
    toxic = scorer(df.sparkSession, fit(df, labels, f"not coalesce({held_out}, false)", text, key, fit_rows))
    scored = df.select(F.col(key).alias("doc_id"), F.expr(f"coalesce({held_out}, false)").alias("held_out"), toxic(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 3 = 1")

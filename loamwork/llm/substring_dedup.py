"""Substring dedup: Rabin-Karp hashes of all word windows, counted over the corpus; repeats are cut out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.common import WordHash, batch, blocks, bucket_count, documents, fresh, lean, rolling, trim, words_of

#: Stands for a null key in comparisons: below all others.
NO_KEY = -(2**63)
_DEALT = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("digests", pa.binary()), ("runs", pa.binary()), ("gaps", pa.binary())])


def _planes(x: np.ndarray) -> bytes:
    """uint32 values, byte by byte of their width: small values compress well in the exchange."""
    return np.ascontiguousarray(x.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def windows(texts: list[list[bytes]], size: int, hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and start of each window of `size` words that lies within one text."""
    n = np.array([len(w) for w in texts])
    flat = np.concatenate([hashes.array(w) for w in texts]) if len(texts) else np.zeros(0, np.uint64)
    all_ = rolling(flat, size)
    many = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return all_[np.repeat(np.cumsum(n) - n, many) + start], doc, start


def _pack(bucket, h, ids, digests, doc, start):
    """One bucket's windows, in order of text and start: hashes, texts with their number of windows, gaps of starts."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    gap = np.diff(start, prepend=0)
    gap[first] = start[first]
    own = doc[first]
    return bucket, h.tobytes() if h is not None else None, ids[own].tobytes(), digests[own].tobytes(), _planes(np.diff(np.r_[first, len(doc)])), _planes(gap)


def _unpack(ids: bytes, digests: bytes, runs: bytes, gaps: bytes):
    runs, total = _unplaned(runs), np.cumsum(_unplaned(gaps).astype(np.int64))
    ends = np.cumsum(runs, dtype=np.int64)
    start = total - np.repeat(np.r_[0, total[ends[:-1] - 1]], runs)
    return np.repeat(np.frombuffer(ids, np.int64), runs), np.repeat(np.frombuffer(digests, np.int64), runs), start


def deal(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Windows by hash bucket, packed by block of documents. Within a block, only a window's first
    start goes by its hash; later ones are known to repeat and go on as such (hashes null)."""

    def run(batches):
        hashes = WordHash()
        for rows in blocks(batches, 4_000_000, "text_body"):
            raw = {(i, d): t for i, d, t in zip(rows["id"], rows["digest"], rows["text_body"]) if t}
            keys = sorted(raw)
            if not keys:
                continue
            ids, digests = np.array(keys, np.int64).T.copy()
            h, doc, start = windows([words_of(raw[k]) for k in keys], size, hashes)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            again = np.r_[False, h[order[1:]] == h[order[:-1]]]
            out = []
            if again.any():
                at = np.sort(order[again])
                out.append(_pack(int(abs(int(digests[doc[at[0]]])) % buckets), None, ids, digests, doc[at], start[at]))
            at = np.sort(order[~again])
            into = (h[at] >> np.uint64(20)) % np.uint64(buckets)
            at, into = at[order := np.argsort(into, kind="stable")], into[order]
            edge = np.flatnonzero(np.r_[True, into[1:] != into[:-1], True])
            out += [_pack(int(into[a]), h[at[a:b]], ids, digests, doc[at[a:b]], start[at[a:b]]) for a, b in zip(edge, edge[1:])]
            yield batch(_DEALT, *zip(*out))

    return docs.mapInArrow(lean(run), "bucket int, hashes binary, ids binary, digests binary, runs binary, gaps binary")


def _by_text_bucket(ids, digests, start, buckets: int):
    """Windows known to repeat, packed by bucket of their text."""
    if not len(ids):
        return []
    to = ((digests.astype(np.uint64) ^ (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(16)) % np.uint64(buckets)
    order = np.lexsort((start, digests, ids, to))
    ids, digests, start, to = ids[order], digests[order], start[order], to[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])]
    doc, first = np.cumsum(new) - 1, np.flatnonzero(new)
    edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    return [_pack(int(to[a]), None, ids[first], digests[first], doc[a:b], start[a:b]) for a, b in zip(edge, edge[1:])]


def _repeats(packed: list[tuple]):
    """Texts and starts of the windows whose hash also starts earlier, of one bucket's packed (hashes, ids, digests,
    runs, gaps). Hashes alone are held of all windows; texts and starts are unpacked of those that repeat."""
    h = np.concatenate([np.frombuffer(x[0], np.uint64) for x in packed])
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    met = np.zeros(len(h), bool)
    met[order[np.r_[False, same] | np.r_[same, False]]] = True
    del order, same
    found, a = [], 0
    for hashes, *rest in packed:
        z = a + len(hashes) // 8
        own = met[a:z]
        if own.any():
            found.append((h[a:z][own], *(x[own] for x in _unpack(*rest))))
        a = z
    if not found:
        return None
    h, ids, digests, start = (np.concatenate(x) for x in zip(*found))
    at = np.lexsort((start, digests, ids, h))
    first = np.r_[True, h[at][1:] != h[at][:-1]]
    lead = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
    at = at[(ids[at] != ids[lead]) | (digests[at] != digests[lead]) | (start[at] != start[lead])]
    return ids[at], digests[at], start[at]


def repeated(dealt: DataFrame, buckets: int) -> DataFrame:
    """The windows whose hash also starts earlier, packed by bucket of their text."""

    def run(table: pa.Table) -> pa.Table:
        known, packed = [], []
        for r in table.to_batches():
            for h, *rest in zip(*(c.to_pylist() for c in r.columns[1:])):
                if h is None:
                    known.append(_unpack(*rest))
                else:
                    packed.append((h, *rest))
        if packed and (found := _repeats(packed)):
            known.append(found)
        packed = None
        out = _by_text_bucket(*(np.concatenate(x) for x in zip(*known)), buckets) if known else []
        known = None
        trim()
        return pa.Table.from_batches([batch(_DEALT, *(zip(*out) if out else [()] * 6))])

    return dealt.groupBy("bucket").applyInArrow(run, "bucket int, hashes binary, ids binary, digests binary, runs binary, gaps binary")


def intervals(start: np.ndarray, size: int) -> np.ndarray:
    """Maximal removal intervals [from, to) of word positions that windows at these ascending starts cover, flat."""
    if not len(start):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(start) > size)
    return np.stack([start[np.r_[0, cut + 1]], start[np.r_[cut, len(start) - 1]] + size], 1).astype(np.int64).ravel()


def removals(found: DataFrame, size: int) -> DataFrame:
    """(id, digest, spans): one row per text that loses words, with its removal intervals."""

    def run(table: pa.Table) -> pa.Table:
        ids, digests, start = (np.concatenate(x) for x in zip(*(_unpack(*r) for r in zip(*(table.column(n).to_pylist() for n in ("ids", "digests", "runs", "gaps"))))))
        order = np.lexsort((start, digests, ids))
        ids, digests, start = ids[order], digests[order], start[order]
        edge = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1]), True])
        spans = [intervals(start[a:b], size).tobytes() for a, b in zip(edge, edge[1:])]
        return pa.table({"id": pa.array(ids[edge[:-1]]), "digest": pa.array(digests[edge[:-1]]), "spans": pa.array(spans, pa.binary())})

    return found.groupBy("bucket").applyInArrow(run, "id long, digest long, spans binary")


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType())])


#: Texts that are cut together.
CUT_ROWS = 1_000


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, raw in zip(texts, spans):
        words = words_of(t)
        pairs, left, at = np.frombuffer(raw or b"", np.int64).reshape(-1, 2).tolist(), [], 0
        for a, b in pairs:
            left += words[at:a]
            at = b
        left += words[at:]
        out.append((len(words), len(words) - len(left), pairs, b" ".join(left).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=_CUT.names)


def with_cuts(df: DataFrame, size: int = 20, text: str = "text", key: str = "doc_id", name: str = "_cut") -> DataFrame:
    """df with a struct column: n_words, n_removed, spans, kept of each row's text; see cut_repeats.

    The text meets its removal intervals in one join; that is its only exchange.
    """
    id_, digest = fresh(df, "cut_id"), fresh(df, "cut_digest")
    own = df.withColumns({id_: F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)), digest: F.xxhash64(text)})
    docs = own.select(F.col(id_).alias("id"), F.col(digest).alias("digest"), F.col(text).alias("text_body"))
    buckets = bucket_count(docs, "text_body")
    spans = fresh(own, "cut_spans")
    marks = removals(repeated(deal(docs, size, buckets), buckets), size).select(F.col("id").alias(id_), F.col("digest").alias(digest), F.col("spans").alias(spans))

    @F.pandas_udf(_CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            for a in range(0, len(texts), CUT_ROWS):
                yield _cut(texts[a : a + CUT_ROWS], spans[a : a + CUT_ROWS])
                trim()

    cut = cut.asNondeterministic()  # else a filter on its result runs it again, in a second Python worker
    return own.join(marks, [id_, digest], "left").withColumn(name, cut(F.col(text), F.col(spans))).select(*df.columns, name)


def cut_repeats(df: DataFrame, size: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, spans, n_removed, kept): each row's text without the words of windows that start earlier too.

    A window is `size` consecutive words of one text; it is removed if its words also start at a smaller
    key, or earlier in the same text, judged on the input. Windows are told apart by a 64-bit Rabin-Karp
    hash over 64-bit word hashes. Each block of documents sends a window's first start to the hash's
    bucket, so a window that a third of all texts hold comes once per block; the bucket marks all starts
    but the first. Marked windows merge into maximal intervals per text (spans, of word positions);
    kept is the other words, joined by one space.

    A null or empty text has no words (kept empty), fewer than `size` words no windows. A null key comes
    before all others; different texts under one key are ordered by a hash of the text; equal rows are
    one document and get equal results. An empty table gives no rows. Other columns are left out.
    """
    rows = with_cuts(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text_body")), size, "text_body", "doc_id")
    return rows.select("doc_id", "_cut.n_words", "_cut.spans", "_cut.n_removed", "_cut.kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM w, unnest(range(1, len(ws) - 18)) t(i)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at_word FROM win WHERE r > 1),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS at_word, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY at_word) AS text FROM words ANTI JOIN gone USING (doc_id, at_word) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

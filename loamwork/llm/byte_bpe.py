"""Byte-level BPE: encoding by corpus-level merge replay, and decoding."""

from __future__ import annotations

import base64
import heapq
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.common import batch, blocks, bucket_count, documents, fresh, lean, saved_by, trim

_IDS = pa.list_(pa.int32())
#: Codes from here on stand for pieces that are no tokens.
HOLE = 1 << 24
#: Characters of a block of documents, and bytes of pieces that are replayed together, about.
BLOCK_CHARS, REPLAY_BYTES = 24_000_000, 1_500_000
#: Codes of a block that are filled together, about.
FILL_CODES = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Merges:
    """All pairs of tokens that together are a token, and that token's rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = {
            ranks[t[:i]] << 20 | ranks[t[i:]]: r
            for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        self.one = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what adjacent tokens form, -1 for nothing."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


#: An index entry of fewer positions than this is merged one by one, not as an array.
FEW = 40


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Token ids of each word as int32 bytes, all words at once.

    The words lie in one linked list of tokens, at first single bytes. An inverted index has, for each
    rank that some adjacent pair forms, the positions of those pairs. Ranks are taken in order; each of
    a rank's positions merges, left to right, and only the pairs with its two neighbours enter the index
    anew. Words don't touch, so this is each word's own lowest-rank-first order. While ranks have many
    positions they are merged as arrays, later one by one.
    """
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    tok = merges.one[np.frombuffer(b"".join(words), np.uint8)]
    n = len(tok)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    some = size > 0
    prv[start[some]] = -1
    nxt[(start + size - 1)[some]] = -1
    rank = np.full(n, -1, np.int64)  # of the pair that starts here
    inner = np.flatnonzero(nxt >= 0)
    rank[inner] = merges.of(tok[inner], tok[inner + 1])

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        r = rank[at]
        at, r = at[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]).tolist() if len(r) else [0]
        for a, b in zip(edge, edge[1:]):
            if (x := int(r[a])) in index:
                index[x].append(at[a:b])
            else:
                index[x] = [at[a:b]]
                heapq.heappush(heap, x)

    add(inner)
    small = 0
    while heap and small < 24:
        r = heap[0]
        parts = index[r]
        if sum(map(len, parts)) < FEW:
            small += 1
        else:
            small = 0
        heapq.heappop(heap)
        del index[r]
        p = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        p = p[rank[p] == r]
        if len(parts) > 1 and len(p) > 1:
            p = p[np.r_[True, p[1:] != p[:-1]]]
        if not len(p):
            continue
        touch = np.r_[False, nxt[p[:-1]] == p[1:]]
        if touch.any():  # overlapping pairs: every other one of a run, from the left
            i = np.arange(len(p))
            p = p[(i - np.maximum.accumulate(np.where(touch, 0, i))) % 2 == 0]
        q = nxt[p]
        s = nxt[q]
        tok[p], tok[q], rank[q], rank[p] = r, -1, -1, -1
        nxt[p] = s
        has = s >= 0
        prv[s[has]] = p[has]
        left = prv[p]
        a, b = p[has], left[left >= 0]
        rank[a] = merges.of(tok[a], tok[nxt[a]])
        rank[b] = merges.of(tok[b], tok[nxt[b]])
        add(np.unique(np.concatenate([a, b])))

    rest = {r: np.concatenate(parts).tolist() for r, parts in index.items()}
    tok, nxt, prv, get = tok.tolist(), nxt.tolist(), prv.tolist(), merges.pairs.get
    while heap:
        r = heapq.heappop(heap)
        at = rest.pop(r)
        at.sort()
        for p in at:
            t = tok[p]
            if t < 0 or (q := nxt[p]) < 0 or get(t << 20 | tok[q]) != r:
                continue
            tok[p], tok[q] = r, -1
            s = nxt[p] = nxt[q]
            if s >= 0:
                prv[s] = p
                if (x := get(r << 20 | tok[s], -1)) >= 0:
                    if x in rest:
                        rest[x].append(p)
                    else:
                        rest[x] = [p]
                        heapq.heappush(heap, x)
            if (q := prv[p]) >= 0 and (x := get(tok[q] << 20 | r, -1)) >= 0:
                if x in rest:
                    rest[x].append(q)
                else:
                    rest[x] = [q]
                    heapq.heappush(heap, x)
    tok = np.array(tok, np.int32)
    many = np.zeros(n + 1, np.int64)
    many[1:] = 4 * np.cumsum(tok >= 0)
    ids = tok[tok >= 0].tobytes()
    return [ids[a:b] for a, b in zip(many[start].tolist(), many[start + size].tolist())]


class Codes(dict):
    """Code of each piece of a block: its token id if all of it is a token, else HOLE + its number among `new`."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.new = ranks, []

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        x = self.ranks.get(raw)
        if x is None:
            x = HOLE + len(self.new)
            self.new.append(raw)
        self[piece] = x
        return x


def cut(texts: list[str | None], pattern: regex.Pattern, ranks: dict[bytes, int], at_once: int = 500_000) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's pieces as codes, and the block's distinct pieces that are no tokens. Texts from at_once characters
    on are cut in parts of so many pieces."""
    codes, out = Codes(ranks), []
    get = codes.__getitem__
    for text in texts:
        if text is None or len(text) < at_once:
            found = pattern.findall(text or "")
            out.append(np.fromiter(map(get, found), np.int32, len(found)))
            continue
        pieces, parts = (m.group() for m in pattern.finditer(text)), []
        while part := list(islice(pieces, at_once)):
            parts.append(np.fromiter(map(get, part), np.int32, len(part)))
        out.append(np.concatenate(parts))
    return out, codes.new


def replayed(words: list[bytes], merges: Merges) -> list[bytes]:
    """replay over any number of words, so many bytes at a time that memory stays bounded."""
    out, held, size = [], [], 0
    for w in words:
        held.append(w)
        size += len(w) + 16
        if size > REPLAY_BYTES:
            out += replay(held, merges)
            held, size = [], 0
    return out + replay(held, merges) if held else out


def fill(codes: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with each hole replaced by its piece's ids (`many` of them, by number, one after another in ids);
    and where each code's ids end."""
    hole = codes >= HOLE
    number = np.where(hole, codes - HOLE, 0)
    start = np.cumsum(many) - many
    length = np.where(hole, many[number] if len(many) else 0, 1)
    source = np.where(hole, start[number] if len(many) else 0, len(ids) + np.arange(len(codes)))
    end = np.cumsum(length)
    at = np.repeat(source - (end - length), length) + np.arange(end[-1] if len(end) else 0)
    return np.concatenate([ids, codes])[at], end


def _pack(x: np.ndarray) -> bytes:
    """int32 values byte by byte of their width, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int32)


def _cutting(shared, pattern: str, kind: pa.DataType, buckets: int):
    """Rows of blocks (keys, codes), and of their pieces that are no tokens, by hash bucket (first number, pieces)."""
    schema = pa.schema([("block", pa.binary()), ("bucket", pa.int32()), ("first", pa.int32()), ("body", pa.binary()), ("ends", pa.binary()), ("keys", pa.list_(kind))])

    def run(batches):
        find, ranks = regex.compile(pattern), shared.value
        for rows in blocks(batches, BLOCK_CHARS, "text_body"):
            codes, new = cut(rows.pop("text_body"), find, ranks)
            block, flat, sizes = uuid.uuid4().bytes, np.concatenate(codes), np.array([len(c) for c in codes])
            del codes
            into = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in new), np.int64, len(new))
            order = np.array(sorted(range(len(new)), key=new.__getitem__), np.int64)  # sorted pieces compress better
            order = order[np.argsort(into[order], kind="stable")]
            number = np.empty(len(new), np.int32)
            number[order] = np.arange(len(new))
            hole = flat >= HOLE
            flat[hole] = HOLE + number[flat[hole] - HOLE]
            into = into[order]
            edge = np.flatnonzero(np.r_[True, into[1:] != into[:-1], True]).tolist() if len(new) else [0]
            press = zstandard.ZstdCompressor(3).compress
            out = [(block, None, None, _pack(flat), _pack(sizes), rows["text_key"])]
            for a, b in zip(edge, edge[1:]):
                words = [new[i] for i in order[a:b].tolist()]
                out.append((block, int(into[a]), a, press(b"".join(words)), _pack(np.array([len(w) for w in words])), None))
            yield batch(schema, *zip(*out))

    return run


def _learning(shared):
    """Of a bucket's rows of pieces: the ids of each, replayed once for all blocks that hold it. The merge table is
    made for the bucket (0.1 s) and dropped: idle workers stay small."""
    schema = pa.schema([("block", pa.binary()), ("first", pa.int32()), ("ids", pa.binary()), ("many", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        number, rows = {}, []
        for block, first, body, ends in zip(*(table.column(n).to_pylist() for n in ("block", "first", "body", "ends"))):
            raw, size = zstandard.ZstdDecompressor().decompress(body), _unpack(ends)
            end = np.cumsum(size, dtype=np.int64)
            rows.append((block, first, [number.setdefault(raw[a:b], len(number)) for a, b in zip((end - size).tolist(), end.tolist())]))
        ids = replayed(list(number), Merges(shared.value))
        out = [(block, first, _pack(np.frombuffer(b"".join(own := [ids[i] for i in at]), np.int32)), _pack(np.array([len(x) // 4 for x in own]))) for block, first, at in rows]
        trim()
        return pa.Table.from_batches([batch(schema, *zip(*out))])

    return run


def _joining(shared, name: str, kind: pa.DataType, back: bool):
    """A block's texts as ids; with `back`, and the bytes that these stand for. The texts are filled, and go to Spark
    as Arrow batches, some FILL_CODES codes (or one text) at a time."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        parts = sorted(zip(*(found.column(n).to_pylist() for n in ("first", "ids", "many"))))
        ids, many = (np.concatenate([_unpack(p[k]) for p in parts]) if parts else np.zeros(0, np.int32) for k in (1, 2))
        many = many.astype(np.int64)
        columns: list[list] = [[], [], []]
        for body, sizes, keys in zip(*(texts.column(n).to_pylist() for n in ("body", "ends", "keys"))):
            codes, stop = _unpack(body), np.r_[0, np.cumsum(_unpack(sizes), dtype=np.int64)]
            part = stop[1:] // FILL_CODES
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
            for a, b in zip(edge, edge[1:]):
                flat, end = fill(codes[stop[a] : stop[b]], ids, many)
                ends = np.r_[0, end][stop[a : b + 1] - stop[a]]
                columns[0].append(pa.array(keys[a:b], kind))
                columns[1].append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                if back:
                    columns[2].append(pa.array(_bytes_of(flat, ends, shared.value), pa.binary()))
        _tokens.clear()
        trim()
        kinds = [kind, _IDS, pa.binary()][: 2 + back]
        return pa.table([pa.chunked_array(c, t) for c, t in zip(columns, kinds)], names=[name, "ids", "decoded"][: 2 + back])

    return run


def _bytes_of(flat: np.ndarray, ends: np.ndarray, ranks: dict[bytes, int]) -> list[bytes]:
    if not _tokens or _tokens[0] is not ranks:
        _tokens[:] = [ranks, {r: t for t, r in ranks.items()}]
    get = _tokens[1].__getitem__
    return [b"".join(map(get, flat[a:b].tolist())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_tokens: list = []


def _decoding(shared, ids: str, name: str):
    def run(batches):
        of = {r: t for t, r in shared.value.items()}
        for b in batches:
            lists = b.column(b.schema.names.index(ids))
            out = []
            for i in range(len(lists)):
                x = lists[i].values
                out.append(b"".join(map(of.__getitem__, x.to_numpy(zero_copy_only=False).tolist())) if x is not None and len(x) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, name])

    return run


def _coding(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str, key: str, back: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kind = df.select(key).schema[0].dataType
    docs = df.select(F.col(key).alias("text_key"), F.col(text).alias("text_body"))
    buckets = bucket_count(docs, "text_body")
    wide = T.StructType([T.StructField("block", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("body", T.BinaryType()), T.StructField("ends", T.BinaryType()), T.StructField("keys", T.ArrayType(kind))])
    both = saved_by(docs.mapInArrow(lean(_cutting(shared, pattern, _arrow_type(kind), buckets)), wide), "pieces", "block", buckets)
    known = both.where("bucket is not null").groupBy("bucket").applyInArrow(_learning(shared), "block binary, first int, ids binary, many binary")
    fields = [T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    texts = both.where("bucket is null").select("block", "body", "ends", "keys")
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_joining(shared, key, _arrow_type(kind), back), T.StructType(fields[: 2 + back]))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): each text's token ids, as the merge ranks and the pattern give them.

    Blocks of documents are cut into pieces once. A block asks for each of its distinct pieces that is no token
    by itself; the pieces of the whole corpus meet in hash buckets, whose number follows the corpus, where each
    distinct one is replayed once (an inverted index from token pair to positions, merges in rank order); a
    block's answers come back packed and fill its texts. Blocks are written once, bucketed, and read back where the
    answers meet them: texts are not exchanged, nor are their pieces one by one.

    One row per row of df, repeated rows and null keys too; null and empty texts give no ids; texts of
    any length are encoded whole, cut in parts. Other columns, whatever their names, are left out. The ranks
    (a vocabulary of fixed size) are broadcast. An empty table gives no rows.
    """
    return _coding(df, ranks, pattern, text, key, False)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with a further column `name` (binary; with underscores before it if df has one of that name): the bytes
    that each row's ids stand for, joined.

    Null and empty lists give no bytes; an id outside the vocabulary or a null id raises KeyError.
    """
    name = fresh(df, name)
    run = _decoding(df.sparkSession.sparkContext.broadcast(ranks), ids, name)
    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): encode and decode in one pass over the filled texts."""
    return _coding(df, ranks, pattern, text, key, True)


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    ranks = load_ranks(vocabulary)
    return round_trip(docs, ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

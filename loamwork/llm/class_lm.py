"""Language-model scoring with word classes: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import WordHash, batch, blocks, bucket_count, documents, lean, saved, trim

NO_KEY = -(2**63)
#: A word or ending is an item of the clustering if it occurs so often in training, whatever the size of the
#: corpus: so the clustered vocabulary grows with it.
LEAST = 8
CLASSES = 64
SWEEPS = 5
#: Added to each word's count, and for one unseen word.
MORE = 0.1
#: Added to each class transition's count.
EASE = 0.5
#: Training tokens for each chunk of items whose contexts meet in one place; cells that a task holds.
CHUNK_TOKENS, HELD = 2_000_000, 4_000_000
_DEALT = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("train", pa.binary()), ("ids", pa.binary()), ("digests", pa.binary())])


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case; the end that follows them is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _tail(word: bytes) -> str:
    """A word's last three characters, which tell all its endings."""
    return word[-12:].decode("utf-8", "ignore")[-3:]


def _endings(tail: str) -> tuple[str, str, str]:
    return "3" + tail, "2" + tail[-2:], "1" + tail[-1:]


def endings(word: bytes) -> tuple[str, str, str]:
    """A word's last three, two and one characters, marked by how many were asked for."""
    return _endings(_tail(word))


class Keys:
    """Items by 64-bit hash in two sorted arrays, 12 bytes an item."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.items = hashes[order], items[order].astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def get(self, text: bytes) -> int | None:
        h = np.uint64(xxhash.xxh3_64_intdigest(text))
        at = self.hashes.searchsorted(h)
        return int(self.items[at]) if at < len(self.hashes) and self.hashes[at] == h else None

    def find(self, texts: list[bytes]) -> np.ndarray:
        """get() of many texts at once; -1 for None."""
        out = np.full(len(texts), -1, np.int32)
        if len(self.hashes):
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
            order = np.argsort(h)  # neighbouring searches read neighbouring places
            at = np.minimum(self.hashes.searchsorted(h[order]), len(self.hashes) - 1)
            out[order] = np.where(self.hashes[at] == h[order], self.items[at], -1)
        return out


class Known(dict):
    """Item of the longest known ending of words with the same last three characters, else `other`; bounded like WordHash."""

    def __init__(self, keys: Keys, other: int, most: int = 100_000):
        super().__init__()
        self.of, self.other, self.most = keys, other, most

    def __missing__(self, tail: str) -> int:
        if len(self) >= self.most:
            self.clear()
        x = self[tail] = next((y for e in _endings(tail) if (y := self.of.get(e.encode())) is not None), self.other)
        return x


class Items(dict):
    """Item of each word: its own, else that of its longest known ending, else `other`; bounded like WordHash."""

    def __init__(self, words: Keys, ends: Keys, other: int, most: int = 300_000):
        super().__init__()
        self.words, self.ends, self.most = words, Known(ends, other), most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        x = self.words.get(word)
        if x is None:
            x = self.ends[_tail(word)]
        self[word] = x
        return x

    def of(self, words: list[bytes]) -> np.ndarray:
        """Items of many words; those not held yet are looked up together."""
        distinct = set(words)
        new = [w for w in distinct if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(distinct)
        for at in range(0, len(new), self.most):  # more distinct words than it may hold: the last ones stay
            some = new[at : at + self.most]
            found = self.words.find(some).tolist()
            for i, x in enumerate(found):
                if x < 0:
                    found[i] = self.ends[_tail(some[i])]
            if len(self) + len(some) > self.most:
                self.clear()
            self.update(zip(some, found))
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, word, n): how often each word of the training rows occurs; counted by task first."""

    def run(batches):
        count: Counter = Counter()
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

        def out():
            words, n = list(count), list(count.values())
            for a in range(0, len(words), 50_000):
                yield batch(schema, words[a : a + 50_000], n[a : a + 50_000])
            count.clear()

        for rows in blocks(batches, 2_000_000, "text_body"):
            for t in rows["text_body"]:
                count.update(tokens_of(t))
            if len(count) > 500_000:
                yield from out()
        yield from out()

    return docs.where("not held_out").select("text_body").mapInArrow(lean(run), "word binary, n long").select(F.col("word").cast("string").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def _sum_by_key(counts: DataFrame, keyed, kind: pa.DataType, name: str) -> DataFrame:
    """(key, n, words): occurrences and number of distinct words for each key that the function from `keyed` gives a word."""
    schema = pa.schema([("key", kind), ("n", pa.int64()), ("words", pa.int64())])

    def run(batches):
        total: dict = {}
        give = keyed()
        for b in batches:
            for w, n in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                for k in give(w):
                    x = total.setdefault(k, [0, 0])
                    x[0] += n
                    x[1] += 1
        keys = list(total)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield batch(schema, part, [total[k][0] for k in part], [total[k][1] for k in part])

    return counts.select("word", "n").mapInArrow(lean(run), f"key {name}, n long, words long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def _signed(text: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(text)
    return x - 2**64 if x >= 2**63 else x


def _columns(sums: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, n, words of all rows on the driver, packed by task: 24 bytes a key."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.binary()), ("words", pa.binary())])

    def run(batches):
        for b in batches:
            yield batch(schema, *([b.column(i).to_numpy().astype(np.int64).tobytes()] for i in range(3)))

    rows = sums.select("key", "n", "words").mapInArrow(lean(run), "key binary, n binary, words binary").collect()
    return tuple(np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in range(3))


def vocabulary(counts: DataFrame, least: float = LEAST) -> dict:
    """The items: words with `least` occurrences, then endings with as many of the other words, other, and the end;
    with their counts and numbers of distinct words. The driver gets packed hashes and counts of these only."""
    spark = counts.sparkSession
    words_n, total = counts.agg(F.count("*"), F.sum("n")).first()
    least = max(2.0, least)

    def ranked(sums: DataFrame, first: int) -> tuple[Keys, np.ndarray, np.ndarray]:
        key, n, words = _columns(sums)
        order = np.lexsort((key, -n))
        return Keys(key[order].astype(np.uint64), first + np.arange(len(key))), n[order], words[order]

    words, words_count, same_hash = ranked(_sum_by_key(counts.where(F.col("n") >= least), lambda: lambda w: [_signed(w)], pa.int64(), "long"), 0)
    rare = counts.where(F.col("n") < least)
    ends, _, _ = ranked(_sum_by_key(rare, lambda: lambda w: [_signed(e.encode()) for e in endings(w)], pa.int64(), "long").where(F.col("n") >= least), len(words))
    other = len(words) + len(ends)
    shared = spark.sparkContext.broadcast((words, ends))

    def item():
        of = Items(*shared.value, other)
        return lambda w: [of[w]]

    at, ends_count, ends_words = _columns(_sum_by_key(rare, item, pa.int64(), "long"))
    n, distinct = np.zeros(other + 2, np.int64), np.zeros(other + 2, np.int64)
    n[: len(words)], distinct[: len(words)] = words_count, same_hash
    np.add.at(n, at, ends_count)
    np.add.at(distinct, at, ends_words)
    return {"words": words, "ends": ends, "other": other, "end": other + 1, "n": n, "distinct": distinct, "total": total or 0, "vocabulary": words_n}


def itemised(docs: DataFrame, vocab: dict, packed: bool = False) -> DataFrame:
    """(id, digest, held_out, items, rare): each text as items, the end last, and hashes of the words that are no items.
    Packed items are a binary of 4 bytes each, which Spark hands on whole instead of one by one."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab["words"], vocab["ends"], vocab["other"], vocab["end"]))

    def run(batches):
        words, ends, other, end = shared.value
        of, hashes, own = Items(words, ends, other), WordHash(100_000), len(words)
        schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("held_out", pa.bool_()), ("items", pa.binary() if packed else pa.list_(pa.int32())), ("rare", pa.binary())])
        for rows in blocks(batches, 1_000_000, "text_body"):
            lists = [tokens_of(x) for x in rows["text_body"]]
            words_at = np.cumsum([0, *map(len, lists)])
            flat = list(chain.from_iterable(lists))
            del lists
            found = of.of(flat)
            at = np.flatnonzero(found >= own)
            h, cut = hashes.array([flat[i] for i in at.tolist()]), np.searchsorted(at, words_at)
            rare = [h[a:z].tobytes() for a, z in zip(cut, cut[1:])]
            del flat
            # the end follows each text's words
            items = np.insert(found, words_at[1:], end)
            ends_at = words_at + np.arange(len(words_at))
            if packed:
                lists = pa.array([items[a:z].tobytes() for a, z in zip(ends_at, ends_at[1:])], pa.binary())
            else:
                lists = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(items))
            yield batch(schema, rows["id"], rows["digest"], rows["held_out"], lists, rare)

    return docs.mapInArrow(lean(run), f"id long, digest long, held_out boolean, items {'binary' if packed else 'array<int>'}, rare binary")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Items of a batch's texts one after another, and each text's number of them."""
    lists = b.column(b.schema.names.index("items"))
    if pa.types.is_list(lists.type):
        return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    if not len(lists):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    size = int(offsets[-1] - offsets[0]) // 4
    return np.frombuffer(lists.buffers()[2], np.int32, size, int(offsets[0])) if size else np.zeros(0, np.int32), np.diff(offsets) // 4


def transitions(items: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts [class before, class] over the training texts, under the classes `of`."""
    shared = items.sparkSession.sparkContext.broadcast(of)
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        cls, counts = shared.value, np.zeros(classes * classes, np.int64)
        for b in batches:
            flat, _ = _flat(b)
            if len(flat):
                c = cls[flat]
                counts += np.bincount(np.r_[cls[-1], c[:-1]].astype(np.int32) * classes + c, minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield batch(schema, cells.astype(np.int32), counts[cells])

    out = np.zeros(classes * classes)
    for cell, n in items.where("not held_out").select("items").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(classes, classes)


def contexts(items: DataFrame, of: np.ndarray, classes: int, chunks: int) -> DataFrame:
    """(chunk, many, at, n): counts [item, class before] and [item, class after] over the training texts, under the
    classes `of`, of each task or more. Item i is number i // chunks of chunk i % chunks; cells in use only, as
    compressed steps from one to the next."""
    shared = items.sparkSession.sparkContext.broadcast(of)
    wide = 2 * classes
    room = (len(of) // chunks + 1) * wide
    schema = pa.schema([("chunk", pa.int32()), ("many", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches):
        cls = shared.value
        pack = pa.Codec("zstd", 1).compress
        held: list = []

        def merged():
            cells, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(cells, kind="stable")
            cells, n = cells[order], n[order]
            first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            held[:] = [(cells[first], np.add.reduceat(n, first))]

        def out():
            merged()
            cells, n = held.pop()
            chunk, local = np.divmod(cells, room)
            edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
            for a, z in zip(edge, edge[1:]):
                yield batch(schema, [int(chunk[a])], [int(z - a)], [pack(np.diff(local[a:z], prepend=0).astype(np.int32), asbytes=True)], [pack(n[a:z].astype(np.int32), asbytes=True)])

        for b in batches:
            flat, _ = _flat(b)
            if not len(flat):
                continue
            c = cls[flat]
            before, after = np.r_[cls[-1], c[:-1]], np.r_[c[1:], cls[-1]]
            for a in range(0, len(flat), 1_000_000):
                number, chunk = np.divmod(flat[a : a + 1_000_000].astype(np.int64), chunks)
                at = chunk * room + number * wide
                both = np.concatenate([at + before[a : a + len(at)], at + classes + after[a : a + len(at)]])
                both.sort()
                first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
                held.append((both[first], np.diff(first, append=len(both))))
                if sum(len(x) for x, _ in held) > HELD:
                    merged()
                    if len(held[0][0]) > HELD // 2:
                        yield from out()
        if held:
            yield from out()

    return items.where("not held_out").select("items").mapInArrow(lean(run), "chunk int, many int, at binary, n binary")


def log_transitions(counts: np.ndarray) -> np.ndarray:
    return np.log10((counts + EASE) / (counts.sum(1, keepdims=True) + EASE * len(counts)))


def likelihood(counts: np.ndarray) -> float:
    """What the classes add to the log likelihood of the training tokens, by counts [class before, class]."""
    x_log_x = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return x_log_x(counts) - x_log_x(counts.sum(0)) - x_log_x(counts.sum(1))


def gains(before: np.ndarray, after: np.ndarray, own: np.ndarray, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[item, class]: log10 likelihood of the items' occurrences in each class, given counts of the class before and
    after each and its class now. In its own class an item's own occurrences are taken out first, so that staying
    is held to the same measure as moving; the last class is the end's alone."""
    classes, trans, rows = len(counts), log_transitions(counts), np.arange(len(own))
    n = before.sum(1)
    out = before @ trans + after @ trans.T - n[:, None] * np.log10(np.maximum(size, 1.0))
    total = counts.sum(1) + EASE * classes
    into = np.log10(np.maximum(counts[:, own].T - before, 0) + EASE) - np.log10(total)
    onward = np.log10(np.maximum(counts[own] - after, 0) + EASE) - np.log10(np.maximum(total[own] - n, EASE * classes))[:, None]
    out[rows, own] = (before * into).sum(1) + (after * onward).sum(1) - n * np.log10(np.maximum(size[own] - n, 1.0))
    out[:, -1] = -np.inf
    return out


def exchanged(items: DataFrame, of: np.ndarray, counts: np.ndarray, size: np.ndarray, tokens: int, may) -> np.ndarray:
    """`of` after each item that may(items) has gone to its best class. A chunk's counts meet in one task, whose
    items' classes alone come back: a byte for an item."""
    spark, classes = items.sparkSession, len(counts)
    kind = np.min_scalar_type(classes)
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // CHUNK_TOKENS)
    of = of.astype(kind)
    shared = spark.sparkContext.broadcast((of, counts, size))

    def best(table: pa.Table) -> pa.Table:
        of, counts, size = shared.value
        chunk = table.column("chunk")[0].as_py()
        own = np.arange(chunk, len(of), chunks)
        unpack, both = pa.Codec("zstd").decompress, np.zeros(len(own) * 2 * classes)
        for many, at, n in zip(*(table.column(x).to_pylist() for x in ("many", "at", "n"))):
            cells, n = (np.frombuffer(unpack(x, 4 * many, asbytes=True), np.int32) for x in (at, n))
            both[np.cumsum(cells)] += n
        before, after = both.reshape(len(own), 2, classes).transpose(1, 0, 2)
        gain = gains(before, after, of[own], counts, size)
        to, rows = gain.argmax(1), np.arange(len(own))
        move = (gain[rows, to] > gain[rows, of[own]] + 1e-9) & may(own) & (own != len(of) - 1)
        trim()
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "of": pa.array([np.where(move, to, of[own]).astype(kind).tobytes()])})

    out = of.copy()
    for chunk, to in contexts(items, of, classes, chunks).groupBy("chunk").applyInArrow(best, "chunk int, of binary").collect():
        out[chunk::chunks] = np.frombuffer(to, kind)
    return out


def model(items: DataFrame, vocab: dict, classes: int, sweeps: int) -> dict:
    """Classes by exchange clustering (of), their transition log10 probabilities (trans), and the likelihood after
    each sweep that was kept.

    Items begin in classes by rank of frequency; the end has the last class alone. In each sweep, counts
    of every item's neighbouring classes are gathered over the whole training corpus, and each item goes
    to the class that gives its occurrences the largest likelihood under the sweep's counts, its own taken out; in a
    sweep but the last, every other item may move, so that neighbours don't trade places for ever. As moves of a
    sweep are decided together, their sum could lower the likelihood: it is measured after each sweep over the
    whole training corpus, and a sweep that doesn't raise it is undone and ends the search.
    """
    total, end = len(vocab["n"]), vocab["end"]
    of = (np.arange(total) % (classes - 1)).astype(np.min_scalar_type(classes))
    of[end] = classes - 1
    kept, rising = None, []
    for sweep in range(sweeps + 1):
        counts = transitions(items, of, classes)
        if rising and likelihood(counts) <= rising[-1]:
            break
        kept = of, counts
        rising.append(likelihood(counts))
        if sweep == sweeps:
            break
        some = 0 < sweep < sweeps - 1
        of = exchanged(items, of, counts, np.bincount(of, vocab["n"], classes), vocab["total"], lambda i, some=some, sweep=sweep: (i + sweep) % 2 == 0 if some else True)
    return {"of": kept[0], "trans": log_transitions(kept[1]), "likelihood": rising}


def deal_rare(items: DataFrame, buckets: int) -> DataFrame:
    """Occurrences of the words that are no items, by hash bucket, packed by batch of documents."""

    def run(batches):
        for rows in batches:
            ids, digests, held_out, rare = (rows.column(i) for i in range(4))
            lists = rare.to_pylist()
            h = np.frombuffer(b"".join(lists), np.uint64)
            if not len(h):
                continue
            ids, digests, train = ids.to_numpy(), digests.to_numpy(), ~held_out.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists]).astype(np.uint32)
            into = (h >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(into, kind="stable")
            h, doc, into = h[order], doc[order], into[order]
            edge = np.flatnonzero(np.r_[True, into[1:] != into[:-1], True])
            out = []
            for a, b in zip(edge, edge[1:]):
                own, inverse = np.unique(doc[a:b], return_inverse=True)
                out.append((int(into[a]), h[a:b].tobytes(), inverse.astype(np.uint16 if len(own) < 2**16 else np.uint32).tobytes(), train[own].tobytes(), ids[own].tobytes(), digests[own].tobytes()))
            yield batch(_DEALT, *zip(*out))

    return items.select("id", "digest", "held_out", "rare").mapInArrow(lean(run), "bucket int, hashes binary, docs binary, train binary, ids binary, digests binary")


def _packed_sums(ids, digests, logs, known, buckets: int):
    """Sums by text, packed by bucket of the text."""
    to = ((digests.astype(np.uint64) ^ (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(16)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    ids, digests, logs, known, to = ids[order], digests[order], logs[order], known[order], to[order]
    edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
    return [(int(to[a]), ids[a:b].tobytes(), digests[a:b].tobytes(), logs[a:b].tobytes(), known[a:b].tobytes()) for a, b in zip(edge, edge[1:])]


def rare_scores(dealt: DataFrame, buckets: int) -> DataFrame:
    """(id, digest, rare_log, rare_known): per text, sum of log10(count + MORE) and number of known words among them.

    The bucket of a hash has all its occurrences, so their count; sums go by text, packed, to the text's
    bucket, which adds them up."""
    packed = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("digests", pa.binary()), ("logs", pa.binary()), ("known", pa.binary())])
    schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("rare_log", pa.float64()), ("rare_known", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        h, doc, train, ids, digests, base = [], [], [], [], [], 0
        for r in zip(*(table.column(n).to_pylist() for n in ("hashes", "docs", "train", "ids", "digests"))):
            x = np.frombuffer(r[0], np.uint64)
            d = np.frombuffer(r[1], np.uint16 if len(r[1]) == 2 * len(x) else np.uint32).astype(np.int64)
            t = np.frombuffer(r[2], bool)
            h.append(x)
            doc.append(d + base)
            train.append(t[d])
            ids.append(np.frombuffer(r[3], np.int64))
            digests.append(np.frombuffer(r[4], np.int64))
            base += len(t)
        doc = np.concatenate(doc)
        _, inverse = np.unique(np.concatenate(h), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(train))[inverse]
        trim()
        out = _packed_sums(np.concatenate(ids), np.concatenate(digests), np.bincount(doc, np.log10(n + MORE), base), np.bincount(doc, n > 0, base).astype(np.int32), buckets)
        return pa.Table.from_batches([batch(packed, *zip(*out))])

    def add(table: pa.Table) -> pa.Table:
        ids, digests, logs, known = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("ids", np.int64), ("digests", np.int64), ("logs", np.float64), ("known", np.int32)))
        order = np.lexsort((logs, digests, ids))
        ids, digests, logs, known = ids[order], digests[order], logs[order], known[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])])
        return pa.Table.from_batches([batch(schema, ids[first], digests[first], np.add.reduceat(logs, first), np.add.reduceat(known, first))])

    found = dealt.groupBy("bucket").applyInArrow(count, "bucket int, ids binary, digests binary, logs binary, known binary")
    return found.groupBy("bucket").applyInArrow(add, "id long, digest long, rare_log double, rare_known long")


def frequent_scores(items: DataFrame, vocab: dict, fitted: dict) -> DataFrame:
    """Per text: n_tokens; over its items log10(count + MORE) and known ones; log10 of transitions and class sizes."""
    n, of, trans = vocab["n"].astype(float), fitted["of"], fitted["trans"]
    classes = len(trans)
    own = np.zeros(len(n), bool)
    own[: len(vocab["words"])] = True
    own[vocab["end"]] = True
    logs, known = np.where(own, np.log10(n + MORE), 0.0), own & (n > 0)
    size = np.log10(np.bincount(of, n, classes) + MORE * (np.bincount(of, vocab["distinct"], classes) + 1))
    shared = items.sparkSession.sparkContext.broadcast((of, trans, logs, known, size))
    end_class = int(of[vocab["end"]])

    def run(batches):
        cls, trans, logs, known, norm = shared.value
        for b in batches:
            flat, many = _flat(b)
            row, c = np.repeat(np.arange(len(many)), many), cls[flat]
            step = trans[np.r_[end_class, c[:-1]], c] if len(c) else np.zeros(0)
            rows = b.num_rows
            sums = [np.bincount(row, x, rows) for x in (np.ones(len(row)), logs[flat], known[flat], step, norm[c])]
            cols = [b.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2].astype(np.int64)), pa.array(sums[3]), pa.array(sums[4])],
                                             names=["id", "digest", "held_out", "n_tokens", "own_log", "own_known", "step_log", "norm_log"])

    return items.select("id", "digest", "held_out", "items").mapInArrow(lean(run), "id long, digest long, held_out boolean, n_tokens long, own_log double, own_known long, step_log double, norm_log double")


def score_texts(df: DataFrame, held_out: str, text: str = "text", key: str = "doc_id", least: float = LEAST, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    held_out is SQL of the rows that the model doesn't learn from. Tokens are words, A-Z in lower case,
    then one end. base_score is the unigram log10 probability with MORE added to counts. score is the
    class model's: per token, log10 P(class | class before) + log10 P(token | class), the latter with
    MORE added within the class; so it is normalised over known words and one unseen word per class.
    Words with at least `least` occurrences in training are clustered one by one; others go with their
    longest ending that has as many. Perplexity is 10 ** (-score / n_tokens).

    All counts are over all training rows: words are counted by task, then by Spark; rare words meet
    their counts in hash buckets whose number follows the corpus. Null and empty texts have the end
    alone. A null held_out counts as false, a null key is kept. Equal rows get equal results. With no
    training rows, every token's base probability is 1. An empty table gives no rows. Other columns are
    left out.
    """
    docs = df.select(
        F.coalesce(F.col(key).cast("long"), F.expr("-9223372036854775807L - 1L")).alias("id"), F.xxhash64(text).alias("digest"),
        F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col(text).alias("text_body"))
    vocab = vocabulary(saved(word_counts(docs), "words"), least)
    trained = docs.where("not held_out").count()
    vocab["n"][vocab["end"]], vocab["distinct"][vocab["end"]] = trained, int(trained > 0)
    items = saved(itemised(docs, vocab, packed=True), "items")
    fitted = model(items, vocab, classes, sweeps)
    total, words = vocab["total"] + trained, vocab["vocabulary"] + int(trained > 0)

    own = frequent_scores(items, vocab, fitted)
    buckets = bucket_count(docs, "text_body")
    rare = rare_scores(deal_rare(items, buckets), buckets)
    same = items.groupBy("id", "digest").agg(F.count("*").alias("rows"))
    both = own.join(rare.join(same, ["id", "digest"]), ["id", "digest"], "left")
    logs = F.col("own_log") + F.coalesce(F.col("rare_log") / F.col("rows"), F.lit(0.0))
    return both.select(
        F.expr("nullif(id, -9223372036854775807L - 1L)").alias("doc_id"), "held_out", "n_tokens",
        (F.col("own_known") + F.coalesce(F.expr("rare_known div rows"), F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + MORE * (words + 1)))).alias("base_score"),
        (F.col("step_log") + logs - F.col("norm_log")).alias("score"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), "crc32(cast(doc_id as string)) % 10 = 0")

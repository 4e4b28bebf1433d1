"""BPE encoding by longest matches, pair compatibility and backtracking; decoding by an offset table."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.common import blocks, documents, fresh, lean, trim

#: Pieces of text between added tokens, as byte-level pre-tokenizers cut it. L and N stand for the classes of letters and numbers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\sLN]+|\s+(?!\S)|\s+"
#: Characters of texts that are cut before the new pieces among them are encoded together, and pieces whose ids a worker remembers.
BLOCK_CHARS, REMEMBERED = 2_000_000, 400_000
#: Pieces of a text that are cut at once, and ids that go to Spark in one batch, about.
AT_ONCE, BATCH_IDS = 200_000, 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies of byte-level BPE: visible Latin-1 characters for themselves,
    the other bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


@dataclass
class Vocabulary:
    """Bytes are tokens 0 to 255, the merges' products follow in order of their rank, then the added tokens."""

    left: np.ndarray  #: of each merge, by rank: its parts
    right: np.ndarray
    ids: np.ndarray  #: the vocabulary's own ids, by token
    added: list[str]
    unknown: list[tuple[int, int]] = field(default_factory=list)  #: runs of characters that regex takes for letters or numbers and the library doesn't
    tables: "Tables | None" = field(default=None, repr=False)
    memory: "Memory | None" = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "tables": None, "memory": None}


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file of byte-level BPE. What the encoder doesn't rebuild (normalizers, dropout, a prefix space, merges
    that precede their parts or give one token twice, ...) raises ValueError."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, pre, letters = made["model"], made["pre_tokenizer"] or {}, byte_letters()
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not plain or made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not plain byte-level BPE")
    added = made.get("added_tokens") or []
    if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on their neighbours")
    number = {c: b for c, b in letters.items()}
    left, right = [], []
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if a not in number or b not in number or a + b in number:
            raise ValueError(f"merge {a!r} {b!r} precedes its parts or gives a token that is there")
        left.append(number[a])
        right.append(number[b])
        number[a + b] = 256 + len(left) - 1
    vocab = model["vocab"]
    if missing := [t for t in number if t not in vocab]:
        raise ValueError(f"tokens without ids: {missing[:3]}")
    ids = [vocab[t] for t, n in sorted(number.items(), key=lambda x: x[1])] + [a["id"] for a in added]
    return Vocabulary(np.array(left, np.int32), np.array(right, np.int32), np.array(ids, np.int32), [a["content"] for a in added], unknown_letters())


def unknown_letters() -> list[tuple[int, int]]:
    """Runs of characters that the regex module takes for letters or numbers and the tokenizers library, of an older
    Unicode, doesn't. Only those are asked for that Python's own tables, older still, have no name for."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut, out = ByteLevel(add_prefix_space=False).pre_tokenize_str, []
    young = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Cn", "Co"))
    for c in regex.findall(r"[\p{L}\p{N}]", "".join(young)):
        kind = "a" if regex.match(r"\p{L}", c) else "1"
        if len(cut(kind + c)) > 1:
            if out and out[-1][1] == ord(c) - 1:
                out[-1] = (out[-1][0], ord(c))
            else:
                out.append((ord(c), ord(c)))
    return out


class Tables:
    """What encoding and decoding look up, made from a vocabulary in each worker."""

    def __init__(self, v: Vocabulary):
        n = 256 + len(v.left)
        self.left, self.right = [-1] * 256 + v.left.tolist(), [-1] * 256 + v.right.tolist()
        self.pair = {a << 32 | b: 256 + k for k, (a, b) in enumerate(zip(v.left.tolist(), v.right.tolist()))}
        raw = [bytes([b]) for b in range(256)]
        for a, b in zip(v.left.tolist(), v.right.tolist()):
            raw.append(raw[a] + raw[b])
        self.raw = raw
        self.size = [len(t) for t in raw]
        self.known: dict[int, bool] = {}
        # a token stands for its bytes only if its own parts would lie side by side until its merge
        self.whole = [True] * 256
        for t in range(256, n):
            a, b = self.left[t], self.right[t]
            self.whole.append(self.whole[a] and self.whole[b] and self.fits(a, b, t))
        named = {raw[t]: t for t in range(n) if self.whole[t]}
        self.shorter = [-1] * n  # the longest token that begins a token
        for name, t in named.items():
            self.shorter[t] = next((named[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in named), -1)
        self.automaton = ahocorasick.Automaton()
        for name, t in named.items():
            self.automaton.add_word(name.decode("latin-1"), t)
        self.automaton.make_automaton()
        # all tokens' bytes, one after another, and where each begins
        text = [*raw, *(a.encode() for a in v.added)]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.many = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(self.many) - self.many
        order = np.argsort(v.ids, kind="stable")
        self.by_id, self.sorted_ids = order, v.ids[order]
        self.ids = v.ids

    def fits(self, a: int, b: int, limit: int = 1 << 31) -> bool:
        """Whether tokens a and b stay side by side, no merge of less than `limit` joining their ends.

        Goes back in time: of two neighbours the one that was merged last is taken apart, a's left part and b's right part
        being out of reach; whenever two lay side by side, their own merge must not have come first. Of equal tokens the left
        one was merged first.
        """
        pair, left, right = self.pair, self.left, self.right
        while pair.get(a << 32 | b, limit) >= limit:
            if a > b and a > 255:
                limit, a = a, right[a]
            elif b > 255:
                limit, b = b + 1, left[b]
            else:
                return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        """fits() from the pair table, which forgets all once it is large."""
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[key] = self.fits(a, b)
        return found

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of each piece. One pass of the automaton over all pieces finds the longest token that starts at each
        byte; a piece is then walked from its start: the longest token that is compatible with the one before it, else the
        next shorter one, else the one before it is taken back and made shorter. Bytes from which no walk reached the
        end are not entered again, so each is left once by each way at most."""
        text = "Ā".join(p.decode("latin-1") for p in pieces)
        longest = [0] * (len(text) + 1)
        size, shorter, compatible = self.size, self.shorter, self.compatible
        for end, token in self.automaton.iter(text):
            longest[end - size[token] + 1] = token  # later ends are longer
        out, at = [], 0
        for piece in pieces:
            end, tokens, closed = at + len(piece), [], set()
            token = longest[at] if piece else -1
            while at < end:
                stop = at + size[token]
                if stop not in closed and (not tokens or compatible(tokens[-1], token)):
                    tokens.append(token)
                    at = stop
                    token = longest[at]
                elif shorter[token] >= 0:
                    token = shorter[token]
                else:
                    closed.add(at)
                    token = tokens.pop()
                    at -= size[token]
            out.append(tokens)
            at += 1
        return out

    def text_of(self, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The tokens' bytes, one after another, and where each token's end, from the offset table."""
        raw, end = spread(self.bytes, self.start[tokens], self.many[tokens])
        return raw.tobytes(), end

    def tokens_of(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted_ids, ids), len(self.sorted_ids) - 1)
        if len(bad := ids[self.sorted_ids[at] != ids]):
            raise KeyError(f"no token has id {bad[0]}")
        return self.by_id[at]


def spread(values: np.ndarray, start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `values`, one after another, and where each ends."""
    end = np.cumsum(many)
    return values[np.repeat(start - (end - many), many) + np.arange(end[-1] if len(end) else 0)], end


def tables_of(v: Vocabulary) -> Tables:
    if v.tables is None:
        v.tables = Tables(v)
    return v.tables


class Memory:
    """Tokens by piece, kept from block to block. A piece has a number; its tokens are a run of `flat`."""

    def __init__(self, v: Vocabulary):
        self.tables, self.added = tables_of(v), v.added
        plain = PIECES.replace("L", r"\p{L}").replace("N", r"\p{N}")
        runs = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v.unknown)
        old = PIECES.replace("L", rf"[\p{{L}}--[{runs}]]").replace("N", rf"[\p{{N}}--[{runs}]]")
        self.pattern = regex.compile(plain)
        self.odd = {chr(c) for a, b in v.unknown for c in range(a, b + 1)}
        self.old = regex.compile(old, regex.V1) if v.unknown else None
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self._clear()

    def _clear(self) -> None:
        """Added tokens are pieces of their own: no other piece is spelled like one, as texts are split at all of them."""
        self.number = {a: k for k, a in enumerate(self.added)}
        first = len(self.tables.raw)
        self.flat = [np.arange(first, first + len(self.added), dtype=np.int32)]
        self.many = [np.ones(len(self.added), np.int64)]
        self.new: list[str] = []

    def pieces(self, text: str) -> Iterator[str]:
        for k, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if k % 2:
                yield part
            elif part:
                pattern = self.pattern if part.isascii() or self.odd.isdisjoint(part) else self.old
                yield from (m.group() for m in pattern.finditer(part)) if len(part) > AT_ONCE else pattern.findall(part)

    def numbers(self, text: str | None) -> list[np.ndarray]:
        """Each piece's number, in parts."""
        number, new, out = self.number, self.new, []
        pieces = self.pieces(text or "")
        while part := list(islice(pieces, AT_ONCE)):
            for p in part:
                if p not in number:
                    number[p] = len(number)
                    new.append(p)
            out.append(np.fromiter(map(number.__getitem__, part), np.int32, len(part)))
        return out

    def learn(self) -> None:
        """Encodes the new pieces, a bounded number of bytes at a time."""
        held, size = [], 0
        for p in [*self.new, None]:
            if p is not None:
                held.append(p.encode("utf-8", "surrogatepass"))
                size += len(held[-1])
            if held and (p is None or size > 1_000_000):
                tokens = self.tables.encode(held)
                self.flat.append(np.array([t for x in tokens for t in x], np.int32))
                self.many.append(np.array([len(x) for x in tokens], np.int64))
                held, size = [], 0
        self.new.clear()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, number of texts, tokens, each text's end) of runs of texts, about BATCH_IDS pieces each."""
        numbers = [self.numbers(t) for t in texts]
        self.learn()
        flat, many = np.concatenate(self.flat), np.concatenate(self.many)
        self.flat, self.many = [flat], [many]
        start = np.cumsum(many) - many
        size = [sum(map(len, x)) for x in numbers]
        a = 0
        while a < len(texts):
            b, held = a + 1, size[a]
            while b < len(texts) and held + size[b] <= BATCH_IDS:
                held += size[b]
                b += 1
            codes = np.concatenate([np.zeros(0, np.int32), *(part for x in numbers[a:b] for part in x)])
            tokens, end = spread(flat, start[codes], many[codes])
            yield a, b - a, tokens, np.r_[0, end][np.cumsum(size[a:b])]
            numbers[a:b] = [None] * (b - a)
            a = b
        if len(self.number) > REMEMBERED:
            self._clear()


def memory_of(v: Vocabulary) -> Memory:
    """The worker's memory: it serves all tasks that the worker runs."""
    if v.memory is None:
        v.memory = Memory(v)
    return v.memory


_TEXT = pa.string()


def _kinds(df: DataFrame, key: str):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    return kind, to_arrow_type(kind)


def _cut_text(raw: bytes, end: np.ndarray) -> list[str]:
    edge = [0, *end.tolist()]
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:])]


def _coding(df: DataFrame, vocabulary: Vocabulary, text: str, key: str, back: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind, arrow = _kinds(df, key)
    names = ["key", "ids", "decoded"][: 2 + back]

    def run(batches):
        v = shared.value
        memory = memory_of(v)
        for rows in blocks(batches, BLOCK_CHARS, "text_body"):
            texts, keys = rows.pop("text_body"), rows.pop("text_key")
            for first, n, tokens, end in memory.encode(texts):
                own = pa.array(keys[first : first + n], arrow)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(v.ids[tokens]))
                columns = [own, ids]
                if back:
                    raw, ends = memory.tables.text_of(tokens)
                    columns.append(pa.array(_cut_text(raw, np.r_[0, ends][end]), _TEXT))
                yield pa.RecordBatch.from_arrays(columns, names=names)
            trim()

    fields = [T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())][: 2 + back]
    made = df.select(F.col(key).alias("text_key"), F.col(text).alias("text_body")).mapInArrow(lean(run), T.StructType(fields))
    return made.withColumnRenamed("key", key)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): each text's token ids, as byte-level BPE with the vocabulary's merges gives them.

    Texts are split at added tokens, which have ids of their own, and cut into pieces. A worker remembers the
    pieces that it has met, a bounded number; new ones are encoded together, in time linear in their bytes, whatever
    their length. Nothing is exchanged between tasks, so no word or text that many rows share gathers anywhere.

    One row per row of df, repeated rows and null keys too; null and empty texts give no ids; texts of any length are
    encoded whole. Other columns, whatever their names, are left out. The vocabulary (of fixed size) is broadcast. An empty
    table gives no rows.
    """
    return _coding(df, vocabulary, text, key, False)


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded string): encode, and what decode makes of the ids."""
    return _coding(df, vocabulary, text, key, True)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with a further column `name` (string; with underscores before it if df has one of that name): the text that
    each row's ids stand for; bytes that are no UTF-8 become U+FFFD.

    Null and empty lists give an empty text; a null id or one that no token has raises.
    """
    name, shared = fresh(df, name), df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        tables = tables_of(shared.value)
        for b in batches:
            lists = b.column(b.schema.names.index(ids))
            values = lists.flatten()
            if values.null_count:
                raise KeyError("a null id")
            raw, ends = tables.text_of(tables.tokens_of(values.to_numpy(zero_copy_only=False).astype(np.int64)))
            many = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_cut_text(raw, np.r_[0, ends][np.cumsum(many)]), _TEXT)], names=[*b.schema.names, name])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = round_trip(documents(spark, sf_dir), load_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

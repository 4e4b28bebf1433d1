"""The backtracking encoder against the tokenizers library, on its vocabulary file and on random merges."""

import hashlib
import json
import time
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from loamwork.llm import backtrack_bpe, catalogue

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return backtrack_bpe.load_vocabulary(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own_ids(memory, v, text):
    return [i for _, _, tokens, _ in memory.encode([text]) for i in v.ids[tokens].tolist()]


def sha(x):
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


def test_the_table_is_encoded_as_by_the_library(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: (len(i := ids_of(r.text)), sha(",".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for r in rows}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalogue.queries()["op12_backtracking_bpe"](spark, sf).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40), st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=6))
def test_any_merges_equal_the_library(pairs, words):
    """Tokens need not be reachable, nor merges sensible: each only follows its parts."""
    names, merges = ["a", "b", "c"], []
    for a, b in pairs:
        a, b = names[a % len(names)], names[b % len(names)]
        if a + b not in names:
            names.append(a + b)
            merges.append((a, b))
    number = {n: (ord(n) if len(n) == 1 else 256 + k - 3) for k, n in enumerate(names)}
    v = backtrack_bpe.Vocabulary(np.array([number[a] for a, _ in merges], np.int32), np.array([number[b] for _, b in merges], np.int32), np.arange(256 + len(merges), dtype=np.int32), [])
    library = Tokenizer(models.BPE(vocab={n: number[n] for n in names}, merges=merges))
    assert backtrack_bpe.tables_of(v).encode([w.encode() for w in words]) == [library.encode(w).ids for w in words]


def test_letters_that_the_library_does_not_know_are_cut_as_it_does(vocabulary):
    memory = backtrack_bpe.Memory(vocabulary)
    young = [c for a, b in vocabulary.unknown for c in {a, (a + b) // 2, b}] + [c for c in range(0x3000) if unicodedata.category(chr(c)) == "Cn"][::7]
    for c in map(chr, young):
        text = f"a{c}1{c}{c} {c}.{c}"
        assert list(memory.pieces(text)) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


def test_added_tokens_odd_spaces_and_scripts(vocabulary):
    memory = backtrack_bpe.Memory(vocabulary)
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "   x \n\n y\t\tz  ", "it's I'LL we'd", "你好世界😀 naïvé", "\x00\x1c\x85  end ", "a" * 5000, "<|endof<|endoftext|>text|>", ""]
    for t in texts:
        assert own_ids(memory, vocabulary, t) == ids_of(t)


def test_a_long_piece_takes_linear_time(vocabulary):
    tables = backtrack_bpe.tables_of(vocabulary)
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        assert b"".join(tables.raw[t] for t in tables.encode([b"ab" * n])[0]) == b"ab" * n
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_odd_documents(spark, vocabulary):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (2, None), (3, ""), (4, long), (5, "<|endoftext|> a"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit(2)).withColumn("text_body", F.lit("z")).withColumn("decoded", F.lit("q"))
    got = backtrack_bpe.round_trip(df, vocabulary).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(ids_of(t)), t or "") for i, t in rows)
    named = df.withColumnRenamed("doc_id", "name")
    assert sorted(len(r.ids) for r in backtrack_bpe.encode(named, vocabulary, key="name").collect()) == sorted(len(ids_of(t)) for _, t in rows)
    assert backtrack_bpe.encode(df.where("false"), vocabulary).count() == 0


def test_many_texts_in_small_batches(vocabulary, monkeypatch):
    monkeypatch.setattr(backtrack_bpe, "BATCH_IDS", 50)
    monkeypatch.setattr(backtrack_bpe, "AT_ONCE", 7)
    monkeypatch.setattr(backtrack_bpe, "REMEMBERED", 30)
    memory = backtrack_bpe.Memory(vocabulary)
    for part in range(3):
        texts = [None if i % 11 == 0 else " ".join(f"word{i * k % 23 + part}" for k in range(i % 40)) for i in range(60)]
        got = []
        for first, n, tokens, end in memory.encode(texts):
            edge = [0, *end.tolist()]
            assert first == len(got) and len(edge) == n + 1
            got += [vocabulary.ids[tokens[a:b]].tolist() for a, b in zip(edge, edge[1:])]
        assert got == [ids_of(t) for t in texts]


def test_decoding_by_offsets(spark, vocabulary):
    lists = [[262, 50256, 11], None, [], [128], [220, 128, 50255]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>").withColumn("decoded", F.lit(0))
    got = {r.k: r["_decoded"] for r in backtrack_bpe.decode(df, vocabulary).collect()}
    assert got == {i: LIBRARY.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
    with pytest.raises(Exception, match="no token has id 60000"):
        backtrack_bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), vocabulary).collect()


def test_files_that_are_not_plain_byte_level_bpe_are_refused(tmp_path):
    made = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"model": {**made["model"], "dropout": 0.1}}, {"model": {**made["model"], "merges": made["model"]["merges"][::-1]}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(made | change), encoding="utf-8")
        with pytest.raises(ValueError):
            backtrack_bpe.load_vocabulary(str(path))
    assert regex.compile(backtrack_bpe.PIECES.replace("L", r"\p{L}").replace("N", r"\p{N}")).pattern == public_tokenizers.PATTERN

"""Token operators against the tokenizer libraries and exact round trips."""

import base64
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tastegrid.llm import byte_bpe, token_counts

BYTES, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", "don't we'll 're o'clock 's'd  '' 'sabc 'S", "ΑΣ ΣΑ İx ŉ ǅ", "<|endoftext|>a<|startoftext|> <|endoftext|>", "\x1c\x1f a\x85b​ c",
       "a" * 5_000, "日本語 ½ ²3 é 가 \U0001F600👍🏽 ﷺ", "\r\n\t x  \n  y   ", "   ", "'", " 's", "x" + " " * 600 + "y", "é ﬁ K"]


@pytest.fixture(scope="module")
def ranks():
    with open(BYTES, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op3_odd_rows(odd_docs, odd_rows, library):
    want = Counter()
    for i, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in byte_bpe.encode_digests(odd_docs, BYTES).collect()) == want


def test_op3_words_and_long_words(ranks, library):
    with open(BYTES, "rb") as f:
        bpe = byte_bpe.ByteBpe(f.read())
    texts = [*ODD, "".join("abcdet"[k * k % 6] for k in range(3_000))]
    assert [[int(t) for x in lists for t in x] for lists, _ in bpe.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    words = [b"internationalisation", b"aaaaaaaaaaaaaaaa", bytes(range(256)), b"", b"x"]
    lists = bpe.encode_words(words)
    assert lists == [bpe._by_heap(w) if w else [] for w in words]  # the query and the heap agree
    assert bpe.decode_lists(lists) == words
    with pytest.raises(ValueError):
        bpe.decode_lists([[10 ** 6]])


def test_encode_decode_tables(odd_docs, odd_rows, no_docs):
    coded = byte_bpe.encode(odd_docs, BYTES)
    back = Counter((r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(coded, BYTES).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in odd_rows)
    assert byte_bpe.encode_digests(no_docs, BYTES).collect() == []
    out = byte_bpe.with_tokens(odd_docs, BYTES)
    assert out.count() == len(odd_rows) and out.filter("not decodes").count() == 0
    assert [c for c in odd_docs.columns if c not in out.columns] == []


def test_op9_odd_rows(odd_docs, odd_rows, no_docs):
    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, x in odd_rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want[(i, len((x or "").encode()), n, n > 2048)] += 1
    got = token_counts.token_counts(odd_docs, WORDS).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    assert all((r.limit_chars is not None) == r.over_limit for r in got)
    assert token_counts.token_counts(no_docs, WORDS).collect() == []


def test_op9_counts_and_prefixes():
    with open(WORDS, encoding="utf-8") as f:
        c = token_counts.PrefixCounter(f.read())
    t = Tokenizer.from_file(WORDS)

    def n(x):
        return len(t.encode(x, add_special_tokens=False).ids)
    assert c.counts(ODD) == [n(x) for x in ODD]
    for x in [*ODD[:3], ODD[6], "Thndereringen loweiisch, it's 42 km/h!?"]:
        norm = c.normalise(x)
        table = [n(norm[:i]) for i in range(len(norm) + 1)]
        assert c.prefixes(x).tolist() == table
        for budget in (0, 1, 3, 7, 1_000):
            assert c.longest_prefix(x, budget) == max(i for i in range(len(table)) if all(k <= budget for k in table[:i + 1])) or \
                table[c.longest_prefix(x, budget)] <= budget


def test_prefix_table(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.prefix_tokens for r in token_counts.prefix_table(docs, WORDS).collect()}
    t = Tokenizer.from_file(WORDS)
    assert got == {1: [len(t.encode("ab cd"[:i], add_special_tokens=False).ids) for i in range(6)], 2: [0]}


@pytest.mark.parametrize("n", [1024, 4096])
def test_patterned_words_are_told_apart(spark, library, n):
    """Thue-Morse words and their complements, on which power sums modulo 2 ** 64 are equal."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["".join(p[k.bit_count() & 1] for k in range(n)) for a in letters for p in ((a, "e"), ("e", a)) if a != "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    own = Tokenizer.from_file(WORDS)
    want = {k: len(own.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, WORDS).collect()} == want
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, BYTES).collect()}
    assert all(got[k] == library.encode_ordinary(t) for k, t in enumerate(texts))

"""Operators on single texts against the libraries and plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, documents, lower
from tillscope.llm import bpe, decontaminate, secret_scan, tokencount

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def strange_texts(seed, n):
    rnd = random.Random(seed)
    letters = [chr(c) for c in range(0x250)] + list("\x1c\x85 　​😀漢١²Ⅷ́Σİ")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return texts + ["".join(rnd.choice("'''srevlltmd x1!") for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_coder_equals_library(library):
    coder = bpe.Coder(bpe.read_ranks(RANKS), P.PATTERN)
    rnd = random.Random(5)
    texts = strange_texts(1, 400) + ["".join(rnd.choice("aeth") for _ in range(n)) for n in (255, 256, 257, 3000)]
    ids, count = coder.encode(texts)
    edge = np.concatenate([[0], np.cumsum(count)])
    for i, text in enumerate(texts):
        assert ids[edge[i] : edge[i + 1]].tolist() == library.encode_ordinary(text), repr(text)
    assert bytes(coder.decode(ids)[0]) == "".join(texts).encode()


def test_coder_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    coder = bpe.Coder(bpe.read_ranks(RANKS), P.PATTERN)
    for text in strange_texts(2, 20):
        assert coder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_encode_odd_rows(spark, library):
    got = bpe.encode_decode(documents(spark, ODD), RANKS, P.PATTERN).collect()
    want = sorted((i or -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD)
    assert sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in got) == want
    empty = documents(spark, [])
    assert bpe.encode_decode(empty, RANKS, P.PATTERN).collect() == []


def test_counter_equals_library():
    texts = strange_texts(3, 400) + ["a<|endoftext|>b<|startoftext|><|endoftext|>c <|endof", "ab" * 3000, "ΑΣ Σ ΑΣΑ"]
    want = [len(e.ids) for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(WORDS).count(texts).tolist() == want


def test_states_do_not_depend_on_chunks(monkeypatch):
    go, _ = tokencount._splitter()
    kinds = np.random.default_rng(1).integers(0, 10, 2000).astype(np.uint8)
    state, want = 0, []
    for kind in kinds:
        want.append(state)
        state = go[state, kind]
    for size in (1, 7, 256, 5000):
        monkeypatch.setattr(tokencount, "CHUNK", size)
        assert tokencount.run_states(kinds, go).tolist() == want


def test_count_odd_rows(spark):
    lib = Tokenizer.from_file(WORDS)
    got = tokencount.count_tokens(documents(spark, ODD), WORDS, limit=10).collect()
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    want = sorted((i or -1, len((t or "").encode()), k, k > 10) for (i, t), k in zip(ODD, n))
    assert sorted((r[0] or -1, *r[1:]) for r in got) == want
    assert tokencount.count_tokens(documents(spark, []), WORDS, limit=10).count() == 0


SECRETS = [
    (1, "x password = 'abcdefgh1' y"),
    (2, "token=secret:token:abcdefghij"),  # the first match is too short and is dropped whole
    (3, "AKIA1234567890AB and AKIA12 and " + "0f" * 16),
    (4, "id 9fQ2xL7vR4tB8nW3kZ6p here"),  # only entropy finds it
    (5, "word " + "abcdefghijklmnopqrst" * 2 + " 550e8400-e29b-41d4-a716-446655440000"),
    (6, "😀 api_key: Zz9/+=._-a1 ünd API-KEY=x apikey=\"12345678\""),
    (7, None), (8, ""), (None, "secret: 12345678"), (1, "x password = 'abcdefgh1' y"),
    (9, "password=" + "q" * 50000),
]


def test_secrets_against_plain_version(spark):
    flags = re.IGNORECASE | re.ASCII
    patterns = {
        "assign": (
            re.compile(
                r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", flags
            ), 2, 8,
        ),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
        "hex": (re.compile("[0-9a-f]+"), 0, 32),
    }
    names = list(patterns)
    found = secret_scan.find_secrets(documents(spark, SECRETS))
    base = secret_scan.span_text(secret_scan.of_kinds(F.col("spans"), *names))
    got = sorted((r[0] or -1, r[1]) for r in found.select("doc_id", base).collect())
    want = []
    for i, text in SECRETS:
        spans = [
            (m.start(), k, m.end(), n)
            for k, (n, (p, g, least)) in enumerate(patterns.items())
            for m in p.finditer(text or "")
            if len(m.group(g)) >= least
        ]
        want.append((i or -1, ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))))
    assert got == sorted(want)
    entropy = {
        r.doc_id: [s.kind for s in r.spans if s.kind.startswith("entropy")] for r in found.collect() if r.doc_id
    }
    assert entropy[4] == ["entropy_base64"] and entropy[5] == []


def test_entropy_beside_other_spans_and_words(spark):
    key = "9fQ2xL7vR4tB8nW3kZ6pT1yH5cJ0mD"
    digits = "0f1e2d3c4b5a69788796a5b4"
    uuid = "550e8400-e29b-41d4-a716-446655440000"
    texts = {
        f"{key}/token=abcd1234": [(0, 30), (31, 45)],
        f"abc-{digits}-{key}": [(4, 28), (29, 59)],
        f"/example/{key}": [(9, 39)],
        f"{key}-{uuid}": [(0, 30)],
        f"x {key}example y": [],
        (key * 3) + "xXxX" + (key * 3): [(0, 184)],
        f"/{key}": [(0, 31)],
        "docs/example/some-long/path_of/words": [],
    }
    rows = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secret_scan.find_secrets(rows).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_entropy_slides(spark):
    rnd = random.Random(2)
    strings = ["".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (19, 20, 21, 60)] + ["a" * 30]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for row in df.select("s", secret_scan.peak_entropy(F.col("s"), "0123456789abcdef").alias("h")).collect():
        windows = [Counter(row.s[i : i + 20]) for i in range(len(row.s) - 19)]
        want = [-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows]
        assert row.h == pytest.approx(max(want)) if want else row.h is None


def test_masked(spark):
    rows = secret_scan.with_spans(documents(spark, SECRETS), spans="found")
    texts = {r[0]: r[1] for r in rows.select("doc_id", secret_scan.masked(F.col("text"), F.col("found"))).collect()}
    assert texts[1] == "x [SECRET]' y" and texts[8] == "" and texts[9] == "[SECRET]"


W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_passages(docs, items):
    windows = {}
    for i, text in items:
        words = W.findall(lower(text))
        for k in range(max(1, len(words) - 12) if words and i is not None else 0):
            windows.setdefault(tuple(words[k : k + 13]), set()).add(i)
    out = []
    for i, text in docs:
        words, hit, found = W.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if (w := tuple(words[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[w]
        out.append((i or -1, len(words), len(hit), sorted(found)))
    return sorted(out)


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from all"),
    (2, "short item"), (3, "a a a"), (4, None), (5, "  ! "), (None, "one"), (1, "and runs"), (6, "fox Jumps-over THE"),
]
TEXTS = ODD + [(20, "a a a a a. short item, a a"), (21, "short"), (22, ("short item " * 50))]


@pytest.mark.parametrize("block", [2 << 20, 40])
def test_passages_against_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_passages(documents(spark, TEXTS), benchmark)
    rows = found.withColumn("n_hit", decontaminate.words_hit(F.col("spans"))).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, sorted(r["items"])) for r in rows) == plain_passages(TEXTS, ITEMS)


def test_passages_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.find_passages(documents(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and all(r.spans == [] and r["items"] == [] for r in rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_passages(documents(spark, []), items).count() == 0


def test_index_locates_all():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 4, 300)
    run_end = rng.random(300) < 0.1
    run_end[-1] = True
    index = decontaminate.FMIndex(symbols, run_end, 3)
    runs = np.cumsum(run_end) - run_end
    for size in (1, 2, 5):
        phrases = np.array([[a, *rng.integers(1, 4, size - 1)] for a in (1, 2, 3)])
        low, high = index.search(phrases, np.full(3, size))
        for p, a, b in zip(phrases, low, high):
            want = [
                i for i in range(300 - size + 1)
                if (symbols[i : i + size] == p).all() and runs[i] == runs[i + size - 1]
            ]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_secrets_of_very_long_texts(spark):
    """Time grows with the text's length, and every span is found."""
    import time

    rnd = random.Random(1)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    run = "".join(rnd.choice(signs) for _ in range(300_000))
    many = "".join(f"token={rnd.randrange(10**9):010d} x " for _ in range(30_000))
    rows = [(1, "see " + run), (2, many), (3, "é" * 1_000_000)]
    start = time.time()
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(documents(spark, rows)).collect()}
    assert time.time() - start < 120
    covered = sum(s.end - s.start for s in got[1])
    assert covered > 0.9 * len(run)
    assigned = [(s.start, s.end) for s in got[2] if s.kind == secret_scan.BASE_KINDS[0].name]
    assert assigned == [(m.start(), m.end()) for m in re.finditer(r"token=[0-9]+", many)]
    assert got[3] == []

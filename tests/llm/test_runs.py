"""Runs of repeated words against a plain version."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.helpers import CLASHING, ODD, documents, spaced
from tillscope.llm import queries, runs


def plain_runs(w):
    """Maximal repetitions by trying every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def plain_row(doc_id, text, planted=True):
    w = spaced(text)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if planted and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    long = [(a, b - a, q) for a, b, q in plain_runs(w) if b - a >= max(6, 4 * q)]
    gone = {i for a, length, q in long for i in range(a + q, a + length)}
    return n, sorted(long, key=lambda r: (r[0], r[2])), " ".join(x for i, x in enumerate(w) if i not in gone)


@given(st.lists(st.lists(st.integers(0, 2), max_size=24), max_size=4))
def test_all_runs_of_small_texts(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes = np.array([v for t in texts for v in t], np.uint64) * np.uint64(77)
    codes, begin = runs._codes(hashes, first)
    got = sorted(zip(*(v.tolist() for v in runs.runs_of(codes))))
    assert got == sorted((a + begin[i], b + begin[i], q) for i, t in enumerate(texts) for a, b, q in plain_runs(t))


def rows():
    rnd = random.Random(12)
    out = list(ODD)
    for i in range(100, 200):
        alphabet = [f"w{j}" for j in range(rnd.choice([1, 2, 3, 300]))]
        out.append((i, "\t ".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 3, 8, 40, 90])))))
    out.append((200, "x y z " * 30 + "é " * 9 + "tail " + "A a " * 7))
    out.append((201, "alone " * 5))
    out.append((202, "six " * 6))
    return out


@pytest.mark.parametrize("planted", [True, False])
def test_runs_against_plain_version(spark, planted):
    df = documents(spark, rows())
    from pyspark.sql import functions as F

    loop = (F.crc32(F.col("doc_id").cast("string")), queries.planted_loop) if planted else (None, None)
    got = runs.find_runs(df, *loop).collect()
    want = [(i, *plain_row(i, text, planted)) for i, text in rows()]
    mine = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_very_long_texts(spark):
    rnd = random.Random(3)
    texts = {
        1: "a " * 400_000,
        2: " ".join(f"p{i % 1000}" for i in range(300_000)),
        3: " ".join(rnd.choice("abcdefgh") for _ in range(200_000)),
        4: "z" * 3_000_000,
    }
    got = {r.doc_id: r for r in runs.find_runs(documents(spark, list(texts.items()))).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 400_000, 1)] and got[1].collapsed == "a"
    assert [tuple(r) for r in got[2].runs] == [(0, 300_000, 1000)] and len(got[2].collapsed.split()) == 1000
    assert got[3].n_words == 200_000 and all(r.length >= max(6, 4 * r.period) for r in got[3].runs)
    assert got[4].collapsed == texts[4]


def test_runs_query(spark, tmp_path):
    import hashlib

    documents(spark, rows(), CLASHING).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_runs(spark, str(tmp_path)).collect()

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for i, text in rows():
        _, found, collapsed = plain_row(i, text)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        listed = "".join(f"{a},{length},{q}\n" for a, length, q in found)
        want.append((i, len(found), *best, milli, digest(listed), digest(collapsed)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_runs_of_nothing(spark):
    assert runs.find_runs(documents(spark, [])).count() == 0

"""Fingerprints and their links against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import ODD, documents, lower, spaced
from tillscope.llm import queries, simhash


def plain_fingerprint(text, k=3):
    w = spaced(lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, near):
    """Label of each code: the first one reachable."""
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if near(codes[i], codes[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(codes))]


def near(a, b):
    return (a ^ b).bit_count() <= 3


def cloud(rnd, n, centres=3, flips=8):
    middle = [rnd.getrandbits(64) for _ in range(centres)]
    out = set()
    for _ in range(n):
        code = rnd.choice(middle)
        for _ in range(rnd.randrange(flips)):
            code ^= 1 << rnd.randrange(64)
        out.add(code)
    return sorted(out)


@pytest.mark.parametrize("seed,compared", [(0, 64), (1, 2000), (2, 2_000_000)])
def test_index_against_all_pairs(monkeypatch, seed, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rnd = random.Random(seed)
    codes = np.array(cloud(rnd, 300) + [rnd.getrandbits(64) for _ in range(100)], np.uint64)
    group = np.array([rnd.randrange(4) for _ in codes])
    by = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[by], group[by]
    got = simhash.GrayIndex(codes, group).link()
    pairs = list(zip(codes.tolist(), group.tolist()))
    assert got.tolist() == plain_components(pairs, lambda a, b: a[1] == b[1] and near(a[0], b[0]))


def test_gray_neighbours_differ_by_one_bit():
    codes = np.arange(1 << 10, dtype=np.uint64)
    by = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(by[1:] ^ by[:-1]) == 1).all()


def test_blocks_cover_all_near_pairs():
    rnd = random.Random(5)
    levels = simhash.block_masks(4)
    for _ in range(200):
        differ = sum(1 << b for b in rnd.sample(range(64), 3))
        inside = [0]
        for masks in levels:  # whichever group a pair is in, one of its parts holds it as well
            inside = [4 * i + b for i in inside for b in range(4) if not masks[4 * i + b] & differ]
            assert inside
    assert all(m.bit_count() in (43, 44) for m in levels[-1])


@pytest.mark.parametrize("group_rows,indexed", [(4_000, 400_000), (3, 5)])
def test_links_against_all_pairs(spark, monkeypatch, group_rows, indexed):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "INDEXED", indexed)
    codes = cloud(random.Random(7), 250, 2, 9)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    links = simhash.link_fingerprints(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()
    found = {}

    def find(x):
        while found.get(x, x) != x:
            x = found[x]
        return x

    for r in links:
        assert r.a != r.b
        found[find(r.a)] = find(r.b)
    want = plain_components(codes, near)
    mine = [find(c) for c in signed]
    assert len(set(mine)) == len(set(want)) and len(set(zip(mine, want))) == len(set(want))


def test_near_copies_against_plain_version(spark, tmp_path):
    rnd = random.Random(2)
    base = [f"v{rnd.randrange(400)}" for _ in range(150)]
    rows = list(ODD)
    for i in range(100, 150):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 30])):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows += [(200, "Two words"), (201, "TWO\twords"), (1, "another text of document 1"), (None, None), (None, "only here, without a key")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_simhash(spark, str(tmp_path)).collect()
    codes = [plain_fingerprint(text) for _, text in rows]
    label = plain_components(codes, near)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = [(i, f"{code:016x}", least.get(c)) for (i, _), code, c in zip(rows, codes, label)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_very_long_text_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 1000)
    long = " ".join(f"w{i % 5000}" for i in range(50_000))
    got = simhash.link_near_copies(documents(spark, [(1, long), (2, "y" * 2_000_000)])).collect()
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in got} == {1: plain_fingerprint(long), 2: plain_fingerprint("y" * 2_000_000)}
    assert simhash.link_near_copies(documents(spark, [])).count() == 0

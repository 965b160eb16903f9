"""Near copies, repeated passages, nearest neighbours and quotes against plain versions."""

import os
import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.llm.helpers import ODD, PLAIN, documents, lower, spaced
from tillscope.llm import components, jaccard, nearest, queries, quotes, substrings
from tillscope.session import scratch_dir


def changed(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=4):
    """Odd rows, families of near copies around one text, and texts that share a line."""
    rnd = random.Random(seed)
    rows, n = list(ODD), 100
    for family in range(3):
        base = [f"f{family}x{i}" for i in range(80)]
        for _ in range(12):
            rows.append((n, changed(rnd, base, rnd.choice([0, 1, 1, 2, 3]))))
            n += 1
    line = " ".join(f"common{i}" for i in range(25))
    for i in range(15):
        rows.append((n, line + " " + " ".join(f"own{i}y{j}" for j in range(rnd.randrange(8)))))
        n += 1
    return rows


def plain_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            words = spaced(lower(text))
            sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent,members", [(4, 85, 10_000), (5, 80, 2)])
def test_links_against_plain_version(spark, monkeypatch, k, percent, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    rows = corpus()
    got = jaccard.link_documents(documents(spark, rows), k=k, percent=percent).collect()
    want = plain_components(rows, k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 1  # the same text as document 1
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_links_by_shuffle_and_long_sketches(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "LONG_SET", 20)
    rows = corpus(9)
    got = jaccard.link_documents(documents(spark, rows)).where("doc_id is not null").collect()
    want = plain_components(rows, 4, 85)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_links_of_nothing(spark):
    assert jaccard.link_documents(documents(spark, [])).count() == 0
    rows = jaccard.link_documents(documents(spark, [(1, None), (2, "")])).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1), (2, 0, 2)]


def test_lists_are_dealt_once(spark, monkeypatch):
    dealt, stage = [], jaccard.stage

    def watched(df, label):
        if label == "shared":
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            dealt.extend(x for x in plan.split("\n") if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x)
        return stage(df, label)

    monkeypatch.setattr(jaccard, "stage", watched)
    jaccard.link_documents(documents(spark, corpus()))
    assert len(dealt) == 1


def test_tables_of_the_join_go_when_read(spark):
    before = set(os.listdir(scratch_dir(spark)))
    rows = jaccard.link_documents(documents(spark, corpus()))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(scratch_dir(spark))) - before}
    assert not left & {"signatures", "shared", "entries", "rough", "meetings", "relations"}
    assert rows.count() == len(corpus())


def test_common_shingles_are_counted_over_pieces(spark):
    rows = [(i, f"one line that all have own{i} a{i} b{i} c{i}" + " and one of many" * (i % 2)) for i in range(20)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        common, ranks = jaccard._common_shingles(documents(spark, rows).coalesce(1), 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(common) == 3 and sorted(ranks) == [1, 2, 3]  # two of the line that all have, one of the other
    assert list(jaccard._ranks(common, common, ranks)) == list(ranks)
    assert list(jaccard._ranks(common + np.uint64(1), common, ranks)) == [0, 0, 0]
    none = np.zeros(0, np.uint64)
    assert list(jaccard._ranks(common, none, none)) == [0, 0, 0]


def test_sets_without_a_near_size_leave_their_list(spark):
    sets = [(1, 10, [5, 6]), (2, 100, [5, 7]), (3, 10, [6]), (4, 10, [6]), (5, 10, [8, 9]), (6, 10, [9])]
    entries = jaccard._entries(spark.createDataFrame(sets, "node long, n long, prefix array<long>"), 85).collect()
    assert sorted((r.token, r.node, r.head.node, r.prior and r.prior.node) for r in entries) == [
        (6, 1, 1, None), (6, 3, 1, None), (6, 4, 1, 3),
    ]


def test_links_of_large_and_small_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_SET", 70)
    rnd, rows = random.Random(2), []
    for family in range(4):
        base = [f"f{family}x{i}" for i in range(60 + 10 * family)]
        for n in range(15):
            text = changed(rnd, base, rnd.choice([0, 1, 2])) + " " + " ".join(f"e{family}y{i}" for i in range(n))
            rows.append((len(rows), "common words at first " * (n % 2) + text))
    got = jaccard.link_documents(documents(spark, rows)).collect()
    want = plain_components(rows, 4, 85)
    assert len(set(want.values())) > 4
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components_of_a_chain(spark):
    links = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 101), (100, 101)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def plain_removal(rows, window):
    seen, out = set(), {}
    for i, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        words, cover = spaced(text), set()
        for j in range(len(words) - window + 1):
            w = tuple(words[j : j + window])
            if w in seen:
                cover.update(range(j, j + window))
            seen.add(w)
        out[i] = (len(words), len(cover), " ".join(w for j, w in enumerate(words) if j not in cover))
    return out


@pytest.mark.parametrize("hot,batch", [(20_000, 100_000), (4, 5)])
def test_removal_against_plain_version(spark, monkeypatch, hot, batch):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substrings, "BATCH_SEGMENTS", batch)
    rows = corpus(6) + [(500, "a " * 70), (501, "b a " * 40), (502, PLAIN + " " + PLAIN + " x"), (503, "a " * 45)]
    got = substrings.remove_repeats(documents(spark, rows)).collect()
    want = plain_removal(rows, 20)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.n_removed, r.kept) == (0, PLAIN)
        else:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_automaton_matches():
    rnd = random.Random(8)
    sequences = [[rnd.randrange(3) for _ in range(30)] for _ in range(6)]
    automaton = substrings.SuffixAutomaton()
    held = set()
    for s in sequences:
        for end, m in enumerate(automaton.matches(s)):
            longest = max(n for n in range(end + 2) if n == 0 or tuple(s[end + 1 - n : end + 1]) in held)
            assert m == longest
        automaton.add(s)
        held |= {tuple(s[i:j]) for i in range(30) for j in range(i + 1, 31)}


SCHEMA = "vec_id long, embedding array<float>, label int, v string, leaf long, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA)


def test_nearest_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 220)]  # a very common vector
    rows += [(220, None), (240, []), (260, [0.0] * 8), (280, [float("nan")] * 8), (300, [1.0] * 7), (None, rows[1][1])]
    rows += [(320, [float("inf")] * 8), (340, [None] * 8), rows[20]]
    got = nearest.search(vectors(spark, rows), every=20, k=20, recall=1.0).collect()
    real = {i: np.float32(v).astype(float) for i, v in rows[:220]}
    for q in range(0, 220, 20):
        want = sorted(((-float(real[q] @ v), i) for i, v in real.items() if i != q))[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in want])
        assert len({m[1] for m in mine} & {i for _, i in want}) >= 19
    assert {r.query_id for r in got} == set(range(0, 220, 20))


def test_nearest_of_few(spark):
    got = nearest.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])]), every=20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert nearest.search(vectors(spark, []), every=20).count() == 0


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    got = nearest.search(vectors(spark, [(i, p.tolist()) for i, p in enumerate(points)]), every=20).toPandas()
    points = points.astype(np.float32).astype(float)
    hits = 0
    for q, rows in got.groupby("query_id"):
        score = points @ points[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(rows.vec_id))
    assert hits / len(got) >= 0.9


MESSAGES = [
    (1, 0, "user", "Hello there, my friend\nsecond line here\n\nA new paragraph"),
    (1, 1, "bot", "> Hello there, my friend\nThanks!"),
    (1, 2, "user", ">> hello THERE my friend\n> Thanks!\n> \nok fine so\n> second line here"),
    (1, 5, None, " > >thanks you\r\nxx"), (1, 9, "u", None), (2, 3, "u", "> nothing known\n"), (2, 4, "u", "x"),
    (None, 1, "u", "z"), (2, None, "u", "q"), (2, 4, "a", "repeat"),
    (1, 7, "bot", "> ok fine so\n>> second line here\nyes yes yes"), (1, 8, "bot", ">ok fine so\nbut yes yes yes"),
    (3, 0, "u", "Yes, ok"), (3, 1, "a", "A1 alpha\n\nA2 beta\n> q\nB1 gamma\nB2 delta"), (3, 2, "u", "something else"),
    (3, 3, "a", "> Yes, ok\nshort"), (3, 4, "u", "> a2 BETA\n> b1, gamma\ntwo lines, another's between"), (3, 5, "u", "x"),
    (3, 6, "u", "> A1 alpha\n> A2 beta\n>> q\n> B1 gamma\n> B2 delta\nall"), (3, 7, "a", "> ...\n> A1 alpha\n> B2 delta\nno run"),
]


def test_quotes_against_sql(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK_TURNS", 3)
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    got = quotes.reply_paths(quotes.link_quotes(df)).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(queries.ORACLE_SQL["op2_quote_linking"]).df()
    plain = [
        sorted(repr([None if pd.isna(v) else v for v in r]) for r in t[sorted(t)].astype(object).itertuples(index=False))
        for t in (got, want)
    ]
    assert len(got) == 17 and [x.replace(".0", "") for x in plain[0]] == [x.replace(".0", "") for x in plain[1]]
    reply = {(r.conv_id, r.turn): r.reply_to for r in got.itertuples()}
    assert reply[1, 2] == 1 and reply[1, 7] == 2 and reply[1, 9] == 8
    assert (reply[3, 3], reply[3, 4], reply[3, 6], reply[3, 7]) == (0, 1, 1, 6)
    linked = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked) for r in got.itertuples()}
    assert linked[3, 6] == (3, 2) and linked[3, 7] == (1, 0) and linked[3, 4] == (1, 1)
    empty = quotes.reply_paths(quotes.link_quotes(df.limit(0)))
    assert empty.count() == 0

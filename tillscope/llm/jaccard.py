"""Documents whose word shingles agree, by an exact set similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.lookup import attach
from tillscope.llm.components import components
from tillscope.llm.words import SPACED_LOWER, distinct_shingles, mix, pieces, signed, words_of
from tillscope.session import drop_staged, stage

#: Words of a shingle, and the least intersection in hundredths of the union.
SHINGLE, PERCENT = 4, 85
#: The commonest shingles, which every set lists last, and how many are counted together to find
#: them. Only speed depends on which they are.
MOST_COMMON = 1 << 16
COUNTED = 1 << 21
#: Longs of a set's sketch; each bit is the parity of the elements that fall on it.
SKETCH = 8
#: A set of so many shingles also has a longer sketch: its longs, for sets of so many times that.
LONG_SET = 1024
LONG_SKETCHES = ((1, 16), (2, 32), (4, 64), (8, 256))
#: Sets that are compared with one other set in one place.
MEMBERS = 10_000
#: Rows of ids that may be broadcast (32 MB); more are joined by a shuffle.
BROADCAST_ROWS = 4_000_000


_BITS = [f"s{i}" for i in range(SKETCH)]


def only(big: DataFrame, ids: DataFrame, *by: str, how: str = "left_semi", width: int = 1) -> DataFrame:
    """The rows of ``big`` whose key is in ``ids`` (``left_anti``: is not), without moving ``big`` while ``ids`` is small.

    A row of ``ids`` counts as ``width`` of those that may be broadcast.
    """
    if ids.count() * width <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return big.join(ids, list(by), how)


def _common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, sorted, and the rank of each: 1 for the least common of them.

    Several pieces are counted together, so that a shingle of a thousandth of the documents is seen.
    """

    def often(shingles: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(shingles), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(value[n >= 3])), pa.array(n[n >= 3])], ["s", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in pieces(batches, "text"):
            shingles, _ = distinct_shingles(words_of(piece.column(1), SPACED_LOWER), k)
            held.append(shingles)
            size += len(shingles)
            if size >= COUNTED:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)

    counts = docs.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()
    common = np.array([r["s"] for r in reversed(top)], np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], order + 1


def _ranks(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rank of every shingle, 0 for those that are not common."""
    if not len(common):
        return np.zeros(len(shingles), np.int64)
    at = np.searchsorted(common, shingles)
    at[at == len(common)] = 0
    return np.where(common[at] == shingles, ranks[at], 0)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that link share a shingle among so many first ones of each."""
    return n - (percent * n + 99) // 100 + 1


def _set_hashes(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of every set: of the sum of its elements' hashes."""
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return signed(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))


def _parities(shingles: np.ndarray, owner: np.ndarray, sets: int, longs: int) -> np.ndarray:
    """The sketch of every set: whether an odd number of its elements falls on each bit."""
    bits = longs * 64
    cell = owner * bits + (shingles % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(cell, minlength=sets * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(sets, bits), axis=1).view(np.int64).reshape(sets, longs)


def _signatures(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """Of every document: the size and hash of its set, its first shingles, and its sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    # _verified asks for longer sketches by the same limit
    long_set = LONG_SET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            shingles, first = distinct_shingles(words_of(piece.column(1), SPACED_LOWER), k)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            node = _set_hashes(shingles, first).view(np.uint64)
            # the order of all sets: rare shingles by hash, then common ones, the commonest last
            order = np.lexsort((shingles, _ranks(shingles, *sent.value), owner))
            place = np.arange(len(shingles)) - np.repeat(first[:-1], n)
            keep = place < np.repeat(prefix_length(n, percent), n)
            sketch = _parities(shingles, owner, len(n), SKETCH)
            longs = np.zeros(len(n), np.int64)
            for times, size in LONG_SKETCHES:
                longs[n >= times * long_set] = size
            at = np.concatenate([np.zeros(1, np.int64), np.cumsum(longs)])
            wide = np.zeros(at[-1], np.int64)
            for size in np.unique(longs[longs > 0]):
                large = longs == size
                row = (np.cumsum(large) - 1)[owner[large[owner]]]
                place_of = at[:-1][large][:, None] + np.arange(size)
                wide[place_of] = _parities(shingles[large[owner]], row, int(large.sum()), int(size))
            wide = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(wide))
            lengths = np.where(n > 0, prefix_length(n, percent), 0)
            prefix = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                pa.array(signed(shingles[order][keep])),
            )
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n), pa.array(signed(node)), prefix, wide, *map(pa.array, sketch.T.copy())],
                ["id", "n", "node", "prefix", "wide", *_BITS],
            )

    longs = ", ".join(f"{c} long" for c in _BITS)
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, node long, prefix array<long>, wide array<long>, {longs}")


def _ratio_fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _most_shared(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """The most elements that two sets of these sizes can share which hold a shingle at these places."""
    return F.least(pos, at) + F.least(n - pos, m - at)


def _places_fit(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    return (100 + percent) * _most_shared(n, pos, m, at) >= percent * (n + m)


def _size(packed: Column) -> Column:
    return F.shiftright(packed, 31)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND((1 << 31) - 1).cast("int")


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """The index: lists of the sets that begin with a shingle, single ones left out.

    Near copies share many first shingles, and the lists of most of these hold the very same sets. Of lists with equal members one is
    kept, as any pair of sets that meets in one of them meets in the other. A list stands in the order of the sets' sizes, and a set
    too far in size from both its neighbours links with none of the list and leaves it. Every entry knows its neighbour, and
    the head of its list: the set that stands in most lists, which among near copies is the one closest to all.
    """
    # size and place in one long, which keeps the largest shuffle narrow
    listed = sets.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "node", (F.shiftleft("n", 31) + F.col("pos")).alias("packed")
    )
    # dealt once as they are, before hashes are added. Both ways below read the same shuffle, as long as they ask for the
    # same rows: the semi-join adds this filter to its side
    listed = listed.where("token is not null").repartition("token")
    members = Window.partitionBy("token")
    told = [F.bit_xor(F.xxhash64("node", F.lit(i))).over(members).alias(f"told{i}") for i in (1, 2)]
    first = F.min(F.struct("packed", "node")).over(members)
    shared = listed.select("*", F.count("*").over(members).alias("members"), first.alias("first"), *told)
    shared = shared.where("members > 1")
    heads = shared.where((F.col("node") == F.col("first.node")) & (F.col("packed") == F.col("first.packed")))
    one_each = heads.groupBy("members", "told1", "told2").agg(F.min("token").alias("token"))
    kept = one_each.select("token")
    shared = shared.select("token", "node", "packed", "members").join(kept, "token", "left_semi")
    order = Window.partitionBy("token").orderBy("packed", "node")
    shared = shared.withColumns(
        {"last": F.lag("packed").over(order), "last_node": F.lag("node").over(order), "next": F.lead("packed").over(order)}
    )
    n, pos = _size(F.col("packed")), _place(F.col("packed"))
    beside = {c: (_size(F.col(c)), _place(F.col(c))) for c in ("last", "next")}
    meets = {c: _places_fit(n, pos, *at, percent) for c, at in beside.items()}
    near = F.lit(False)
    for c, (size, _) in beside.items():
        # of two sets the places count too
        fits = F.when(F.col("members") == 2, meets[c]).otherwise(_ratio_fits(n, size, percent))
        near |= F.col(c).isNotNull() & fits
    shared = shared.where(near)
    shared = shared.select(
        "token",
        "node",
        n.alias("n"),
        pos.alias("pos"),
        F.when(meets["last"], F.struct(F.col("last_node").alias("node"), beside["last"][0].alias("n"))).alias("prior"),
    )
    shared = stage(shared, "shared")
    one = F.struct("node", "n", "pos")
    lists = shared.groupBy("node").agg(F.count("*").alias("lists"))
    best = Window.partitionBy("token").orderBy(F.desc("lists"), "node")
    entries = shared.join(lists, "node").withColumn("head", F.first(one).over(best)).drop("lists")
    entries = stage(entries, "entries")
    drop_staged(shared)
    return entries


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct unordered pairs (a, na, b, nb) of x, nx, y, ny whose sizes allow a link."""
    ordered = F.col("x") < F.col("y")
    return (
        rows.where((F.col("x") != F.col("y")) & _ratio_fits(F.col("nx"), F.col("ny"), percent))
        .select(
            F.least("x", "y").alias("a"),
            F.when(ordered, F.col("nx")).otherwise(F.col("ny")).alias("na"),
            F.greatest("x", "y").alias("b"),
            F.when(ordered, F.col("ny")).otherwise(F.col("nx")).alias("nb"),
        )
        .distinct()
    )


def _overlap_bound(x: str, y: str) -> Column:
    """The most elements two sets can share: a bit that differs is an element of one only."""
    differ = sum((F.bit_count(F.col(f"{c}_{x}").bitwiseXOR(F.col(f"{c}_{y}"))) for c in _BITS), F.lit(0))
    return F.least(F.floor((F.col(f"n_{x}") + F.col(f"n_{y}") - differ) / 2), F.col(f"n_{x}"), F.col(f"n_{y}"))


def _side(rows: DataFrame, side: str, *kept: str) -> DataFrame:
    """The columns renamed for one side of a pair."""
    return rows.select(*[F.col(c) if c in kept else F.col(c).alias(f"{c}_{side}") for c in rows.columns])


def _folded(sketch: str, size: Column) -> Column:
    """A longer sketch as one of ``size`` longs: elements fall on the same bit of the longs that are laid over each other."""
    whole = F.col(sketch)
    over = F.transform(
        F.slice(whole, F.lit(1), size),
        lambda first, i: F.aggregate(
            F.sequence(F.lit(1), (F.size(whole) / size).cast("int") - 1),
            first,
            lambda x, j: x.bitwiseXOR(F.get(whole, i + j * size)),
        ),
    )
    return F.when(F.size(whole) == size, whole).otherwise(over)


def _sketches(sets: DataFrame) -> DataFrame:
    """The sketches of every set, ``long`` the longer one of a large set."""
    short = sets.select("node", F.lit(False).alias("long"), F.array(*_BITS).alias("sketch"))
    return short.union(sets.where(F.size("wide") > 0).select("node", F.lit(True), "wide"))


def _sketch_bound() -> Column:
    """As ``_overlap_bound``, of a pair with two sketches."""
    size = F.least(F.size("sketch_a"), F.size("sketch_b"))
    pairs = F.zip_with(
        _folded("sketch_a", size), _folded("sketch_b", size), lambda x, y: F.bit_count(x.bitwiseXOR(y))
    )
    differ = F.aggregate(pairs, F.lit(0), lambda n, x: n + x)
    return F.least(F.floor((F.col("na") + F.col("nb") - differ) / 2), "na", "nb")


def _meetings(pairs: DataFrame) -> DataFrame:
    """Where each set has to go: of a pair the one with more partners is the hub, the other comes to it.

    A hub with very many members has several places, each with a copy of its set.
    """
    ends = pairs.select("a", "b").union(pairs.select("b", "a").toDF("a", "b"))
    degree = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    met = pairs.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & F.expr("a < b"))
    members = met.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.pmod(
            F.xxhash64(F.when(first, F.col("b")).otherwise(F.col("a"))),
            F.ceil(F.greatest("da", "db") / MEMBERS),
        ).alias("place"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"),
    )
    hubs = members.select("hub", "place").distinct().select("hub", "place", F.col("hub").alias("node"))
    return members.withColumn("member", F.lit(True)).union(hubs.withColumn("member", F.lit(False)))


def _brought(docs: DataFrame, sets: DataFrame, meetings: DataFrame, k: int) -> DataFrame:
    """The sets, made again from the texts, at their places."""
    chosen = sets.select("node", "id").join(
        meetings.groupBy("node").agg(F.collect_list(F.struct("hub", "place", "member")).alias("to")), "node"
    )
    chosen = stage(chosen, "chosen")
    small = F.broadcast(chosen) if meetings.count() <= BROADCAST_ROWS else chosen
    texts = docs.join(small, "id").select("node", "text", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            shingles, first = distinct_shingles(words_of(piece.column(1), SPACED_LOWER), k)
            lists = piece.column(2)
            count = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(piece.num_rows), count)
            # another text may share the id
            real = (_set_hashes(shingles, first) == piece.column(0).to_numpy())[owner]
            flat = lists.flatten().filter(pa.array(real))
            owner = owner[real]
            values = [shingles[first[i] : first[i + 1]].tobytes() for i in owner]
            yield pa.RecordBatch.from_arrays(
                [flat.field(0), flat.field(1), flat.field(2), piece.column(0).take(pa.array(owner)), pa.array(values, pa.binary())],
                ["hub", "place", "member", "node", "value"],
            )

    return texts.mapInArrow(run, "hub long, place long, member boolean, node long, value binary")


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by hub and place, the hub first: every member's overlap with its hub."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for h, member, node, value in zip(
            batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
        ):
            elements = np.frombuffer(value.as_buffer(), np.uint64)
            if not member:
                hub, own = h, elements
            elif h == hub:
                both = np.concatenate([own, elements])
                both.sort()
                out.append((h, len(own), node, len(elements), np.count_nonzero(both[1:] == both[:-1])))
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["x", "nx", "y", "ny", "overlap"]
        )


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Every pair with ``linked`` and ``most``, which its similarity doesn't exceed.

    Sketches rule most pairs out; the longer ones are as long as their sets need, and a pair of two large sets brings these alone.
    Only for the rest the sets are made again from the texts, meet once for each pair, and are intersected.
    """
    sketches = _sketches(sets)
    rough = pairs.withColumn("long", F.least("na", "nb") >= LONG_SET)
    for side in "ab":
        rough = rough.join(sketches.toDF(side, "long", f"sketch_{side}"), [side, "long"])
    rough = stage(
        rough.select("a", "na", "b", "nb", _sketch_bound().alias("overlap")).withColumn("linked", _links(percent)), "rough"
    )
    meetings = stage(_meetings(rough.where("linked").select("a", "b")), "meetings")
    brought = _brought(docs, sets, meetings, k).repartition("hub", "place")
    exact = brought.sortWithinPartitions("hub", "place", "member", "node").mapInArrow(
        _intersections, "x long, nx long, y long, ny long, overlap long"
    )
    swap = F.col("x") > F.col("y")
    exact = exact.select(
        F.least("x", "y").alias("a"),
        F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("na"),
        F.greatest("x", "y").alias("b"),
        F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("nb"),
        "overlap",
    ).distinct()
    both = rough.where("not linked").unionByName(exact.withColumn("linked", _links(percent)))
    most = (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("most")
    verified = stage(both.select("a", "b", "linked", most), "verified")
    drop_staged(rough)
    drop_staged(meetings)
    return verified


def _links(percent: int) -> Column:
    return 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))


def _relations(
    entries: DataFrame, checked: DataFrame, groups: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Entries of the lists that may hold further links.

    Adds the group so far, whether the head of the list links, the most it can agree, and the sketch.
    """
    a, b = F.least("head.node", "node"), F.greatest("head.node", "node")
    known = entries.withColumns({"a": a, "b": b}).join(checked, ["a", "b"], "left")
    shared = _most_shared(*map(F.col, ("n", "pos", "head.n", "head.pos")))
    ratio = shared / (F.col("n") + F.col("head.n") - shared)
    known = known.where("head.node <> node").select(
        "token", "node", "n", "pos",
        F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("most", ratio).alias("most"),
    )
    # the head itself is compared already; what is left needs two others, one far from the head
    near = (~F.col("linked")) & (F.col("most") >= 1 - 2 * (1 - percent / 100) - 1e-9)
    of_list = Window.partitionBy("token")
    open_ = (
        known.withColumns(
            {
                "apart": F.sum((~F.col("linked")).cast("int")).over(of_list),
                "near": F.sum(near.cast("int")).over(of_list),
                "met": F.sum(F.col("linked").cast("int")).over(of_list),
            }
        )
        .where("apart >= 2 or (near >= 1 and met >= 1)")
        .drop("apart", "near", "met")
    )
    return (
        open_.join(groups, "node", "left")
        .withColumn("group", F.coalesce("component", "node"))
        .drop("component")
        .join(sets.select("node", *_BITS), "node")
    )


def _remaining(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs that may still link two groups.

    Sets that link with the head of their list are one group already. What the head's answers say
    settles most other pairs: distances obey the triangle inequality, so a set
    that links with the head can't link with one that is too far from the head. In a list,
    entries too far apart in size, position or sketch are skipped.
    """
    far = 1 - percent / 100
    x, y = (_side(rows, s, "token") for s in "xy")
    total = F.col("n_x") + F.col("n_y")
    near = (
        (F.col("group_x") != F.col("group_y"))
        & _ratio_fits(F.col("n_x"), F.col("n_y"), percent)
        & _places_fit(*map(F.col, ("n_x", "pos_x", "n_y", "pos_y")), percent)
        & ((100 + percent) * _overlap_bound("x", "y") >= percent * total)
    )
    apart = x.where("not linked_x").join(y.where("not linked_y"), "token").where(near & F.expr("node_x < node_y"))
    derived = (
        x.where("linked_x")
        .join(y.where((~F.col("linked_y")) & (F.col("most_y") >= 1 - 2 * far - 1e-9)), "token")
        .where(near & (F.col("most_x") - F.col("most_y") <= far + 1e-9))
    )
    cut = [F.col("node_x").alias("x"), F.col("n_x").alias("nx"), F.col("node_y").alias("y"), F.col("n_y").alias("ny")]
    return _pairs(apart.select(*cut).union(derived.select(*cut)), percent)


def link_documents(
    df: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Size of every document's set of ``k``-word shingles, and its component of linked documents.

    Two documents link when their intersection is at least ``percent`` hundredths of their
    union. Returns ``key``, ``n_shingles`` and ``component_id``, the smallest key
    reachable by links. Words are lower-cased (A-Z); fewer than ``k`` words are one shingle; a null or
    empty text, or one without words, has none and links with nothing. Repeated rows
    are equal documents and each gives a row. A row without key has its size and the component of equal sets.

    Equal sets are one node. An index lists nodes by their first shingles (rare
    ones first); each node is compared with the first of its lists and with its
    neighbour there, and the components of these links and their answers leave few pairs to compare
    (see ``_remaining``). No pair that could join two components is left out.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    signatures = stage(_signatures(docs, _common_shingles(docs, k), k, percent), "signatures")
    rows = stage(signatures.select("id", "n", "node"), "rows")
    classes = stage(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id")), "classes")
    listed = only(signatures.where("n > 0"), classes.where("id is not null"), "node", "id")
    sets = stage(listed.drop("prefix"), "sets")
    entries = _entries(listed.select("node", "n", "prefix"), percent)
    # each table goes when what it is needed for is written
    drop_staged(signatures)
    heads = entries.where(_places_fit(*map(F.col, ("n", "pos", "head.n", "head.pos")), percent))
    heads = heads.selectExpr("head.node as x", "head.n as nx", "node as y", "n as ny")
    neighbours = entries.where("prior is not null").selectExpr("prior.node as x", "prior.n as nx", "node as y", "n as ny")
    first = stage(_pairs(heads.union(neighbours), percent), "pairs")
    checked = _verified(first, sets, docs, k, percent)
    links = checked.where("linked").select("a", "b")
    groups = stage(components(links), "groups")
    relations = stage(_relations(entries, checked, groups, sets, percent), "relations")
    drop_staged(entries)
    rest = _remaining(relations, percent).join(first, ["a", "b"], "left_anti")
    rest = stage(rest.select("a", "na", "b", "nb"), "pairs")
    drop_staged(relations)
    links = links.union(_verified(rest, sets, docs, k, percent).where("linked").select("a", "b"))
    joined = components(links).join(classes, "node")
    least = joined.groupBy("component").agg(F.min("id").alias("least"))
    of_node = joined.join(least, "component").select("node", "least")
    ids = classes.join(of_node, "node", "left").select("node", F.coalesce("least", "id").alias("class_id"))
    # the rows of very many copies are split
    found = attach(rows, ids, ["node"])
    return found.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("component_id"),
    )

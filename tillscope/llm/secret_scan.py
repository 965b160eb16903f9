"""Secrets in text: named patterns, and windows of high entropy. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a window whose entropy counts.
WINDOW = 20
#: What replaces a secret.
MASK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` is the part whose length must reach ``least``."""

    name: str
    pattern: str
    group: int
    least: int


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``letters`` with a window of at least ``bits`` of entropy are secrets."""

    name: str
    letters: str
    bits: float


BASE_KINDS = (
    Kind(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    # a run too short holds no longer one, so the least length may stand in the pattern
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", "0123456789abcdefABCDEF", 3.1),
    CharacterClass("entropy_base64", _UPPER + _UPPER.lower() + "0123456789+/_=-", 3.8),
)

_UUID = r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: Strings of high entropy that aren't secrets, as patterns of the whole string.
ALLOWED = (
    r"[A-Za-z]+",  # long words
    r"[A-Za-z]*[a-z]([/_=-][A-Za-z]*[a-z])+",  # paths and compounds of words
    r"[0-9]+",  # numbers
    _UUID,
)
#: What is no secret inside a longer string: UUIDs, and tokens that hold such a word. Longer tokens hold one by chance.
LONGEST_TOKEN = 64
ALLOWED_TOKENS = (
    r"(?<![A-Za-z0-9])(?:"
    + _UUID
    + r"(?![A-Za-z0-9])|(?=[A-Za-z0-9]{1,"
    + str(LONGEST_TOKEN)
    + r"}(?![A-Za-z0-9]))[A-Za-z0-9]*?(?i:example|placeholder|changeme|xxxx|0000|abcdef|123456)[A-Za-z0-9]*)"
)
_SEPARATORS = "[/+=_-]*"


#: Matches whose places are counted together, which bounds what is copied for each.
_CHUNK = 128


def _matches(text: Column, pattern: str, group: int) -> Column:
    """All matches: start, end, the match, and the group; starts come from the gaps' lengths.

    A list that grows is copied for each further match, so matches are placed in chunks, each from the
    lengths of all before it.
    """
    item = "array<struct<start:int,end:int,hit:string,part:string>>"
    hits = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda hit, part: F.struct(hit.alias("hit"), part.alias("part")),
    )
    # after the last match only a gap is left
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
    pairs = F.zip_with(
        gaps,
        hits,
        lambda gap, hit: F.struct(
            gap.alias("gap"), F.length(hit["hit"]).alias("size"), hit["hit"].alias("hit"), hit["part"].alias("part")
        ),
    )

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + x["size"]
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(one)).alias("found"))

    def placed(all_: Column, chunk: Column) -> Column:
        before = F.aggregate(
            F.slice(all_, F.lit(1), chunk * _CHUNK), F.lit(0), lambda at, x: at + x["gap"] + x["size"]
        )
        start = F.struct(before.alias("at"), F.array().cast(item).alias("found"))
        return F.aggregate(F.slice(all_, chunk * _CHUNK + 1, F.lit(_CHUNK)), start, step, lambda done: done["found"])

    def walked(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / _CHUNK).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda chunk: placed(all_, chunk)))

    # in a list of one, so that the pairs are worked out once
    found = F.transform(F.array(F.filter(pairs, lambda x: x["hit"].isNotNull())), walked)[0]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(item))


def _long_enough(found: Column, kind: Kind) -> Column:
    return F.filter(found, lambda x: F.length(x["part"]) >= kind.least)


def _as_spans(found: Column, rank: int, kind: str) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def peak_entropy(string: Column, letters: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of the string.

    The count of every letter in the window, and the sum of ``c log c`` over them, change
    by one letter that enters and one that leaves. Null for strings shorter than the window.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def g(count: Column) -> Column:
        return F.element_at(table, count + 1)

    def step(state: Column, x: Column) -> Column:
        count, enters, leaves = state["count"], x["enters"], x["leaves"]
        held = F.element_at(count, enters)
        gone = F.element_at(count, leaves)
        change = F.when(leaves == 0, g(held + 1) - g(held)).otherwise(
            g(held + 1) - g(held) + g(gone - 1) - g(gone)
        )
        moved = F.transform(
            count,
            lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0),
        )
        same = enters == leaves
        total = F.when(same, state["sum"]).otherwise(state["sum"] + change)
        full = F.when(x["at"] >= window, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(
            F.when(same, count).otherwise(moved).alias("count"), total.alias("sum"), full.alias("least")
        )

    # the string is cut into letters once; the one that leaves entered ``window`` places before
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(letters), c))
    behind = F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.length(string))
    places = F.transform(
        F.zip_with(F.slice(codes, F.lit(1), F.length(string)), behind, lambda x, y: F.struct(x.alias("enters"), y.alias("leaves"))),
        lambda x, i: F.struct((i + 1).alias("at"), x["enters"].alias("enters"), x["leaves"].alias("leaves")),
    )
    start = F.struct(
        F.array_repeat(F.lit(0), len(letters)).alias("count"),
        F.lit(0.0).alias("sum"),
        F.lit(float("inf")).alias("least"),
    )
    least = F.aggregate(places, start, step, lambda state: state["least"])
    return F.when(F.length(string) >= window, F.lit(math.log2(window)) - least / window)


def _class_pattern(letters: str) -> str:
    return "[" + letters.replace("-", "\\-").replace("/", "\\/") + "]{" + str(WINDOW) + ",}"


def _pieces(run: Column, base: Column) -> Column:
    """What is left of a run without the base spans and the allowed tokens in it, and the separators beside these."""
    ends = "array<struct<start:int,end:int>>"
    tokens = F.transform(
        _matches(run["hit"], ALLOWED_TOKENS, 0),
        lambda t: F.struct((run["start"] + t["start"]).alias("start"), (run["start"] + t["end"]).alias("end")),
    )
    inside = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    cuts = F.concat(F.transform(inside, lambda b: F.struct(b["start"], b["end"])), tokens)
    last = F.struct(run["end"].alias("start"), run["end"].alias("end"))
    start = F.struct(run["start"].alias("at"), F.array().cast(ends).alias("found"))

    def step(done: Column, cut: Column) -> Column:
        one = F.struct(done["at"].alias("start"), cut["start"].alias("end"))
        found = F.when(cut["start"] - done["at"] >= WINDOW, F.concat(done["found"], F.array(one)))
        return F.struct(
            F.greatest(done["at"], cut["end"]).alias("at"), F.coalesce(found, done["found"]).alias("found")
        )

    left = F.aggregate(F.concat(F.array_sort(cuts), F.array(last)), start, step, lambda done: done["found"])

    def trimmed(x: Column) -> Column:
        hit = F.substring(run["hit"], x["start"] - run["start"] + 1, x["end"] - x["start"])
        before = F.length(F.regexp_extract(hit, f"^{_SEPARATORS}", 0))
        after = F.length(F.regexp_extract(hit, f"(?<!{_SEPARATORS[:-1]}){_SEPARATORS}$", 0))
        # the run's own ends stay as they are
        first = F.when(x["start"] > run["start"], before).otherwise(0)
        size = F.length(hit) - first - F.when(x["end"] < run["end"], after).otherwise(0)
        return F.struct(
            (x["start"] + first).alias("start"),
            (x["start"] + first + size).alias("end"),
            F.substring(hit, first + 1, size).alias("hit"),
        )

    return F.transform(left, trimmed)


def _entropy_spans(text: Column, base: Column, rank: int, one: CharacterClass) -> Column:
    """Pieces of a class's runs, beside base spans, with a window of high entropy and not allowed."""

    def keep(x: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | x["hit"].rlike(f"^(?:{pattern})$")
        high = F.coalesce(peak_entropy(x["hit"], one.letters) >= one.bits, F.lit(False))
        return F.when(allowed, F.lit(False)).otherwise(high)

    pieces = F.flatten(F.transform(_matches(text, _class_pattern(one.letters), 0), lambda run: _pieces(run, base)))
    return _as_spans(F.filter(pieces, keep), rank, one.name)


def with_spans(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """All rows and columns, and the spans of secrets in the text as a further column.

    Spans (start, rank of the kind, end, kind) are in code points, end exclusive, by start, then
    kind as listed. First the named patterns: leftmost non-overlapping matches of each,
    those too short dropped. Then runs of one character class: a window of ``WINDOW``
    characters slides over each run with counts kept up to date, and a run whose largest Shannon
    entropy reaches the bound of its class is a secret, unless a pattern of ``ALLOWED`` fits
    it. Spans found before and ``ALLOWED_TOKENS`` are taken out of a run first, and each piece that is
    left is judged as a run. A null or empty text has no spans. No shuffle
    and no Python: each row is worked on where it lies.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = []
    for rank, kind in enumerate(BASE_KINDS):
        base.append(_as_spans(_long_enough(_matches(whole, kind.pattern, kind.group), kind), rank, kind.name))
    rows = df.withColumn(spans, F.concat(*base))
    for rank, one in enumerate(CLASSES, len(BASE_KINDS)):
        rows = rows.withColumn(spans, F.concat(F.col(spans), _entropy_spans(whole, F.col(spans), rank, one)))
    return rows.withColumn(spans, F.array_sort(F.col(spans)))


def find_secrets(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``text`` and the ``spans`` of secrets (see ``with_spans``) of every row.

    Null keys, repeated rows and other columns make no difference.
    """
    return with_spans(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every span, overlapping ones together, replaced by ``mask``."""

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        out = F.when(s["start"] >= done["at"], F.concat(done["out"], gap, F.lit(mask))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    return F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        step,
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))),
    )

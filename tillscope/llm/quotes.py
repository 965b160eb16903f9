"""Conversations without quotes: quoted passages are linked to the messages they come from.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.lookup import attach
from tillscope.session import stage

#: Turns of a conversation that are looked at in one place.
BLOCK_TURNS = 1000

_MARKS = r"^(?:[ \t]*>)+"


def line_level(line: Column) -> Column:
    """How deep a line is quoted: the ``>`` marks at its begin."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def line_body(line: Column) -> Column:
    """A line without its quote marks, blanks and line end."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, _MARKS, ""), r"\r$", ""))


def normalised(text: Column) -> Column:
    """Lower case, words of letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse_quotes(text: Column) -> Column:
    """Passages of a text in order: runs of lines of one quote level, as (level, body).

    Level 0 is the author's own text. A body keeps its inner line ends; passages without
    any visible character are left out.
    """
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line: F.struct(line_level(line).alias("level"), line_body(line).alias("body")),
    )
    # Runs are joined in one pass: the open run, and those closed before it.
    kind = "array<struct<level:int,body:string>>"
    start = F.named_struct(
        F.lit("done"), F.array().cast(kind), F.lit("level"), F.lit(-1), F.lit("lines"), F.array().cast("array<string>")
    )

    def closed(run: Column) -> Column:
        one = F.named_struct(F.lit("level"), run["level"], F.lit("body"), F.array_join(run["lines"], "\n"))
        return F.when(run["level"] < 0, run["done"]).otherwise(F.concat(run["done"], F.array(one)))

    def step(run: Column, line: Column) -> Column:
        same = line["level"] == run["level"]
        return F.named_struct(
            F.lit("done"), F.when(same, run["done"]).otherwise(closed(run)),
            F.lit("level"), line["level"],
            F.lit("lines"), F.when(same, F.concat(run["lines"], F.array(line["body"]))).otherwise(F.array(line["body"])),
        )

    return F.filter(F.aggregate(lines, start, step, closed), lambda p: F.trim(p["body"]) != "")


def _spoken_lines(body: Column) -> Column:
    """The normalised lines of a text, without empty ones."""
    return F.filter(F.transform(F.split(body, "\n", -1), normalised), lambda line: line != "")


def _message_hashes(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """What a quote may match, by normalised hash, and the first turn that has it.

    Own texts, their lines and paragraphs; and of every conversation as many consecutive lines of an own text as any of
    its quotes has, wherever other people's lines stood between them.
    """
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    parts = F.concat(F.array(own), F.split(own, "\n", -1), F.split(own, r"\n\s*\n", -1))
    hashed = messages.select("conv", "turn", F.explode(F.array_distinct(F.transform(parts, normalised))).alias("part"))
    # lengths of the quotes of each conversation; a very long one is still spread out
    sizes = quotes.where("lines > 1").groupBy("conv").agg(F.collect_set("lines").alias("sizes"))
    spoken = messages.select("conv", "turn", _spoken_lines(own).alias("said")).where(F.size("said") > 1)
    sized = attach(spoken, sizes, ["conv"], how="inner").withColumn("k", F.explode("sizes")).where("k <= size(said)")
    runs = F.transform(
        F.sequence(F.lit(1), F.size("said") - F.col("k") + 1),
        lambda i: F.array_join(F.slice("said", i, F.col("k")), " "),
    )
    hashed = hashed.union(sized.select("conv", "turn", F.explode(runs)))
    some = hashed.where("part <> ''")
    return some.groupBy("conv", F.sha2("part", 256).alias("hash")).agg(F.min("turn").alias("source"))


def _prior_turns(messages: DataFrame) -> DataFrame:
    """The turn before each one of its conversation.

    Looks inside blocks of turns, and for the first of a block at the blocks before, so
    no task gets the rows of one long conversation.
    """
    blocked = messages.select("conv", "turn", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("turn")
    along = Window.partitionBy("conv").orderBy("block")
    ends = blocked.groupBy("conv", "block").agg(F.max("turn").alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(along)).drop("end")
    return (
        blocked.withColumn("prior", F.lag("turn").over(inside))
        .join(ends, ["conv", "block"])
        .select("conv", "turn", F.coalesce("prior", "before").alias("prior"))
    )


def link_quotes(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every message without its quotes, with the message it replies to.

    Returns the conversation, the turn, the role, ``own_text`` (the lines without quote marks), ``n_quotes``,
    ``n_linked`` (quotes whose original is an earlier turn of the conversation) and ``reply_to``: the
    original of the quote of lowest level (of several the latest), else the turn before, null for the first. Quotes are compared by
    hash of their normalised text with the own texts of messages, their lines and paragraphs, and any consecutive lines; the first
    turn that has it is the original. Quotes without a letter or digit have none.

    Messages without conversation or turn are left out. Of repeated turns the first by role and text stays.
    A null text is empty. Turns needn't be without gaps. All steps are hash joins and aggregations
    by conversation and hash or turn, so that one very long conversation is still spread out.
    """
    messages = (
        df.select(
            F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
        .where("conv is not null and turn is not null")
        .groupBy("conv", "turn")
        .agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("r"), "text", "role")).alias("m"))
        .select("conv", "turn", "m.role", parse_quotes(F.col("m.text")).alias("passages"))
    )
    messages = stage(messages, "messages")
    quotes = messages.select("conv", "turn", F.posexplode("passages").alias("pos", "p")).where("p.level > 0")
    quotes = quotes.select(
        "conv", "turn", "pos", "p.level", F.sha2(normalised(F.col("p.body")), 256).alias("hash"),
        F.size(_spoken_lines(F.col("p.body"))).alias("lines"),
    )
    sources = _message_hashes(messages, quotes)
    # a quoted line may be quoted again, so only own text is a source
    found = quotes.join(sources, ["conv", "hash"]).where("source < turn")
    linked = found.groupBy("conv", "turn").agg(
        F.count("*").alias("n_linked"), F.max(F.struct((-F.col("level")).alias("l"), "source")).alias("best")
    )
    return (
        messages.join(_prior_turns(messages), ["conv", "turn"])
        .join(linked, ["conv", "turn"], "left")
        .select(
            F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
            F.array_join(
                F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), "\n"
            ).alias("own_text"),
            F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.coalesce("best.source", "prior").alias("reply_to"),
        )
    )


def reply_paths(linked: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Adds ``root`` and ``depth``: the first message of the reply tree and the steps to it.

    Pointer doubling: every round each message looks up what its ancestor points to, so
    the rounds grow with the logarithm of the longest chain of replies. A message that
    has found its root takes no part in later rounds, but is still looked up.
    """
    start = linked.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce("reply_to", F.col(turn)).alias("up"),
        F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("reply_to").isNull().alias("done"),
    )
    rows = stage(start, "replies")
    found = rows.where("done")
    while True:
        open_ = rows.where("not done")
        known = found.union(open_)
        above = known.select("conv", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"), "done")
        further = open_.drop("done").join(above, ["conv", "up"]).select(
            "conv", "turn", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "done"
        )
        rows = stage(further, "replies")
        found = found.union(rows.where("done"))
        if rows.where("not done").isEmpty():
            break
    paths = found.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("up").alias("root"), "depth")
    return linked.join(paths, [conv, turn])

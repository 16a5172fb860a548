"""Quotation linking: nested quotes to their originals, and conversations in reply order without quotes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import cut, fresh, shared_dir

#: Marks of a quoted line, and what a line that names a quote's author ends with.
QUOTE_MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame, name: str = "lines", marked: str = "_marked") -> DataFrame:
    """Adds an array of (level, body, named) of each message's lines. level: number of quote marks before it; named: the
    line names the author of the deeper quote that follows."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\r?\n")
    levels = F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTE_MARKS, 0), "[^>]", "")).alias("level"), F.rtrim(F.regexp_replace(x, QUOTE_MARKS + "[ \t]?", "")).alias("body")))
    both = messages.withColumn(marked, levels)
    following = F.arrays_zip(F.col(marked).alias("own"), F.concat(F.slice(marked, 2, 2147483646), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body")))).alias("next"))
    full = F.transform(following, lambda z: F.struct(z["own"]["level"].alias("level"), z["own"]["body"].alias("body"), ((z["next"]["level"] > z["own"]["level"]) & z["own"]["body"].rlike(ATTRIBUTION)).alias("named")))
    return both.withColumn(name, full).drop(marked)


def segments(lines: str, breaks) -> Column:
    """An array of (level, body, whole) of an array of lines cut where breaks(i) is true; bodies joined by spaces."""
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | breaks(i))
    ends = F.concat(F.slice(starts, 2, 2147483646), F.array(F.size(lines)))
    bounds = F.when(F.size(lines) > 0, F.arrays_zip(starts.alias("a"), ends.alias("z")))
    return F.transform(bounds, lambda r: F.struct(F.get(lines, r["a"])["level"].alias("level"), F.array_join(F.transform(F.slice(lines, r["a"] + 1, r["z"] - r["a"]), lambda x: x["body"]), " ").alias("body"), F.lit(False).alias("whole")))


def passages(lines: DataFrame, *keys: str) -> DataFrame:
    """A row for each passage (keys, level, hash, size, whole): each longest run of lines of one level, joined over its
    blank lines; each paragraph of one, as blank lines end it; each line; and all lines of level 0 joined. whole: the
    passage is all that the message itself says."""
    kept = lines.withColumn("_all", F.filter("lines", lambda x: ~x["named"])).withColumn("_kept", F.filter("_all", lambda x: x["body"] != ""))
    runs = segments("_kept", lambda i: F.get("_kept", i)["level"] != F.get("_kept", i - 1)["level"])
    paragraphs = segments("_all", lambda i: (F.get("_all", i)["level"] != F.get("_all", i - 1)["level"]) | (F.get("_all", i)["body"] == "") | (F.get("_all", i - 1)["body"] == ""))
    single = F.transform("_kept", lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.lit(False).alias("whole")))
    own = F.array(F.struct(F.lit(0).alias("level"), F.array_join(F.transform(F.filter("_kept", lambda x: x["level"] == 0), lambda x: x["body"]), " ").alias("body"), F.lit(True).alias("whole")))
    rows = kept.where(F.size("_kept") > 0).select(*keys, F.explode(F.concat(runs, paragraphs, single, own)).alias("p"))
    text = rows.select(*keys, F.col("p.level").alias("level"), F.col("p.whole").alias("whole"), normalised(F.col("p.body")).alias("_text")).where("_text <> ''")
    hashed = text.select(*keys, "level", F.unhex(F.md5(F.col("_text").cast("binary"))).alias("hash"), F.length("_text").alias("size"), "whole")
    return hashed.groupBy(*keys, "level", "hash", "size").agg(F.max("whole").alias("whole"))


#: A message that has a quoted line.
QUOTING = r"(?m)^[ \t]*>"


def quote_links(messages: DataFrame, min_chars: int = 12) -> DataFrame:
    """conv_id, turn, level, origin, size: for each message and quote level the earlier message of the conversation that
    has most of the quoted characters as its own words; ties: the earliest.

    Only conversations with a quoted line are parsed. An original passage is that of the first message that has it, so each
    quoted passage meets one original at most: the join can't grow beyond the quoted passages, however often a passage is
    repeated. A quoted passage of any length is looked for; one under min_chars (normalised) has an original only in a
    message that says nothing else: one line of several that is as short as `thanks` names no origin.
    """
    named = messages.select("conv_id", "turn", F.col("text").cast("string").alias("text")).where("conv_id is not null and turn is not null")
    some = named.where(F.col("text").rlike(QUOTING)).select("conv_id").distinct()
    lines = parsed(named.join(some, "conv_id", "left_semi"))
    found = passages(lines, "conv_id", "turn").where((F.col("size") >= min_chars) | (F.col("level") > 0) | F.col("whole"))
    own = found.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = found.where("level > 0")
    matched = quoted.join(own, ["conv_id", "hash"]).where("origin < turn")
    votes = matched.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    return votes.groupBy("conv_id", "turn", "level").agg(F.max_by(F.struct("origin", "size"), F.struct(F.col("size"), -F.col("origin"))).alias("best")).select("conv_id", "turn", "level", "best.origin", "best.size")


def reply_places(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread_root, depth, place of each reply (conv_id, turn, reply_to), by doubling the step upwards: rounds
    grow with the logarithm of the deepest thread.

    place: sorts a thread's messages reply by reply, a message's first reply with all that follows it before the second.
    The last reply to a message carries on its chain: [k + 1] after [k]; an earlier one begins a chain of its own, [k, turn,
    0]. So a place grows with the branches that lead to it, not with its depth.
    """
    last = replies.groupBy("conv_id", "reply_to").agg(F.max("turn").alias("_last"))
    first = F.when(F.col("turn") == F.col("_last"), F.array(F.lit(1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"), F.col("turn").cast("bigint"), F.lit(0).cast("bigint")))
    known = cut(replies.join(last, ["conv_id", "reply_to"]).select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth"), first.alias("place")))
    while True:
        above = known.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("place").alias("_place"))
        both = F.concat(F.slice("_place", 1, F.size("_place") - 1), F.array(F.element_at("_place", -1) + F.element_at("place", 1)), F.slice("place", 2, 2147483646))
        more = F.col("_up").isNotNull()
        step = cut(known.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.when(more, both).otherwise(F.col("place")).alias("place"), more.alias("_more")))
        known = step.drop("_more")
        if step.where("_more").isEmpty():
            return known.withColumnRenamed("up", "thread_root")


def reply_ordered(messages: DataFrame, min_chars: int = 12) -> DataFrame:
    """Conversations in reply order without quotes: the columns of messages with text cut down to the message's own lines,
    and n_quoted_lines, quote_depth, reply_to (the turn that its outermost linked quote comes from), thread_root (the
    first turn of its chain of replies), depth (replies from there), n_linked (quote levels with an original) and place.

    Rows are sorted by conv_id, thread_root, place (see `reply_places`), by ranges, so that one conversation may lie in
    several partitions; a reply follows what it answers, and two branches aren't mixed.

    Null or empty text: empty text, no quotes. Very long text: whole. Null conv_id or turn: kept, without links, first in
    order. Repeated rows: kept each. Ties: a quote that more than one message has comes from the first. Lines naming an
    author (... wrote:) before a deeper quote go with the quote. Empty table: no rows. Columns of messages that have the
    added names are replaced; no other name clashes.
    """
    shared_dir(messages.sparkSession)
    added = ["n_quoted_lines", "quote_depth", "reply_to", "thread_root", "depth", "n_linked", "place"]
    plain = messages.drop(*added)
    columns = plain.columns
    links = cut(quote_links(plain, min_chars))
    to = links.groupBy("conv_id", "turn").agg(F.min_by("origin", "level").alias("reply_to"), F.count(F.lit(1)).alias("n_linked"))
    chains = cut(to.join(reply_places(to.drop("n_linked")), ["conv_id", "turn"]))
    text, quoting = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string").rlike(QUOTING), F.lit(False))
    lines, marked = fresh(plain, "lines", "_marked")
    with_lines = parsed(plain.where(quoting), lines, marked)
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["named"])
    stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    quoted = with_lines.withColumns({"text": stripped(F.array_join(F.transform(own, lambda x: x["body"]), "\n")), "n_quoted_lines": F.size(F.filter(lines, lambda x: x["level"] > 0)), "quote_depth": F.array_max(F.transform(lines, lambda x: x["level"]))}).drop(lines)
    others = plain.where(~quoting).withColumns({"text": stripped(F.regexp_replace(text, r" *\r?\n", "\n")), "n_quoted_lines": F.lit(0), "quote_depth": F.lit(0)})
    named = quoted.unionByName(others).join(chains, ["conv_id", "turn"], "left").withColumns({"thread_root": F.coalesce("thread_root", "turn"), "depth": F.coalesce("depth", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0).cast("bigint")), "place": F.coalesce("place", F.array(F.lit(0).cast("bigint")))})
    return named.select(*[F.col(f"`{c}`") for c in columns], *added).orderBy("conv_id", "thread_root", "place")

"""Quotation linking: nested quotes are parsed, matched to the messages they come from, and taken out of conversations.

A line's quote level is the number of > before its content; consecutive lines of one level are a passage. Normalised
passages (lower case, single spaces) are hashed, and so are their paragraphs and lines; of each message's own text the
whole, paragraphs, lines and all runs of as many consecutive lines (blank ones aside) as some passage or its paragraph
has. A passage comes from where the most of its words in one piece come from: the first message of its conversation that
says the piece, if its turn is earlier; else the first message (by conv_id, then turn) of another conversation. First
messages are found by aggregation before the join, and joined under salted keys, so a phrase that everyone says or quotes
meets no single task. A message replies to the source of its first linked passage of level 1, else to the turn before.

No chain of replies leads back to its start: conversations that no circle of links between conversations can hold are
peeled off, and in what remains only links to a smaller conv_id are replies. Conversations are in reply order: messages
that begin a thread (the first, and replies to other conversations) by turn, each followed by its replies, level by level
and within a level by turn; position counts so, and parents come earlier.

Cases: a null or empty text is a message without words; very long texts are parsed whole; passages without words link
with nothing; rows without conv_id or turn are left out, as they have no place; rows that repeat conv_id and turn are
messages of their own, in order of role and text, and equal rows too; of equal sayings the first counts; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, salted_join

_quoted = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S).fullmatch


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> str | None:
    n = normalised(text)
    return xxhash.xxh3_128_hexdigest(n.encode()) if n else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]) of a message."""
    own, passages, last = [], [], 0
    for line in (text or "").split("\n"):
        m = _quoted(line)
        level, content = (m[1].count(">"), m[2]) if m else (0, line)
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(content)
        else:
            passages.append((level, [content]))
        last = level
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def solid(text: str) -> list[str]:
    """Lines that aren't blank."""
    return [x for x in text.split("\n") if x.strip()]


def parts(text: str) -> list[str]:
    """A text, its paragraphs and its lines."""
    return [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]


def sayings(own: str, lengths: Iterable[int] = ()) -> list[str]:
    """Digests of a text, its paragraphs, its lines and its runs of so many lines."""
    lines = solid(own)
    runs = ("\n".join(lines[i : i + n]) for n in lengths for i in range(len(lines) - n + 1))
    return sorted({d for x in (*parts(own), *runs) if (d := digest(x))})


def pieces(passage: str) -> list[tuple[int, str]]:
    """(-words, digest) of a passage, its paragraphs and its lines."""
    return sorted({(-len(x.split()), d) for x in parts(passage) if (d := digest(x))})


def run_lengths(messages: DataFrame) -> list[int]:
    """Numbers of lines, two or more, of all passages and their paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {n for text in batch.column("text") for _, x in parse(text.as_py())[1] for y in parts(x) if (n := len(solid(y))) > 1}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["n"])

    return sorted(r.n for r in messages.where("text RLIKE '(^|\\n)[ \\t]*>'").select("text").mapInArrow(run, "n int").distinct().collect())


def ranked(rows: DataFrame, order: list[str], ties: list[str], name: str) -> DataFrame:
    """rows with rank (1, 2, .. in their conversation, by order, then ties) and prior (the turn before), by ranges of order: no conversation is in one task."""
    ranged = materialize(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), name)
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    parts = Window.partitionBy("conv_id").orderBy("part")  # a row for each range
    offsets = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("last").over(parts).alias("older"))
    own = Window.partitionBy("conv_id", "part").orderBy(*order, *ties)
    placed = ranged.withColumns({"at": F.row_number().over(own), "prior": F.lag("turn").over(own)}).join(offsets, ["conv_id", "part"])
    return placed.withColumns({"rank": (F.col("base") + F.col("at")).cast("long"), "prior": F.coalesce("prior", "older")}).drop("part", "at", "base", "older")


def on_circles(links: DataFrame, rounds: int = 20) -> DataFrame | None:
    """c: conversations that a circle of links (a, b) may hold. Those without links in, or without links out, are peeled off."""
    links = materialize(links.distinct(), "between")
    n = links.count()
    for _ in range(rounds):
        if not n:
            return None
        old = links
        links = materialize(links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi"), "between", rows=n)
        discard(old)
        n, last = links.count(), n
        if n == last:
            break
    return links.select(F.col("a").alias("c")).distinct() if n else None


def in_reply_order(placed: DataFrame, rounds: int = 64) -> DataFrame:
    """placed (conv_id, place, up: the parent's place or null) with position. Depth and thread of forked ones by pointer doubling."""
    plain = (F.col("up") == F.col("place") - 1) | F.col("up").isNull() & (F.col("place") == 1)
    forked = placed.where(~F.coalesce(plain, F.lit(False))).select("conv_id").distinct()
    tree = materialize(placed.join(forked, "conv_id", "left_semi").select("conv_id", "place", "up", F.coalesce("up", "place").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), "threads")
    for _ in range(rounds):
        above = tree.select("conv_id", F.col("place").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("more"))
        new = materialize(tree.join(above, ["conv_id", "top"]).select("conv_id", "place", "up", F.col("top2").alias("top"), (F.col("depth") + F.col("more")).alias("depth")), "threads")
        done = new.join(tree.select("conv_id", "place", F.col("top").alias("old")), ["conv_id", "place"]).where("top != old").isEmpty()
        discard(tree)
        tree = new
        if done:
            break
    order = ranked(tree.withColumn("turn", F.lit(0)), ["top", "depth", "place"], [], "reply-order").select("conv_id", "place", F.col("rank").alias("position"))
    return placed.join(order, ["conv_id", "place"], "left").withColumn("position", F.coalesce("position", "place"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, position, max_level, n_quotes, n_linked, parent_conv and parent_turn of every message."""

    named = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.xxhash64("role", "text").alias("id"), F.col("text").cast("string")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    lengths = run_lengths(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.list_(pa.struct([("level", pa.int32()), ("pieces", pa.list_(pa.struct([("size", pa.int32()), ("h", pa.string())])))]))
        for batch in batches:
            own, said, quoted = [], [], []
            for text in batch.column("text"):
                mine, passages = parse(text.as_py())
                own.append(mine)
                said.append(sayings(mine, lengths))
                quoted.append([{"level": level, "pieces": [{"size": n, "h": d} for n, d in pieces(x)]} for level, x in passages])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "turn", "role", "id")] + [pa.array(own, pa.string()), pa.array(said, pa.list_(pa.string())), pa.array(quoted, passage)], names=["conv_id", "turn", "role", "id", "own_text", "said", "quoted"])

    parsed = materialize(named.mapInArrow(run, "conv_id long, turn long, role string, id long, own_text string, said array<string>, quoted array<struct<level:int,pieces:array<struct<size:int,h:string>>>>"), "messages")
    placed = materialize(ranked(parsed, ["turn", "id"], ["own_text"], "in-turn-order").withColumnsRenamed({"rank": "place", "prior": "before"}), "messages")
    discard(parsed)
    quotes = placed.select("conv_id", "turn", F.col("place").alias("own"), F.posexplode("quoted").alias("passage", "q")).select("conv_id", "turn", "own", "passage", "q.level", F.explode("q.pieces").alias("p")).select("conv_id", "turn", "own", "passage", "level", "p.*").distinct()
    quotes = materialize(quotes, "quotes")
    asked = quotes.select("h").distinct()
    said = placed.select("conv_id", "turn", "place", F.explode("said").alias("h")).join(asked, "h", "left_semi")
    here = materialize(said.groupBy("h", F.col("conv_id").alias("conv")).agg(F.min(F.struct("turn", "place")).alias("at")), "said")
    firsts = here.groupBy("h").agg(F.min(F.struct("conv", "at")).alias("first"))
    # Where the table's first saying is in the quoter's own conversation, the first of the others is looked up too.
    seconds = here.join(firsts.select("h", F.col("first.conv").alias("not_conv")), "h").where("conv != not_conv").groupBy("h").agg(F.min(F.struct("conv", "at")).alias("second"))
    found = quotes.join(here.select("h", F.col("conv").alias("conv_id"), "at"), ["h", "conv_id"], "left")
    found = salted_join(found, firsts.join(seconds, "h", "left"), "h", ("conv_id", "own"))
    same = F.col("at.turn") < F.col("turn")
    other = F.when(F.col("first.conv") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    source = F.when(same, F.struct(F.col("conv_id").alias("conv"), F.col("at"))).otherwise(other)
    found = found.withColumn("source", source).where("source IS NOT NULL")
    found = found.groupBy("conv_id", "own", "passage", "level").agg(F.min(F.struct("size", "h", "source"))["source"].alias("source"))
    per = materialize(found.groupBy("conv_id", F.col("own").alias("place")).agg(F.count("source").alias("linked"), F.min(F.when(F.col("level") == 1, F.struct("passage", "source")))["source"].alias("reply")), "linked")
    away = per.where("reply.conv != conv_id").select(F.col("conv_id").alias("a"), F.col("reply.conv").alias("b"))
    if (circles := on_circles(away)) is not None:
        circles = materialize(circles, "circles")
        per = per.join(circles.select(F.col("c").alias("conv_id"), F.lit(True).alias("from_circle")), "conv_id", "left")
        per = per.join(circles.select(F.col("c").alias("to"), F.lit(True).alias("to_circle")), F.col("reply.conv") == F.col("to"), "left")
        stays = (F.col("reply.conv") <= F.col("conv_id")) | F.col("from_circle").isNull() | F.col("to_circle").isNull()
        per = per.select("conv_id", "place", "linked", F.when(stays, F.col("reply")).alias("reply"))
    met = placed.join(per, ["conv_id", "place"], "left")
    reply = F.col("reply")
    own = F.coalesce(reply["conv"] == F.col("conv_id"), F.lit(False))
    up = F.when(own, reply["at"]["place"]).when(reply.isNull() & (F.col("place") > 1), F.col("place") - 1)
    met = met.withColumn("up", up)
    order = in_reply_order(met.select("conv_id", "place", "up"))
    met = met.join(order.select("conv_id", "place", "position"), ["conv_id", "place"])
    return met.select(
        "conv_id", "turn", "role", "own_text", "position",
        F.coalesce(F.array_max(F.transform("quoted", lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.coalesce(F.size("quoted"), F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        F.when(reply.isNotNull(), reply["conv"]).when(F.col("before").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(reply.isNotNull(), reply["at"]["turn"]).otherwise(F.col("before")).alias("parent_turn"),
    )

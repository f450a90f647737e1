"""Conversations from messages that quote each other.

A line's quote level is the number of leading ``>``. Runs of lines of one level
are passages; a passage at level 0 is the sender's own. A passage is looked up
whole, then by its paragraphs, and as a last resort by its lines: each is
normalised, hashed and joined to what earlier messages of the same thread say
themselves, whole, by paragraph or by line; the nearest earlier one is its
source. The level-1 quote linked to the latest message names the parent; a
message that quotes nothing known answers nobody. Messages are then ordered so
that each follows the one it answers, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import let
from tagloom.operators.rank import global_rank
from tagloom.session import store_table

_QUOTE = r"^(?:[ \t]*>)+"
WHOLE, PARAGRAPH, LINE = 0, 1, 2
# A line of fewer words is too common to name its source.
LINE_WORDS = 3
# Turns of a thread that are searched in one row; earlier ones by their maximum.
TURN_BLOCK = 4096
# Turns of a thread that with_quotes holds in one window.
_QUOTE_BLOCK = 64


def passages(text: Column) -> Column:
    """Array of (``level``, ``text``): maximal runs of lines of one quote level, blank lines apart.

    A blank line has the level its marks give it and ends no run. Null and empty
    texts have no passage.
    """

    def of_line(line: Column) -> Column:
        marks = F.regexp_extract(line, _QUOTE, 0)
        return F.struct(
            F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"),
            F.when(F.length(marks) > 0, F.regexp_replace(line, _QUOTE + r" ?", "")).otherwise(line).alias("text"))

    def runs(lines: Column) -> Column:
        first = lambda x, i: (i == 0) | (F.get(lines, i - 1)["level"] != x["level"])
        starts = F.filter(F.transform(lines, lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())

        def one(s: Column) -> Column:
            def run(i: Column, j: Column) -> Column:
                stop = F.coalesce(F.get(s, j + 1), F.size(lines))
                body = F.transform(F.slice(lines, i + 1, stop - i), lambda x: x["text"])
                return F.struct(F.get(lines, i)["level"].alias("level"), F.array_join(body, "\n").alias("text"))

            return F.transform(s, run)

        return let(starts, one)

    lines = F.transform(F.split(text, r"\r\n|\r|\n", -1), of_line)
    found = F.filter(let(lines, runs), lambda p: F.trim(F.regexp_replace(p["text"], r"\s+", " ")) != "")
    return F.coalesce(found, F.array().cast("array<struct<level:int,text:string>>"))


def normalised(text: Column) -> Column:
    """White space joined, trimmed, lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passage_hash(text: Column) -> Column:
    """128 bits of the normalised text's SHA-256."""
    return F.unhex(F.substring(F.sha2(normalised(text), 256), 1, 32))


def units(text: Column) -> Column:
    """Array of (``grain``, ``hash``) of a passage: itself, its paragraphs, its lines of ``LINE_WORDS`` words or more."""

    def hashed(parts: Column, grain: int, words: int) -> Column:
        long_enough = F.filter(parts, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) >= words)
        return F.transform(long_enough, lambda x: F.struct(F.lit(grain).alias("grain"), passage_hash(x).alias("hash")))

    whole = F.array(F.struct(F.lit(WHOLE).alias("grain"), passage_hash(text).alias("hash")))
    return F.array_distinct(F.concat(
        whole, hashed(F.split(text, r"\n(?:\s*\n)+", -1), PARAGRAPH, 1), hashed(F.split(text, r"\n", -1), LINE, LINE_WORDS)))


def _mine(found: Column) -> Column:
    """The sender's own passages, trimmed and joined by a line break."""
    mine = F.filter(found, lambda p: p["level"] == 0)
    return F.array_join(F.transform(mine, lambda p: F.regexp_replace(p["text"], r"^\s+|\s+$", "")), "\n")


def own_text(text: Column) -> Column:
    """What the sender wrote: level-0 passages, trimmed and joined by a line break; null for null."""
    return F.when(text.isNotNull(), let(passages(text), _mine))


def parsed(rows: DataFrame) -> DataFrame:
    """Stored messages (``thread``, ``turn``, ``role``, ``text``), each text read once.

    ``h1`` and ``h2`` stand for the whole row, so that equal rows have equal
    ones; ``said`` are the hashes of the sender's own units, ``quoted`` has
    position, level and units of each quoted passage.
    """
    cols = ["thread", "turn", "role", "text"]
    told_apart = [c for name in cols for c in (F.col(name).isNull(), F.col(name))]

    def read(found: Column) -> Column:
        numbered = F.transform(found, lambda p, i: F.struct(
            i.alias("position"), p["level"].alias("level"), F.when(p["level"] > 0, units(p["text"])).alias("units")))
        said = F.flatten(F.transform(F.filter(found, lambda p: p["level"] == 0), lambda p: F.transform(units(p["text"]), lambda u: u["hash"])))
        return F.struct(
            _mine(found).alias("own"), F.array_distinct(said).alias("said"), F.filter(numbered, lambda p: p["level"] > 0).alias("quoted"))

    return store_table(rows.select(
        "thread", "turn", "role", F.xxhash64(*told_apart).alias("h1"), F.xxhash64(F.lit(1), *told_apart).alias("h2"),
        F.col("text").isNull().alias("missing"), let(passages(F.col("text")), read).alias("x")), "messages")


def _links(messages: DataFrame) -> DataFrame:
    """``thread``, ``turn``, ``level``, ``position`` and ``source`` of every quoted passage of ``parsed`` messages.

    What is said and what is asked for meet in one row per thread, passage and
    block of turns, with the block's turns (``TURN_BLOCK`` at most) and the last
    turn of the blocks before it, so that a passage very many messages repeat or
    quote makes no pairs.
    """
    block = F.floor(F.col("turn") / TURN_BLOCK).alias("block")
    numbered = messages.where(F.col("turn").isNotNull())
    said = numbered.select("thread", "turn", F.explode("x.said").alias("hash")).select("thread", "hash", block, F.col("turn").alias("own"))
    each = messages.select("thread", "turn", "h1", "h2", F.explode("x.quoted").alias("q")).select(
        "thread", "turn", "h1", "h2", "q.position", "q.level", F.explode("q.units").alias("u")).select(
        "thread", "turn", "h1", "h2", "position", "level", "u.grain", "u.hash", block).distinct()
    each = store_table(each, "quoted-units")
    asked = each.select("thread", "hash", "block", F.lit(None).cast(said.schema["own"].dataType).alias("own"))
    met = said.unionByName(asked).groupBy("thread", "hash", "block").agg(
        F.collect_set("own").alias("turns"), F.count_if(F.col("own").isNull()).alias("asked"))
    earlier = Window.partitionBy("thread", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = met.withColumn("before", F.max(F.array_max("turns")).over(earlier)).where("asked > 0")
    q, k = each.alias("q"), known.alias("k")
    found = q.join(k, F.col("q.thread").eqNullSafe(F.col("k.thread")) & (F.col("q.hash") == F.col("k.hash")) & (F.col("q.block") == F.col("k.block")), "left")
    here = F.array_max(F.filter("k.turns", lambda t: t < F.col("q.turn")))
    sourced = found.select(
        "q.thread", "q.turn", "q.h1", "q.h2", "q.position", "q.level", "q.grain", F.coalesce(here, F.col("k.before")).alias("source"))
    of = lambda grain: F.max(F.when(F.col("grain") == grain, F.col("source")))
    return sourced.groupBy("thread", "turn", "h1", "h2", "position", "level").agg(
        F.coalesce(of(WHOLE), of(PARAGRAPH), of(LINE)).alias("source")).drop("h1", "h2")


def link_quotes(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``thread``, ``turn``, ``level``, ``position`` and ``source_turn`` of every quoted passage.

    ``source_turn`` is the nearest earlier turn that says the passage itself,
    as a whole run, a paragraph or a line; else of the turns that say one of its
    paragraphs, else one of its lines, the latest; else null. Turns are numbers.
    Null threads form one thread; null turns are no source and get no link.
    Equal messages under one turn count once.
    """
    rows = messages.select(F.col(thread).alias("thread"), F.col(turn).alias("turn"), F.lit(None).cast("string").alias("role"), F.col(text).alias("text"))
    return _links(parsed(rows)).select(
        F.col("thread").alias(thread), F.col("turn").alias(turn), "level", "position", F.col("source").alias("source_turn"))


def _roots(parents: DataFrame) -> DataFrame:
    """``thread``, ``turn``, ``root`` and ``depth`` of the messages that answer one, by doubling.

    A reply chain of any length takes a logarithmic number of joins, each over
    the messages not yet at their root.
    """
    active = store_table(parents.where(F.col("parent").isNotNull()).select(
        "thread", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "reply-roots")
    ended = None
    while True:
        every = active if ended is None else active.unionByName(ended)
        above = every.select(F.col("thread").alias("t"), F.col("turn").alias("at"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        moved = active.join(above, F.col("thread").eqNullSafe(F.col("t")) & (F.col("root") == F.col("at")), "left").select(
            "thread", "turn", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            F.col("r2").isNotNull().alias("moved"))
        moved = store_table(moved, "reply-roots")
        at_root = moved.where(~F.col("moved")).drop("moved")
        ended = at_root if ended is None else ended.unionByName(at_root)
        active = moved.where("moved").drop("moved")
        if active.isEmpty():
            return ended


def conversations(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages without quotes, each with its place in the reply order.

    Columns: thread, turn, role, ``parent_turn``, ``root_turn``, ``depth``,
    ``quotes`` (quoted passages), ``linked`` (those with a source),
    ``position`` (from 0 in the thread: by root, then depth, then turn) and
    ``text``. Rows that repeat a thread and turn are each returned with the
    links of the turn; they share its parent. A null turn comes last, has no
    parent and is its own root. An empty table gives no rows; other columns are
    not read.

    Texts are parsed once, and travel once more, to meet their places; links,
    parents and the distributed rank move hashes and numbers only, so a thread
    of any size is never in one task.
    """
    rows = messages.select(F.col(thread).alias("thread"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    read = parsed(rows)
    parents = store_table(_links(read).where(F.col("turn").isNotNull()).groupBy("thread", "turn").agg(
        F.max(F.when(F.col("level") == 1, F.col("source"))).alias("parent"),
        F.count(F.lit(1)).alias("quotes"), F.count("source").alias("linked")), "quote-parents")
    m = read.groupBy("h1", "h2").agg(
        F.first("thread").alias("thread"), F.first("turn").alias("turn"), F.first("role").alias("role"), F.count(F.lit(1)).alias("copies")).alias("m")
    p, u = parents.alias("p"), _roots(parents).alias("u")
    same = lambda x: F.col("m.thread").eqNullSafe(F.col(f"{x}.thread")) & (F.col("m.turn") == F.col(f"{x}.turn"))
    joined = m.join(p, same("p"), "left").join(u, same("u"), "left").select(
        "m.h1", "m.h2", "m.copies", "m.thread", "m.turn", "m.role", F.col("p.parent").alias("parent_turn"),
        F.coalesce("u.root", "m.turn").alias("root_turn"), F.coalesce("u.depth", F.lit(0)).cast("int").alias("depth"),
        F.coalesce("p.quotes", F.lit(0)).alias("quotes"), F.coalesce("p.linked", F.lit(0)).alias("linked"))
    order = [F.asc_nulls_first("thread"), F.asc_nulls_last("root_turn"), F.asc("depth"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("h1"), F.asc("h2")]
    ranked = store_table(global_rank(joined, order, rank="__rank", running={"copies": "__upto"}).drop("__rank"), "replies")
    before = F.col("__upto") - F.col("copies")
    first = ranked.groupBy("thread").agg(F.min(before).alias("__first")).select(F.col("thread").alias("__thread"), "__first")
    placed = ranked.join(first, F.col("thread").eqNullSafe(F.col("__thread"))).withColumn("__at", (before - F.col("__first")).cast("int"))
    texts = read.groupBy("h1", "h2").agg(F.max(F.when(~F.col("missing"), F.col("x.own"))).alias("__own"))
    return placed.join(texts, ["h1", "h2"]).select(
        F.col("thread").alias(thread), F.col("turn").alias(turn), F.col("role").alias(role), "parent_turn", "root_turn", "depth",
        "quotes", "linked", F.explode(F.sequence(F.col("__at"), F.col("__at") + F.col("copies").cast("int") - 1)).alias("position"),
        F.col("__own").alias(text))


def with_quotes(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages as mail programs send them: each repeats the turn before it and, a level deeper, the turn before that.

    Messages at odd turns quote whole, those at even turns only the first line.
    Turns are whole numbers; where one is missing nothing is quoted, and a null
    turn quotes nothing; of several texts under one turn the smallest is quoted.
    A message whose own text is null stays null. A thread is cut into blocks of
    turns, each with the two turns before it, so a window never holds more than
    a block.
    """
    at = F.floor(F.col(turn) / _QUOTE_BLOCK)
    both = F.array_distinct(F.array(at, F.floor((F.col(turn) + 2) / _QUOTE_BLOCK)))
    spread = F.when(F.col(turn).isNull(), F.array(F.pmod(F.xxhash64(text, role), F.lit(1 << 20)))).otherwise(both)
    rows = messages.select(thread, turn, role, text, at.alias("__home"), F.explode(spread).alias("__block"))
    near = Window.partitionBy(thread, F.col(turn).isNull(), "__block").orderBy(turn)

    def quote(back: int, mark: str) -> Column:
        said = F.min(text).over(near.rangeBetween(-back, -back))
        part = F.when(F.col(turn) % 2 != 0, said).otherwise(F.split(said, "\n")[0])
        marked = F.concat(F.lit(mark), F.regexp_replace(part, "\n", "\n" + mark), F.lit("\n"))
        return F.coalesce(F.when(F.col(turn).isNotNull(), marked), F.lit(""))

    sent = rows.withColumn("__sent", F.concat(quote(2, ">> "), quote(1, "> "), F.col(text)))
    return sent.where(F.col(turn).isNull() | (F.col("__home") == F.col("__block"))).select(thread, turn, role, F.col("__sent").alias(text))

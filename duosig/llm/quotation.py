"""Conversations without quotations: quoted passages are linked to the messages they come from. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Turns of a conversation whose sayings of a passage are looked through together.
PIECE_TURNS = 256
#: A line that only introduces a quotation ("On Monday, A wrote:") goes with it.
INTRODUCTION = r"(?i)^\s*(?:on\b.{0,200}\bwrote|.{0,80}\b(?:wrote|writes|schrieb|escribió|a écrit))\s*:\s*$"
INTRODUCTION_CHARS = 400
#: Leading quotation marks of a line, with spaces between them; a class and no group, as Java's groups recurse.
MARK = r"^[\x20\t>]*>"


def normalised(text: Column) -> Column:
    """Lower case, with white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lines_of(text: Column) -> Column:
    """Lines as (depth, said, norm): depth counts leading > signs with spaces between them, said is the rest, norm is it normalised."""
    said = lambda x: F.trim(F.regexp_replace(x, MARK, ""))
    depth = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", ""))
    return F.transform(F.split(text, "\r\n|\n|\r", -1), lambda x: F.struct(depth(x).alias("depth"), said(x).alias("said"), normalised(said(x)).alias("norm")))


def passages_of(lines: str) -> Column:
    """Runs of adjacent lines of one depth without blank lines between them, as (depth, lines); lines names a column of lines_of()."""
    at = lambda i: F.element_at(lines, i)
    same = lambda i, j: (at(j)["norm"] != "") & (at(j)["depth"] == at(i)["depth"])
    n = F.size(lines)
    places = F.filter(F.sequence(F.lit(1), n), lambda i: at(i)["norm"] != "")
    first = F.filter(places, lambda i: F.when(i == 1, True).otherwise(~same(i, F.greatest(i - 1, F.lit(1)))))
    last = F.filter(places, lambda i: F.when(i == n, True).otherwise(~same(i, F.least(i + 1, n))))
    return F.zip_with(first, last, lambda a, b: F.struct(at(a)["depth"].alias("depth"), F.transform(F.slice(lines, a, b - a + 1), lambda x: x["norm"]).alias("lines")))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def units_of(passages: Column) -> Column:
    """What is looked for: each passage as a whole and, if it has several, each of its lines, as (passage, depth, whole, n lines, h)."""

    def units(p: Column, j: Column) -> Column:
        unit = lambda whole, n, text: F.struct(j.alias("passage"), p["depth"].alias("depth"), F.lit(whole).alias("whole"), n.alias("n"), _key(text).alias("h"))
        each = F.transform(p["lines"], lambda x: unit(False, F.lit(1), x))
        return F.concat(F.array(unit(True, F.size(p["lines"]), F.array_join(p["lines"], " "))), F.filter(each, lambda _: F.size(p["lines"]) > 1))

    return F.flatten(F.transform(passages, units))


def split_messages(rows: DataFrame) -> DataFrame:
    """rows with own (text without quotations), quoted (units of what is quoted), n_quoted (its lines) and depth (the greatest)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("_lines", lines_of(text))
    rows = rows.withColumn("_quoted", F.filter(passages_of("_lines"), lambda p: p["depth"] > 0))
    next_depth = lambda i: F.coalesce(F.try_element_at("_lines", i + 2)["depth"], F.lit(0))
    introduces = lambda x, i: (F.length(x["said"]) <= INTRODUCTION_CHARS) & x["said"].rlike(INTRODUCTION) & (next_depth(i) > 0)
    kept = F.transform(F.filter("_lines", lambda x, i: (x["depth"] == 0) & ~introduces(x, i)), lambda x: x["said"])
    own = F.when(F.exists("_lines", lambda x: x["depth"] > 0), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(text)
    made = {
        "own": own, "quoted": units_of(F.col("_quoted")), "n_quoted": F.aggregate("_quoted", F.lit(0).cast("long"), lambda a, p: a + F.size(p["lines"])),
        "depth": F.coalesce(F.array_max(F.transform("_quoted", lambda p: p["depth"])), F.lit(0)),
    }
    return rows.withColumns(made).drop("_lines", "_quoted", "text")


def origins(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """quoted (conv_id, h, turn, ...) with origin, the latest earlier turn of said (conv_id, h, turn) with the same unit; null without one.

    A running maximum by turn within pieces of turns, with the maximum of the pieces before: a line that a hot
    conversation repeats in every message is spread over tasks and makes no pairs.
    """
    key = ["conv_id", "h"]
    both = quoted.withColumn("_said", F.lit(None).cast("long")).unionByName(said.select(*key, "turn", F.col("turn").alias("_said")), allowMissingColumns=True)
    both = both.withColumn("_piece", F.floor(F.col("turn") / PIECE_TURNS))
    before = Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*key, "_piece").agg(F.max("_said").alias("_last")).withColumn("_carried", F.max("_last").over(before))
    carried = carried.where("_carried is not null").select(F.col("conv_id").alias("_c"), F.col("h").alias("_h"), F.col("_piece").alias("_p"), "_carried")
    within = Window.partitionBy(*key, "_piece").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_near", F.max("_said").over(within)).where("_said is null")
    found = found.join(carried, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h")) & (F.col("_piece") == F.col("_p")), "left")
    return found.withColumn("origin", F.coalesce("_near", "_carried")).select(*quoted.columns, "origin")


def _tops(links: DataFrame) -> DataFrame:
    """(conv_id, turn, top) by pointer jumping to the first message of each chain; every round halves what is left of it."""
    chain = links.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("top"))
    while True:
        up = chain.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("top").alias("_top"))
        jumped = chain.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("top") == F.col("_t")), "left")
        jumped = shared.materialise(jumped.select("conv_id", "turn", F.coalesce("_top", "top").alias("top"), F.col("_top").isNotNull().alias("moved")))
        chain = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return chain


def link_quotations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotations), reply_to, thread, position, n_quoted, n_linked, depth.

    Adjacent quoted lines of one depth are a passage; blank lines end it. A passage is linked to the latest earlier
    message of its conversation with the same passage of its own, however its lines are broken; if none has it, each of
    its lines is linked by itself to the latest message that has this line. Same: equal in full (by SHA-256) after lower-casing
    and white space are set aside. What is quoted at depth d is thereby found in whoever wrote it first, not in those who quoted it on.
    reply_to is the latest message linked at the smallest depth, null if none is; n_quoted and n_linked count
    quoted lines, depth is their greatest. thread is the first message that the chain of replies leads to (else the
    message's own turn), and position orders the conversation by (thread, turn, role, MD5 of the text), so that a reply follows what it quotes.
    Quotations of what isn't in the conversation are removed all the same.

    A null text is empty; a null turn comes first and links to nothing; rows that repeat (conv_id, turn) keep a place and links
    each, and replies to their turn are one thread. Rows with a null conv_id are one conversation. Other columns aren't read; an
    empty table gives no rows. Messages meet only on (conversation, passage), and a conversation with a third of all rows is ranked in pieces.
    """
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    parts = shared.materialise(split_messages(rows).withColumn("_m", F.monotonically_increasing_id()))
    quoted = parts.where("turn is not null and size(quoted) > 0").select("_m", "conv_id", "turn", F.explode("quoted").alias("q")).select("_m", "conv_id", "turn", "q.*")
    # Only conversations with quotations, and of these only what is quoted, take part.
    some = quoted.select(F.col("conv_id").alias("_c")).distinct()
    said = parts.where("turn is not null").join(some, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").select("conv_id", "turn", lines_of(F.col("own")).alias("_lines"))
    said = said.withColumn("_own", F.filter(passages_of("_lines"), lambda p: p["depth"] == 0))
    said = said.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units_of(F.col("_own")), lambda u: u["h"]))).alias("h"))
    asked = quoted.select(F.col("conv_id").alias("_c"), F.col("h").alias("_h")).distinct()
    said = said.join(asked, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h")), "left_semi")
    found = origins(quoted, said)

    of = lambda whole, c: F.max(F.when(F.col("whole") if whole else ~F.col("whole"), F.col(c)))
    lone = F.count(F.when(~F.col("whole"), F.col("origin")))
    by_passage = found.groupBy("_m", "conv_id", "turn", "passage", "depth").agg(of(True, "origin").alias("w"), of(True, "n").alias("wn"), of(False, "origin").alias("l"), lone.alias("ln"))
    by_passage = by_passage.select("_m", "conv_id", "turn", "depth", F.coalesce("w", "l").alias("origin"), F.when(F.col("w").isNotNull(), F.col("wn")).otherwise(F.col("ln")).alias("n")).where("origin is not null")
    links = by_passage.groupBy("_m", "conv_id", "turn").agg(F.min(F.struct("depth", (-F.col("origin")).alias("o"))).alias("m"), F.sum("n").alias("n_linked"))
    links = shared.materialise(links.select("_m", "conv_id", "turn", (-F.col("m.o")).alias("reply_to"), "n_linked"))

    # Places are found for keys alone; the texts meet them once.
    heads = links.select(F.col("_m").alias("_of"), "reply_to", "n_linked")
    tops = _tops(links).select(F.col("conv_id").alias("_c2"), F.col("turn").alias("_t2"), "top")
    keys = parts.select("_m", "conv_id", "turn", "role", F.md5(F.col("own").cast("binary")).alias("_md5"))
    keys = keys.join(heads, F.col("_m") == F.col("_of"), "left").join(tops, F.col("conv_id").eqNullSafe(F.col("_c2")) & (F.col("turn") == F.col("_t2")), "left")
    keys = keys.select("_m", "conv_id", "turn", "role", "_md5", "reply_to", "n_linked", F.coalesce("top", "turn").alias("thread"))
    order = [F.col("thread").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_md5"), F.col("_m")]
    places = shared.ranked(keys, ["conv_id"], order, "position").select(F.col("_m").alias("_of"), "reply_to", "n_linked", "thread", "position")
    out = parts.select("_m", "conv_id", "turn", "role", F.col("own").alias("text"), "n_quoted", "depth").join(places, F.col("_m") == F.col("_of"))
    return out.select("conv_id", "turn", "role", "text", "reply_to", "thread", "position", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "depth")

"""Conversations in reply order, linked by the passages that messages quote.

Lines of a message carry a quote level, the number of ``>`` marks before them. Neighbouring
lines of one level are a passage. A quoted passage is normalised, hashed and joined with
the passages that messages wrote themselves; the message it came from becomes the parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import store, workspace

#: Marks before a line, with blanks between them.
MARKS = r"^((?:[ \t]*>)*)(.*)$"
#: Quoted passages with fewer letters and digits say too little to link to another conversation.
LEAST_CHARS = 8


def normal_blanks(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t]+|[ \t]+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """Passages of each message: ``place``, ``level`` and ``body``, its lines without marks.

    A passage ends where the level changes or at an empty line.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n", -1)
    marks, body = (F.regexp_extract("line", MARKS, k) for k in (1, 2))
    marked = messages.select("conv_id", "turn", "row", F.posexplode(lines).alias("at", "line"))
    marked = marked.select(
        "conv_id",
        "turn",
        "row",
        "at",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        normal_blanks(body).alias("body"),
    )
    # A line that begins a passage is numbered by how many did so before it.
    order = "(PARTITION BY row ORDER BY at)"
    begins = f"body = '' OR coalesce(lag(level) OVER {order} <> level OR lag(body) OVER {order} = '', true)"
    return (
        marked.withColumn("begins", F.expr(f"CAST({begins} AS INT)"))
        .withColumn("place", F.expr(f"sum(begins) OVER {order}"))
        .filter("body <> ''")
        .groupBy("conv_id", "turn", "row", "place", "level")
        .agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("lines"))
        .withColumn("body", F.array_join("lines.body", "\n"))
        .drop("lines")
    )


def quoted_from(parts: DataFrame) -> DataFrame:
    """Quoted passages (``row``, ``place``, ``level``) with the message each is from.

    That is the first message of the same conversation that wrote the passage itself, if it
    came before, or else the first one of any other conversation, if the passage has
    ``LEAST_CHARS`` letters and digits. Writers are reduced to one for each passage before
    the join, so a common passage is no pair of groups.
    """
    telling = F.length(F.regexp_replace("norm", r"[^\p{L}\p{N}]", "")) >= LEAST_CHARS
    known = parts.withColumn("norm", F.lower(F.regexp_replace("body", r"\s+", " ")))
    known = known.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    known = known.withColumn("hash", F.xxhash64("norm"))
    own, asked = known.filter("level = 0"), known.filter("level > 0")
    near = own.groupBy("hash", "norm", "conv_id").agg(F.min("turn").alias("near"))
    far = near.filter(telling).groupBy("hash", "norm").agg(
        F.min(F.struct("conv_id", F.col("near").alias("turn"))).alias("first"),
        F.max(F.struct("conv_id", F.col("near").alias("turn"))).alias("last"),
    )
    # Of two conversations at least one is another than the asking one.
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).when(
        F.col("last.conv_id") != F.col("conv_id"), F.col("last")
    )
    before = F.col("near") < F.col("turn")
    return (
        asked.join(near, ["hash", "norm", "conv_id"], "left")
        .join(far, ["hash", "norm"], "left")
        .select(
            "row",
            "place",
            "level",
            F.when(before, F.struct("conv_id", F.col("near").alias("turn"))).otherwise(other).alias("origin"),
        )
        .filter("origin IS NOT NULL")
    )


def threads(linked: DataFrame, folder: str) -> DataFrame:
    """First message and depth of each reply within its conversation, by pointer doubling.

    ``linked`` holds ``conv_id``, ``turn`` and ``up``, an earlier turn. The rounds grow with the
    logarithm of the longest chain of replies.
    """
    chain = linked.groupBy("conv_id", "turn").agg(F.min("up").alias("up"))
    chain = store(chain.withColumn("depth", F.lit(1).cast("bigint")), folder, "chain0")
    above = ("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
    step = 0
    while not chain.join(chain.select(*above[:2]), ["conv_id", "up"], "left_semi").isEmpty():
        step += 1
        longer = chain.join(chain.select(*above), ["conv_id", "up"], "left")
        longer = longer.select(
            "conv_id",
            "turn",
            F.coalesce("top", "up").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )
        chain = store(longer, folder, f"chain{step}")
    return chain.withColumnRenamed("up", "top")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Messages in reply order, without their quotes.

    Needs ``conv_id``, ``turn``, ``role``, ``text``; other columns are not looked at. Returns
    ``conv_id``, ``turn``, ``role``, ``own_text``, ``quotes`` (passages it quotes), ``linked`` (of
    those, found), ``parent_conv``, ``parent_turn``, ``root_turn``, ``depth``, ``position``.

    A passage of any length is found in an earlier message of its own conversation; in other
    conversations only one of at least ``LEAST_CHARS`` letters and digits. The parent is where
    the first found quotation of level 1 is from. A conversation is
    ordered by ``root_turn``, ``depth`` and ``turn``: replies stand behind the message that their
    chain of quotations starts from, and messages that quote nothing of their conversation
    keep their turn. ``position`` counts from 0 without gaps.

    A null or empty text has no passages and an empty ``own_text``. Rows with a null ``conv_id``
    or ``turn`` quote nothing and are not found; nulls come first. Rows that repeat a
    turn are kept each. An empty table gives no rows. Writes tables when called.
    """
    folder = workspace(messages.sparkSession)
    rows = messages.select("conv_id", "turn", "role", "text")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), folder, "messages")
    parts = store(passages(rows), folder, "passages")
    found = store(quoted_from(parts), folder, "found")
    of_row = parts.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("place", "body")))).alias("own"),
        F.count_if(F.col("level") > 0).alias("quotes"),
    )
    links = found.groupBy("row").agg(
        F.count("*").alias("linked"),
        F.min(F.when(F.col("level") == 1, F.struct("place", "origin"))).alias("first"),
    )
    whole = rows.join(of_row, "row", "left").join(links, "row", "left")
    whole = whole.select(
        "row",
        "conv_id",
        "turn",
        "role",
        F.coalesce(F.array_join("own.body", "\n\n"), F.lit("")).alias("own_text"),
        F.coalesce("quotes", F.lit(0)).cast("bigint").alias("quotes"),
        F.coalesce("linked", F.lit(0)).cast("bigint").alias("linked"),
        F.col("first.origin.conv_id").alias("parent_conv"),
        F.col("first.origin.turn").alias("parent_turn"),
    )
    whole = store(whole, folder, "linked")
    inside = whole.filter("parent_conv = conv_id").select(
        "conv_id", "turn", F.col("parent_turn").alias("up")
    )
    whole = whole.join(threads(inside, folder), ["conv_id", "turn"], "left").select(
        *whole.columns,
        F.coalesce("top", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
    )
    return _positions(whole, folder).select(
        "conv_id",
        "turn",
        "role",
        "own_text",
        "quotes",
        "linked",
        "parent_conv",
        "parent_turn",
        "root_turn",
        "depth",
        "position",
    )


def _positions(whole: DataFrame, folder: str) -> DataFrame:
    """Number the rows of each conversation, of which one may span many partitions.

    Rows are divided by ranges of their order; a conversation has a row in ``sizes`` for each
    partition it reaches into.
    """
    keys = ["conv_id", "root_turn", "depth", "turn", "row"]
    spread = whole.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    spread = store(spread, folder, "ordered")
    sizes = spread.groupBy(F.col("conv_id").alias("_conv"), F.col("part").alias("_part")).agg(
        F.count("*").alias("n")
    )
    bases = sizes.withColumn(
        "base", F.expr("sum(n) OVER (PARTITION BY _conv ORDER BY _part) - n")
    ).drop("n")
    place = "row_number() OVER (PARTITION BY conv_id, part ORDER BY root_turn, depth, turn, row) - 1"
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    return (
        spread.withColumn("place", F.expr(place))
        .join(bases, same)
        .withColumn("position", (F.col("base") + F.col("place")).cast("bigint"))
    )

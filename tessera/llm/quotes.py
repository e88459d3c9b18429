"""Quotation linking for message threads, with built-in functions only.

Lines that begin with '>' are quotes, as deep as they have such marks. Each quoted paragraph is normalised and hashed, as a
whole and line by line, and joined to the message that has this paragraph (or line) as its own text. The rest of a message,
without quotes and the lines that announce them, is its clean text. Messages with the ones they answer are trees; conversations
that such links connect are one thread, and the messages of a thread are numbered depth-first, each after the one it answers.

Originals are looked up as minima per key (and per conversation and key), so a passage that a third of all messages share
costs one row per map task, not a group of pairs. Trees are walked by doubling: the rounds grow with the logarithm of the
longest chain of answers. Siblings are counted over ranges of a global order, so one conversation with very many messages is
many tasks.

Defined results: null texts are empty messages; a null conv_id is a conversation of its own, null turns come first; rows
that repeat are one message, whose number they share; ties of turn are ordered by content; a quote without letters or digits
has no original; messages that quote one another in a circle lose one link of it, that of the smallest content hash; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, side, table, written

MARKS = "^[ \\t]{0,3}(>[ \\t]?)+"
ANNOUNCES = "(?i)^(on .{1,200} wrote|am .{1,200} schrieb.{0,100}|le .{1,200} a écrit|el .{1,200} escribió) ?:$"
#: Originals in other conversations are looked up for texts of at least so many words; shorter ones recur by chance.
FAR_WORDS = 3
#: Stands for a null conv_id where conversations are joined.
_NONE = -(1 << 63)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def _looked_up(run: Column) -> Column:
    """Keys of a quoted paragraph: the whole at line 0, then each of its lines; none for text without letters or digits."""
    whole = F.filter(F.array(F.struct(F.lit(0).alias("line"), normalised(run).alias("t"))), lambda x: x["t"] != "")
    lines = F.filter(F.transform(F.split(run, "\n"), normalised), lambda t: t != "")
    apart = F.transform(lines, lambda t, i: F.struct((i + 1).cast("int").alias("line"), t.alias("t")))
    every = F.concat(whole, F.when(F.size(lines) > 1, apart).otherwise(F.slice(apart, 1, 0)))
    words = lambda t: F.size(F.split(t, " "))
    return F.transform(
        every, lambda x: F.struct(x["line"].alias("line"), F.sha2(x["t"], 256).alias("key"), (words(x["t"]) >= FAR_WORDS).alias("far"))
    )


def parse(messages: DataFrame) -> DataFrame:
    """mid, conv_id, turn, role, runs: paragraphs as array<struct<depth, text>> in order, announcing lines left out."""
    base = messages.select(
        F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text"))).alias("mid"), "conv_id", "turn", "role",
        F.split(F.coalesce("text", F.lit("")), "\n").alias("_raw"),
    )
    lines = base.withColumn(
        "_lines",
        F.transform(
            "_raw",
            lambda x: F.struct(
                F.when(F.ltrim(x).startswith(">"), F.regexp_count(F.regexp_substr(x, F.lit(MARKS)), F.lit(">"))).otherwise(0).alias("d"),
                F.when(F.ltrim(x).startswith(">"), F.regexp_replace(x, MARKS, "")).otherwise(x).alias("c"),
            ),
        ),
    )
    named = lines.withColumn("_n", F.size("_raw")).withColumn(
        "_lines",
        F.transform(
            "_lines",
            lambda x, i: F.struct(
                x["d"].alias("d"), x["c"].alias("c"),
                ((F.trim(x["c"]) == "") | (F.trim(x["c"]).rlike(ANNOUNCES) & (F.get("_lines", i + 1)["d"] > x["d"]))).alias("gap"),
            ),
        ),
    )
    starts = named.withColumn(
        "_starts",
        F.filter(
            F.transform(
                "_lines",
                lambda x, i: F.when(
                    ~x["gap"] & ((i == 0) | F.get("_lines", i - 1)["gap"] | (F.get("_lines", i - 1)["d"] != x["d"])), i
                ),
            ),
            lambda s: s.isNotNull(),
        ),
    )
    runs = F.transform(
        "_starts",
        lambda s, j: F.struct(
            F.get("_lines", s)["d"].alias("depth"),
            F.array_join(
                F.transform(
                    F.filter(
                        F.slice("_lines", s + 1, F.coalesce(F.get("_starts", j + 1), F.col("_n")) - s), lambda x: ~x["gap"]
                    ),
                    lambda x: x["c"],
                ),
                "\n",
            ).alias("text"),
        ),
    )
    return starts.select("mid", "conv_id", "turn", "role", runs.alias("runs"))


def originals(parsed: DataFrame) -> DataFrame:
    """mid, n_linked and parent (conv, turn, mid): of each message with quotes that have an original.

    The original of a quoted paragraph is the first message of the same conversation that has it as its own text, if that is
    an earlier one; or else, for at least FAR_WORDS words, the first such message anywhere; or else a later one of the same
    conversation, turns being out of order; where there is none, that of its first line with one. The parent is the original
    of the shallowest linked quote; ties go to the first in order. No message is its own original.
    """
    at = F.struct(F.coalesce("conv_id", F.lit(_NONE)).alias("conv"), F.col("turn"), F.col("mid"))
    quoted = parsed.select(at.alias("at"), F.explode(F.filter("runs", lambda r: r["depth"] > 0)).alias("r"))
    quoted = quoted.select("at", F.col("r.depth").alias("depth"), F.sha2(normalised(F.col("r.text")), 256).alias("run"), F.explode(_looked_up(F.col("r.text"))).alias("k"))
    # a paragraph that repeats in a message is one quote; the same text can be broken into lines in more than one way
    quoted = quoted.groupBy("at", "depth", "run", F.col("k.key").alias("key")).agg(F.min("k.line").alias("line"), F.max("k.far").alias("far"))
    own = parsed.select(at.alias("at"), F.filter("runs", lambda r: r["depth"] == 0).alias("own"))
    texts = F.flatten(F.transform("own", lambda r: F.array_append(F.split(r["text"], "\n"), r["text"])))
    own = own.select("at", F.explode(F.array_distinct(F.transform(texts, normalised))).alias("t")).where("t <> ''")
    own = own.select("at", F.sha2("t", 256).alias("key")).join(side(quoted.select("key").distinct()), "key", "left_semi")
    first = written(own.groupBy(F.col("at.conv").alias("conv"), "key").agg(F.min("at").alias("inside")), "own")
    anywhere = first.groupBy("key").agg(F.min("inside").alias("anywhere"))
    near = quoted.withColumn("conv", F.col("at.conv")).join(first, ["conv", "key"], "left").join(anywhere, "key", "left")
    other = lambda c: F.when(F.col(c)["mid"] != F.col("at")["mid"], F.col(c))
    to = F.coalesce(F.when(F.col("inside") < F.col("at"), F.col("inside")), F.when(F.col("far"), other("anywhere")), other("inside"))
    found = near.select("at", "depth", "run", "line", to.alias("to")).where("to is not null")
    runs = found.groupBy("at", "depth", "run").agg(F.min(F.struct("line", "to"))["to"].alias("to"))
    links = runs.groupBy("at").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("depth", "to"))["to"].alias("parent"))
    return links.select(F.col("at.mid").alias("mid"), "n_linked", "parent")


def _doubled(edges: DataFrame) -> DataFrame:
    """(mid, up): for each message, the ancestor twice as far up, where there is one."""
    above = edges.select(F.col("mid").alias("via"), "up")
    return written(edges.select("mid", F.col("up").alias("via")).join(side(above), "via").select("mid", "up"), "up")


def without_circles(edges: DataFrame) -> DataFrame:
    """(mid, up) without the link of one message of each circle: the smallest mid of it."""
    total, span, at = edges.count(), 1, edges
    while span <= total and at.limit(1).count():
        at, span = _doubled(at), 2 * span
    ring = written(at.select(F.col("up").alias("mid")).distinct(), "circles")
    total = ring.count()
    if not total:
        return edges
    low = edges.join(side(ring), "mid", "left_semi").withColumn("low", F.col("mid"))
    span = 1
    while span <= total:
        above = low.select(F.col("mid").alias("up"), F.col("up").alias("further"), F.col("low").alias("lower"))
        low = written(low.join(side(above), "up").select("mid", F.col("further").alias("up"), F.least("low", "lower").alias("low")), "low")
        span *= 2
    return written(edges.join(side(low.where("low = mid").select("mid")), "mid", "left_anti"), "edges")


def _sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(mid, size): messages in the tree below each message, itself included.

    After k rounds, size counts what is less than 2^k answers away; adding the sizes of those just 2^k away doubles it.
    """
    size, at = nodes.select("mid", F.lit(1).cast("long").alias("size")), edges
    while at.limit(1).count():
        more = at.join(side(size), "mid").groupBy(F.col("up").alias("mid")).agg(F.sum("size").alias("more"))
        size = written(size.join(side(more), "mid", "left").select("mid", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        at = _doubled(at)
    return size


def _path_sums(rows: DataFrame) -> DataFrame:
    """(mid, steps, value) from (mid, up, value): links up to the root, and the sum of the values from there down to the message."""
    rows = rows.select("mid", "up", "value", F.col("up").isNotNull().cast("long").alias("steps"))
    while rows.where("up is not null").limit(1).count():
        above = rows.select(F.col("mid").alias("up"), F.col("up").alias("further"), F.col("value").alias("v"), F.col("steps").alias("s"))
        sums = ((F.col("value") + F.coalesce("v", F.lit(0))).alias("value"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps"))
        rows = written(rows.join(side(above), "up", "left").select("mid", F.col("further").alias("up"), *sums), "paths")
    return rows.select("mid", "steps", "value")


def _before(rows: DataFrame) -> DataFrame:
    """rows (group, conv, turn, mid, size, ...) with `before`: the sizes of earlier rows of the group.

    The global order is cut into ranges; sums within a range, and of earlier ranges that have part of the group, add up.
    """
    order = ["group", "conv", "turn", "mid"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // 200_000 + 1)
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("group", "range").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("group", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("group", "range").orderBy("conv", "turn", "mid").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(side(offsets), ["group", "range"])
    return joined.withColumn("before", F.col("before") + F.col("offset")).drop("range", "offset")


def threads(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """mid, thread, depth and place of each message, from nodes (mid, conv, turn) and links (mid, parent).

    thread: smallest conversation of those that links connect; place: from 0 on, depth-first, siblings by conversation and turn.
    """
    edges = without_circles(links.select("mid", F.col("parent.mid").alias("up")))
    kept = links.join(side(edges), "mid")
    across = kept.join(side(nodes), "mid").select(F.col("conv").alias("a"), F.col("parent.conv").alias("b")).where("a <> b")
    across = written(across.distinct(), "across")
    rows = nodes.withColumn("thread", F.col("conv"))
    if across.limit(1).count():
        joined = components(across).withColumnRenamed("node", "conv")
        rows = nodes.join(side(joined), "conv", "left").withColumn("thread", F.coalesce("component", "conv")).drop("component")
    rows = written(rows.join(side(edges), "mid", "left"), "tree")
    rows = rows.join(side(_sizes(nodes, edges)), "mid")
    # the children of a message, or of the thread
    group = F.coalesce("up", F.concat(F.lit("thread "), F.col("thread").cast("string")))
    placed = written(_before(rows.withColumn("group", group)), "siblings")
    value = F.when(F.col("up").isNull(), F.col("before")).otherwise(F.col("before") + 1)
    sums = _path_sums(placed.select("mid", "up", value.alias("value")))
    return placed.select("mid", "thread").join(side(sums), "mid").select("mid", "thread", F.col("steps").alias("depth"), F.col("value").alias("place"))


def link(messages: DataFrame) -> DataFrame:
    """One row per message: its clean text, quotes, the message it answers, its thread and its place in reply order, from 1 on."""
    parsed = parse(messages)
    nodes = parsed.select("mid", F.coalesce("conv_id", F.lit(_NONE)).alias("conv"), "turn").distinct()
    nodes = written(nodes, "messages")
    links = written(originals(parsed), "originals")
    numbers = written(threads(nodes, links).join(side(links), "mid", "left"), "numbers")
    clean = parsed.select(
        "mid", "conv_id", "turn", "role",
        F.array_join(F.transform(F.filter("runs", lambda r: r["depth"] == 0), lambda r: r["text"]), "\n").alias("clean_text"),
        F.size(F.filter("runs", lambda r: r["depth"] > 0)).cast("long").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["depth"])), F.lit(0)).alias("max_depth"),
    )
    known = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return clean.join(side(numbers), "mid").select(
        "conv_id", "turn", "role", "clean_text", "n_quotes", "max_depth", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        known("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), known("thread").alias("thread_id"),
        "depth", (F.col("place") + 1).alias("reply_order"),
    )


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))

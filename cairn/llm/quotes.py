"""Quotation linking: replies find the messages they quote, and conversations lose their quotes.

Leading ``>`` marks give a line its quote level. Quoted lines, pairs of adjacent lines and passages
are hashed in a normalised form, and each hash is joined to the latest earlier message of the same
conversation that says it unquoted, or, where none does, to the first message of another. The
message with most votes is the parent once the passages themselves have been compared; a message
without a quote follows the turn before it.

Messages that follow one another form segments, so trees have a node a segment, not a message.
Roots and depths come from pointer doubling over segments, positions in reply order from ranking
their Euler tours; rounds grow with the logarithm of the segments, and there is none where nothing
is quoted but the turn before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_unique, ship, stash

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: Turns (or conversations) that one window spans, however many there are.
SPAN = 1024


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without marks) of each line."""
    out = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(text: str) -> str:
    return " ".join(text.casefold().split())


def key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def sayings(text: str) -> tuple[str, list[tuple[int, str]], int]:
    """Body without quotes, (level, what is said) and how many passages are quoted.

    Said is each line that is not blank, each two adjacent ones, and each run of lines of one level.
    """
    body, said, passages = [], [], 0
    run: list[str] = []
    lines = levels(text)
    for k, (level, line) in enumerate(lines):
        run.append(line)
        if level == 0:
            body.append(line)
        if k + 1 == len(lines) or lines[k + 1][0] != level:
            own = [x for x in map(normal, run) if x]
            if own:
                passages += level > 0
                said += [(level, x) for x in {*own, *map(" ".join, zip(own, own[1:], strict=False)), " ".join(own)}]
            run = []
    return "\n".join(body).strip("\n"), said, passages


def parse(text: str) -> tuple[str, list[tuple[int, int]], list[int], int]:
    """Body without quotes, (level, hash) of what is quoted, hashes of what the body says, quoted passages."""
    body, said, passages = sayings(text)
    hashed = {(level, key(x)) for level, x in said}
    return body, sorted(x for x in hashed if x[0]), sorted(h for level, h in hashed if not level), passages


def link_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text): conv_id, turn, role, ``body``
    without quotes, ``n_quotes`` (quoted passages), ``linked``, ``parent_conv`` and
    ``parent_turn``, ``root_conv`` and ``root_turn``, ``depth`` and ``position``.

    Each quoted line, pair of lines and passage votes for the latest earlier message of the
    conversation that says it. The parent is the message with most votes at the lowest level that
    has any, then the latest. Only for levels without a vote do the first messages of other
    conversations count, one a hash, that of the smallest (conv_id, turn). A message without such
    a quote follows the turn before it in its conversation, if any.
    Roots have no parent. Where conversations quote one another in a circle, the smallest (conv_id,
    turn) of the circle is made a root and keeps ``linked``. ``position`` counts from the root in
    reply order: each message comes right before its replies with all of theirs; of these, the
    next turn comes first, then others of the conversation, then those of others.
    Null texts are empty; a row without conv_id or turn has no parent and is its own root. Rows
    that repeat conv_id and turn share what they quote and say, and their position. Other columns
    are ignored; an empty table stays empty.
    """
    ship(messages.sparkSession)
    names = ["conv_id", "turn", "role", "body", "n_quotes", "quoted", "own", "text"]
    schema = "conv_id long, turn long, role string, body string, n_quotes long, quoted array<struct<level:int,h:long>>, own array<long>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(3).to_pylist()
                done = [parse(x or "") for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in range(3)), pa.array([d[0] for d in done], pa.string()), pa.array([d[3] for d in done], pa.int64()),
                        pa.array([[{"level": a, "h": h} for a, h in d[1]] for d in done], kind), pa.array([d[2] for d in done], pa.list_(pa.int64())),
                        # the body is the text where nothing is quoted
                        pa.array([x if d[3] else None for x, d in zip(texts, done, strict=True)], pa.string()),
                    ],
                    names,
                )

    source = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col(text_col).cast("string").alias("text"))
    parsed = stash(source.mapInArrow(run, schema), "parsed")
    keyed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = stash(keyed.where("size(quoted) > 0").select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.h").distinct(), "asked")
    links = _links(keyed, asked)
    before = previous_turns(keyed.select("conv_id", "turn").distinct())
    turns = stash(before.join(links, ["conv_id", "turn"], "left"), "turns")
    placed = _segments(turns)
    trees = _trees(placed)
    if trees is not None:
        placed = join_unique(placed, trees, ["conv_id", "head"]).withColumns(
            {
                "root_conv": F.coalesce("tree_conv", "conv_id"), "root_turn": F.coalesce("tree_turn", "head"),
                "depth": F.coalesce("tree_depth", F.lit(0)) + F.col("offset"), "position": F.coalesce("tree_position", F.lit(0)) + F.col("offset"), "cut": F.coalesce("cut", F.lit(False)),
            }
        )
    else:
        placed = placed.withColumns({"root_conv": F.col("conv_id"), "root_turn": F.col("head"), "depth": F.col("offset"), "position": F.col("offset"), "cut": F.lit(False)})
    linked = F.col("to_turn").isNotNull()
    found = placed.select(
        "conv_id", "turn", linked.alias("linked"),
        F.when(F.col("cut") & (F.col("turn") == F.col("head")), None).when(linked, F.col("to_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(~F.col("cut") | (F.col("turn") != F.col("head")), F.coalesce("to_turn", "before")).alias("parent_turn"),
        "root_conv", "root_turn", "depth", "position",
    )
    joined = parsed.drop("quoted", "own", "text").join(found, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "body", "n_quotes", F.coalesce("linked", F.lit(False)).alias("linked"), "parent_conv", "parent_turn",
        F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("depth", "position")),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Conversations one after another, each in reply order, dealt over partitions by ranges, so that
    a conversation of any size is never in one task."""
    order = ["root_conv", "root_turn", "position", "conv_id", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)


def _links(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn) of messages that quote one that is known."""
    wanted = stash(keyed.select("conv_id", "turn", F.explode("own").alias("h")).join(asked.select("h").distinct(), "h", "left_semi").distinct(), "wanted")
    heard = wanted.select("conv_id", "h", "turn", F.col("turn").alias("v"), F.lit(False).alias("asks"))
    asks = asked.select("conv_id", "h", "turn", F.lit(None).cast("long").alias("v"), F.lit(True).alias("asks")).distinct()
    latest = _before(heard.unionByName(asks), ["conv_id", "h"]).where("asks AND last IS NOT NULL").select("conv_id", "h", "turn", F.col("last").alias("said"))
    near = asked.join(latest, ["conv_id", "h", "turn"]).groupBy("conv_id", "turn", "level", "said").agg(F.count(F.lit(1)).alias("n"))
    near = stash(near, "near")
    firsts = wanted.groupBy("h", "conv_id").agg(F.min("turn").alias("turn"))
    far = firsts.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("far"))
    other = firsts.join(far, "h").where("conv_id != far.conv_id").groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("other"))
    elsewhere = (
        join_unique(asked.join(near, ["conv_id", "turn", "level"], "left_anti"), far.join(other, "h", "left"), ["h"])
        .withColumn("to", F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).otherwise(F.col("other")))
        .where("to IS NOT NULL")
        .groupBy("conv_id", "turn", "level", "to")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    votes = near.select("conv_id", "turn", "level", F.struct("conv_id", F.col("said").alias("turn")).alias("to"), "n").unionByName(elsewhere)
    # the own conversation first, so that two messages of one text in two conversations don't swap
    best = F.max(F.struct((-F.col("level")).alias("a"), (F.col("to.conv_id") == F.col("conv_id")).alias("b"), F.col("n").alias("c"), F.col("to.turn").alias("d"), (-F.col("to.conv_id")).alias("e")))
    links = stash(votes.groupBy("conv_id", "turn").agg(best.alias("m")).select("conv_id", "turn", (-F.col("m.e")).alias("to_conv"), F.col("m.d").alias("to_turn")), "links")
    return _compared(links, keyed)


def _compared(links: DataFrame, keyed: DataFrame) -> DataFrame:
    """Links whose messages share a passage, compared as it reads and not by its hash."""
    if links.isEmpty():
        return links
    texts = keyed.groupBy("conv_id", "turn").agg(F.max("text").alias("quoting"))
    ends = links.select(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn")).distinct()
    # repeated rows of one key share what they say
    bodies = keyed.join(ends, ["conv_id", "turn"], "left_semi").groupBy(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn")).agg(F.array_join(F.collect_set("body"), "\n> \n").alias("body"))
    pairs = join_unique(links.join(texts, ["conv_id", "turn"]), bodies, ["to_conv", "to_turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(4), batch.column(5), strict=True):
                quoted = {x for level, x in sayings(a.as_py() or "")[1] if level}
                keep.append(any(level == 0 and x in quoted for level, x in sayings(b.as_py() or "")[1]))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3])

    # a repeated row may quote what the one compared does not
    several = keyed.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    single = pairs.select("conv_id", "turn", "to_conv", "to_turn", "quoting", "body").mapInArrow(run, "conv_id long, turn long, to_conv long, to_turn long")
    return stash(single.unionByName(links.join(several, ["conv_id", "turn"], "left_semi")).distinct(), "compared")


def _before(events: DataFrame, group: list[str]) -> DataFrame:
    """``events`` (group, turn, v, ...) with ``last``: the largest v of an earlier turn of the group.

    Windows span ``SPAN`` turns, and then one row a span, however many turns a group has.
    """
    cut = events.withColumn("span", F.floor(F.col("turn") / SPAN))
    earlier = lambda *keys: Window.partitionBy(*keys)
    inner = cut.withColumn("inner", F.max("v").over(earlier(*group, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)))
    spans = cut.groupBy(*group, "span").agg(F.max("v").alias("top"))
    outer = spans.withColumn("outer", F.max("top").over(earlier(*group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    return inner.join(outer, [*group, "span"]).withColumn("last", F.greatest("inner", "outer")).drop("inner", "outer", "span")


def previous_turns(keys: DataFrame) -> DataFrame:
    """(conv_id, turn, before, idx) for distinct keys: the turn before, and how many come before."""
    last = _before(keys.withColumn("v", F.col("turn")), ["conv_id"]).select("conv_id", "turn", F.col("last").alias("before"))
    cut = last.withColumn("span", F.floor(F.col("turn") / SPAN))
    inner = cut.withColumn("inner", F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("turn")) - 1)
    spans = cut.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"))
    outer = spans.withColumn("outer", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return inner.join(outer, ["conv_id", "span"]).select("conv_id", "turn", "before", (F.col("inner") + F.col("outer")).alias("idx"))


def _segments(turns: DataFrame) -> DataFrame:
    """turns with ``head`` (the turn its segment starts at), ``offset`` in it and ``follows``.

    A segment is a run of turns that follow, or quote, the turn before them.
    """
    follows = F.col("before").isNotNull() & (F.col("to_turn").isNull() | ((F.col("to_conv") == F.col("conv_id")) & (F.col("to_turn") == F.col("before"))))
    marked = turns.withColumn("follows", follows).withColumn("start", F.when(~follows, F.struct("turn", "idx")))
    headed = _before(marked.withColumn("v", F.col("start")), ["conv_id"]).withColumn("at", F.coalesce("start", "last"))
    return stash(headed.select("conv_id", "turn", "before", "to_conv", "to_turn", "follows", F.col("at.turn").alias("head"), (F.col("idx") - F.col("at.idx")).alias("offset")), "segments")


def _node(conv: str, turn: str) -> Column:
    return F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn"))


def _trees(placed: DataFrame) -> DataFrame | None:
    """(conv_id, head, tree_conv, tree_turn, tree_depth, tree_position, cut) of the segments of trees of
    more than one; None if there is none."""
    jumps = placed.where("NOT follows AND to_turn IS NOT NULL").select("conv_id", "head", "to_conv", "to_turn")
    if jumps.isEmpty():
        return None
    ends = placed.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("head").alias("up_head"), F.col("offset").alias("up_offset"))
    edges = stash(join_unique(jumps, ends, ["to_conv", "to_turn"]).select(_node("conv_id", "head").alias("node"), _node("to_conv", "up_head").alias("up"), "up_offset"), "edges")
    roots, cut = _roots(edges)
    edges = edges.join(cut, "node", "left_anti")
    inside = edges.select("node").union(edges.select("up")).union(cut.select("node")).distinct()
    sizes = placed.groupBy(_node("conv_id", "head").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    rooted = inside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    nodes = stash(rooted.join(sizes, "node").join(cut.withColumn("cut", F.lit(True)), "node", "left"), "nodes")
    ranks = _reply_order(nodes, edges)
    whole = ranks.select(F.col("node").alias("root"), F.col("left").alias("all"))
    return join_unique(nodes.join(ranks, "node"), whole, ["root"]).select(
        F.col("node.conv").alias("conv_id"), F.col("node.turn").alias("head"), F.col("root.conv").alias("tree_conv"), F.col("root.turn").alias("tree_turn"),
        F.col("depth").alias("tree_depth"), (F.col("all") - F.col("left")).alias("tree_position"), F.coalesce("cut", F.lit(False)).alias("cut"),
    )


def _doubled(now: DataFrame, end: str, sums: list[str], name: str) -> DataFrame:
    """One step of pointer doubling of rows (node, ``end``, sums): an end without a row of its own stays."""
    hop = now.select(F.col("node").alias(end), F.col(end).alias("_next"), *(F.col(s).alias(f"_{s}") for s in sums))
    joined = join_unique(now, hop, [end])
    return stash(joined.select("node", F.coalesce("_next", end).alias(end), *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums)), name)


def _roots(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root, depth) of edges (node, up, up_offset), and the nodes whose edges were cut.

    After as many doublings as 2 to their power exceeds the edges, what still has an edge at its
    end is on a circle or leads to one, and its end is on it.
    """
    total = edges.count()
    now = edges.select("node", F.col("up").alias("root"), (F.col("up_offset") + 1).alias("depth"))
    none = edges.select("node").limit(0)
    for _ in range(total.bit_length()):
        if _open(now).isEmpty():
            return now, none
        now = _doubled(now, "root", ["depth"], "roots")
    circle = stash(_open(now).select(F.col("root").alias("node")).distinct(), "circle")
    if circle.isEmpty():
        return now, none
    least = edges.join(circle, "node", "left_semi").select("node", "up", F.col("node").alias("least"))
    for _ in range(circle.count().bit_length()):
        hop = least.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        least = stash(least.join(hop, "up").select("node", F.col("_up").alias("up"), F.least("least", "_least").alias("least")), "least")
    cut = stash(least.where("node = least").select("node"), "cut")
    return _roots(edges.join(cut, "node", "left_anti"))[0], cut


def _open(now: DataFrame) -> DataFrame:
    """Rows whose root has an edge itself."""
    return now.join(now.select(F.col("node").alias("root")), "root", "left_semi")


def _reply_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, left): messages of the tree from the start of each segment on, in reply order.

    The tour enters a segment, then those below it (replies to its last message first), and leaves it.
    """
    children = join_unique(edges, nodes.select("node", "root"), ["node"]).select("node", "up", "up_offset", (F.col("node.conv") != F.col("up.conv")).alias("foreign"))
    order = F.struct((-F.col("up_offset")).alias("a"), F.col("foreign").alias("b"), F.col("node.conv").alias("c"), F.col("node.turn").alias("d"))
    span = F.struct((-F.col("up_offset")).alias("a"), F.col("foreign").alias("b"), F.floor(F.col("node.conv") / SPAN).alias("c"), F.when(~F.col("foreign"), F.floor(F.col("node.turn") / SPAN)).alias("d"))
    cut = children.select("node", "up", order.alias("o"), span.alias("span"))
    inner = cut.withColumn("inner", F.lead("node").over(Window.partitionBy("up", "span").orderBy("o")))
    spans = cut.groupBy("up", "span").agg(F.min(F.struct("o", "node"))["node"].alias("start"))
    outer = spans.withColumn("outer", F.lead("start").over(Window.partitionBy("up").orderBy("span"))).drop("start")
    siblings = inner.join(outer, ["up", "span"]).select("node", "up", F.coalesce("inner", "outer").alias("next"))
    firsts = cut.groupBy("up").agg(F.min(F.struct("o", "node"))["node"].alias("first")).withColumnRenamed("up", "node")
    known = nodes.select("node", "size").join(siblings, "node", "left").join(firsts, "node", "left")

    def stop(node: str, leaving: Column) -> Column:
        return F.struct(F.col(f"{node}.conv").alias("conv"), F.col(f"{node}.turn").alias("turn"), leaving.alias("leaving"))

    enter, leave = F.lit(False), F.lit(True)
    onward = F.when(F.col("first").isNotNull(), stop("first", enter)).otherwise(stop("node", leave))
    after = F.when(F.col("next").isNotNull(), stop("next", enter)).when(F.col("up").isNotNull(), stop("up", leave))
    tour = known.select(F.explode(F.array(F.struct(stop("node", enter).alias("node"), onward.alias("end"), F.col("size").alias("left")), F.struct(stop("node", leave).alias("node"), after.alias("end"), F.lit(0).cast("long").alias("left")))).alias("s")).select("s.*")
    # the last stop of a tour has no end and adds nothing
    now = stash(tour.where("end IS NOT NULL"), "tour")
    while not now.join(now.select(F.col("node").alias("end")), "end", "left_semi").isEmpty():
        now = _doubled(now, "end", ["left"], "tour")
    return now.where("NOT node.leaving").select(F.struct("node.conv", "node.turn").alias("node"), "left")


def op2_quote_linking(spark, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

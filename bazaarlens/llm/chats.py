"""Reply trees to chat text: root-to-leaf paths by self-joins, branches ranked by score, one conversation per path."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

CHUNK_TURNS = 1024
SEGMENT_CHARS = 1 << 22
ROUNDS = 60


@dataclass(frozen=True)
class Template:
    """Marks of a turn. ``others`` are further control strings, escaped in texts like the marks.

    A turn is ``begin + role + says + text + end``. In roles and texts a backslash is doubled and a
    control string gets one after its first character, so that none is left there and reading
    the turn back is exact. No control string may hold a backslash, or the first character
    of one anywhere but in its own first place: then none can arise across a seam either.
    """

    begin: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>"
    learns: tuple[str, ...] = ("assistant",)
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self):
        heads = {c[0] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or heads & set(c[1:]) for c in self.controls):
            raise ValueError("control strings need two characters, no backslash, and first characters that none holds further on")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.says, self.end, *self.others)

    def escape(self, text: Column) -> Column:
        tails: dict[str, list[str]] = {}
        for c in self.controls:
            tails.setdefault(c[0], []).append(_quote(c[1:]))
        found = "|".join(f"{_quote(head)}(?=(?:{'|'.join(rest)}))" for head, rest in tails.items())
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({found})", "$1\\\\")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _node(tree: Column, message: Column) -> Column:
    """One key of a message in its tree; null where ``message`` is."""
    return F.concat(F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-")), F.lit("\x00"), message.cast("string"))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, parent, depth, total) of every node, and its ancestors (node, above) at distances 1, 2, 4 and so on.

    ``nodes``: unique node, parent (null, or a node), score. Each round joins the ancestors of the
    nodes that have not met their root with the same table and so doubles the distance: 1,000
    replies in a chain take 10 rounds. Replies in a circle never meet a root; a circle is opened
    at its smallest node, the one that is the smallest among its own ancestors.
    """
    while True:
        now = stage(nodes.select("node", "parent", F.col("parent").alias("above"), F.col("parent").alias("low"), F.lit(1).alias("met"), F.col("score").alias("total")), "replies")
        done, jumps, mark = now.filter("above IS NULL"), [], None
        for k in range(ROUNDS):
            live = now.filter("above IS NOT NULL")
            seen = tuple(live.agg(F.count("*"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first())
            if not seen[0]:
                return done.select("node", "parent", (F.col("met") - 1).alias("depth"), "total"), jumps
            if seen == mark:
                break
            mark = seen
            jumps.append(live.select("node", "above"))
            over = done.unionByName(live).select(F.col("node").alias("at"), F.col("above").alias("beyond"), F.col("low").alias("lower"), F.col("met").alias("more"), F.col("total").alias("rest"))
            now = stage(live.join(over, F.col("above") == F.col("at")).select(
                "node", "parent", F.col("beyond").alias("above"), F.least("low", "lower").alias("low"), (F.col("met") + F.col("more")).alias("met"), (F.col("total") + F.col("rest")).alias("total")), "replies")
            done = done.unionByName(now.filter("above IS NULL"))
        heads = now.filter("node = low").select(F.col("node").alias("head"))
        nodes = stage(nodes.join(heads, F.col("node") == F.col("head"), "left").select("node", F.when(F.col("head").isNull(), F.col("parent")).alias("parent"), "score"), "opened")


def paths(links: DataFrame, best: int | None = None) -> DataFrame:
    """(conv_id, leaf, branch, position, node) of the best root-to-leaf paths.

    ``links``: conv_id, unique node, parent (a node's key or null), score. From each chosen leaf, self-joins with the
    ancestors at distances ..., 4, 2, 1 add all nodes above it: as many rounds as the depth's logarithm.
    """
    names = links.select(F.col("node").alias("found"))
    known = links.join(names, (F.col("parent") == F.col("found")) & (F.col("parent") != F.col("node")), "left").select("node", F.col("found").alias("parent"), "score")
    climbed, jumps = _climb(known)
    replied = climbed.select(F.col("parent").alias("replied")).filter("replied IS NOT NULL").distinct()
    leaves = climbed.join(replied, F.col("node") == F.col("replied"), "left_anti").select(F.col("node").alias("leaf"), "depth", "total")
    leaves = leaves.join(links.select("node", "conv_id"), F.col("leaf") == F.col("node")).select("conv_id", "leaf", "depth", "total")
    if best is None:
        leaves = leaves.withColumn("branch", F.lit(None).cast("int"))
    else:
        order = Window.partitionBy("conv_id").orderBy(F.col("total").desc(), "leaf")
        leaves = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= best)
    members = stage(leaves.select("conv_id", "leaf", "branch", F.col("depth").alias("position"), F.col("leaf").alias("node")), "paths")
    for k in reversed(range(len(jumps))):
        up = jumps[k].select(F.col("node").alias("at"), "above")
        more = members.join(up, F.col("node") == F.col("at")).select("conv_id", "leaf", "branch", (F.col("position") - (1 << k)).alias("position"), F.col("above").alias("node"))
        members = stage(members.unionByName(more), "paths")
    return members


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _with_texts(members: DataFrame, rows: DataFrame) -> DataFrame:
    own = rows.select(F.col("node").alias("at"), "role", "text")
    return members.join(own, F.col("node") == F.col("at")).select("conv_id", "leaf", "branch", "position", "role", "text")


def reply_paths(messages: DataFrame, tree: str = "conv_id", message: str = "message_id", parent: str = "parent_id", role: str = "role", text: str = "text",
                score: str | None = None, best: int | None = None) -> DataFrame:
    """Turns of the best root-to-leaf paths of every reply tree.

    Returns conv_id, leaf (key of the path's last message), branch (1 for the best, null without ``best``), position
    (0 for the root), role and text. A branch is worth the sum of the scores on its path; equal ones go by the
    key of their leaf. With ``best`` only so many branches of a tree are returned, otherwise all.

    Paths are enumerated on keys alone and meet the texts once. A message with very many replies is a hot join
    key whose other side is unique, which adaptive execution splits; ranks are limited below their shuffle.

    Rows of one message id are its parts: turns of their own, in the order of role and text, under
    the smallest parent and with the largest score among them. A parent that does not exist in the tree, or is the
    message itself, makes a root; a circle of replies is opened at its smallest message. Rows without id have no
    replies; those alike in parent, role and text are parts of one message. Null tree ids are one tree, null
    scores 0, null roles and texts empty. No rows in, no rows out; further columns are not read.
    """
    rows = messages.select(F.col(tree).alias("conv_id"), F.col(message).cast("string").alias("id"), F.col(parent).cast("string").alias("up"), _text(role).alias("role"), _text(text).alias("text"),
                           (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    unnamed = F.concat(F.lit("\x00"), F.sha2(F.concat_ws("\x00", "up", "role", "text").cast("binary"), 256))
    rows = rows.withColumn("node", _node(F.col("conv_id"), F.coalesce(F.col("id"), unnamed))).withColumn("parent", _node(F.col("conv_id"), F.col("up")))
    links = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.max("score").alias("score"))
    return _with_texts(paths(stage(links, "messages"), best), rows)


def turn_paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learns: tuple[str, ...] = ("assistant",), best: int | None = 1) -> DataFrame:
    """As ``reply_paths``, for rows numbered by turn: every turn replies to the one before it, so a tree is a chain.

    The turn before is looked for among 1,024 turn numbers, then among the last turns of such ranges, so no window
    holds more than a small part of a long conversation. A score is the number of a turn's rows whose role is learnt.
    Rows of equal turn follow each other by role and text, a null turn comes first; turns are whole numbers.
    """
    first = F.lit(-(1 << 62)).cast("bigint")
    rows = conversations.select(F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("bigint"), first).alias("turn"), _text(role).alias("role"), _text(text).alias("text"))
    rows = rows.withColumn("node", _node(F.col("conv_id"), F.col("turn")))
    turns = rows.groupBy("conv_id", "turn").agg(F.sum(F.col("role").isin(*learns).cast("double")).alias("score")).withColumn("chunk", F.floor(F.col("turn") / CHUNK_TURNS))
    turns = stage(turns.withColumn("tree", _node(F.col("conv_id"), F.lit("")))
                  .withColumn("before", F.lag("turn").over(Window.partitionBy("tree", "chunk").orderBy("turn"))), "turns")
    ranges = turns.groupBy("tree", "chunk").agg(F.max("turn").alias("last"))
    ranges = ranges.select(F.col("tree").alias("in_tree"), F.col("chunk").alias("in_chunk"), F.lag("last").over(Window.partitionBy("tree").orderBy("chunk")).alias("carried")).filter("carried IS NOT NULL")
    linked = turns.join(ranges, (F.col("tree") == F.col("in_tree")) & (F.col("chunk") == F.col("in_chunk")), "left")
    links = linked.select("conv_id", _node(F.col("conv_id"), F.col("turn")).alias("node"), _node(F.col("conv_id"), F.coalesce("before", "carried")).alias("parent"), "score")
    return _with_texts(paths(stage(links, "messages"), best), rows)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One conversation per path, as text with its loss mask.

    Returns conv_id, leaf, branch, segment, n_turns, formatted and loss, an array of (start, stop) in code points of
    ``formatted``: the texts of the roles that are learnt. Nearly every conversation is one row; one of more than
    1,024 positions or about 4 million characters goes on in further rows, in the order of segment, so that none is
    gathered in a task as a whole. Concatenated, its rows are the conversation.

    ``turns``: conv_id, leaf, branch, position, role, text, as the path functions return them. Turns of equal position follow each other
    by role and text. Null roles and texts are empty. No rows in, no rows out.
    """
    head = F.concat(F.lit(template.begin), template.escape(_text("role")), F.lit(template.says))
    rows = turns.select("conv_id", "leaf", "branch", "position", F.floor(F.col("position") / CHUNK_TURNS).alias("chunk"), _text("role").alias("role"), _text("text").alias("text"),
                        head.alias("head"), template.escape(_text("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(template.end)))
    order = Window.partitionBy("leaf", "chunk").orderBy("position", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "leaf", "branch", "chunk", "piece", F.char_length("head").alias("lead"), F.char_length("body").alias("length"), F.col("role").isin(*template.learns).alias("learns"),
                       F.sum(F.char_length("piece").cast("bigint")).over(order).alias("upto"), F.row_number().over(order).alias("at"))
    rows = rows.withColumn("segment", F.col("chunk") * (1 << 24) + F.floor((F.col("upto") - F.char_length("piece")) / SEGMENT_CHARS))
    parts = rows.groupBy("leaf", "chunk", "segment").agg(
        F.first("conv_id").alias("conv_id"), F.first("branch").alias("branch"), F.count(F.lit(1)).alias("n_turns"), F.min(F.col("upto") - F.char_length("piece")).alias("origin"),
        F.sort_array(F.collect_list(F.struct("at", "piece", (F.col("upto") - F.char_length("piece") + F.col("lead")).alias("start"), "length", "learns"))).alias("turns"))
    learnt = F.filter("turns", lambda t: t["learns"])
    return parts.select("conv_id", "leaf", "branch", "segment", "n_turns", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                        F.transform(learnt, lambda t: F.struct((t["start"] - F.col("origin")).alias("start"), (t["start"] - F.col("origin") + t["length"]).alias("stop"))).alias("loss"))


def parse(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted segment."""
    out = []
    for turn in formatted.split(template.end)[:-1]:
        role, text = turn[len(template.begin) :].split(template.says)
        out.append((template.unescape(role), template.unescape(text)))
    return out


def read_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns (conv_id, leaf, branch, segment, place, role, text) read back from formatted segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, formatted in enumerate(batch.column(4)):
                turns = parse(formatted.as_py(), template)
                keys = [pa.array([batch.column(c)[i].as_py()] * len(turns), batch.column(c).type) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(range(len(turns)), pa.int64()), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())],
                                                 names=["conv_id", "leaf", "branch", "segment", "place", "role", "text"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "leaf", "branch", "segment", "formatted").mapInArrow(work, f"conv_id {kind}, leaf string, branch int, segment bigint, place bigint, role string, text string")


def digest_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, what its formatted text and loss mask say when they are read back.

    Returns conv_id, leaf, n_turns, turns_sha256 (of role, line feed, text, line feed per turn), loss_chars and loss_sha256 (texts under the
    mask, unescaped) and formatted_chars. A digest runs over a conversation from its first to its last segment; a task holds one segment at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        open_, done = None, []

        def out():
            rows = [(*c["key"], c["n"], c["turns"].hexdigest(), c["chars"], c["loss"].hexdigest(), c["size"]) for c in done]
            done.clear()
            kinds = [kind, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["conv_id", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.column(0).type
            for conv, leaf, formatted, loss in zip(*(batch.column(c) for c in (0, 1, 3, 4))):
                conv, leaf, formatted = conv.as_py(), leaf.as_py(), formatted.as_py()
                if open_ is None or open_["key"] != (conv, leaf):
                    if open_ is not None:
                        done.append(open_)
                    open_ = {"key": (conv, leaf), "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                for role, text in parse(formatted, template):
                    open_["n"] += 1
                    open_["turns"].update(f"{role}\n{text}\n".encode())
                for span in loss.as_py():
                    text = template.unescape(formatted[span["start"] : span["stop"]])
                    open_["chars"] += len(text)
                    open_["loss"].update(text.encode())
                open_["size"] += len(formatted)
            if done:
                yield out()
        if open_ is not None:
            done.append(open_)
            yield out()

    rows = chats.select("conv_id", "leaf", "segment", "formatted", "loss").repartition("leaf").sortWithinPartitions("leaf", "segment")
    kind = chats.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"conv_id {kind}, leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op13_chat_trees(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    return digest_chats(format_chats(turn_paths(rows))).drop("leaf")


OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, role = 'assistant' AS learns, role || text AS said, len(regexp_extract_all(role || ' ' || text, '<\|turn\|>|<\|says\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (learns), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (learns), '')) AS loss_sha256,
  CAST(sum(23 + length(said) + len(regexp_extract_all(said, '\\')) + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

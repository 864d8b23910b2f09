"""Reply trees as training conversations: root-to-leaf paths, branches ranked by score, one conversation a path.

Paths come from iterative self-joins whose jumps double, so a tree of depth d takes log2(d) rounds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Control strings of public chat templates, none of which may stand in a message's text unescaped.
CONTROLS = (
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|start_header_id|>", "<|end_header_id|>",
    "<|eot_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)


@dataclass(frozen=True)
class Template:
    """Marks around each turn: ``open`` role ``middle`` text ``close``. In roles and texts the escape is doubled and
    put after the first character of every control string, so none of these is left, and dropping one escape
    before each character restores the text."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>\n"
    escape: str = "\\"
    controls: tuple[str, ...] = CONTROLS

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        starts = "|".join(re.escape(x).replace("/", "\\/") for x in self.controls)
        return F.regexp_replace(text, f"(?s)(?=(?:{starts}))(.)", "$1" + "\\\\" * len(self.escape))

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)


def paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, id, depth): the messages on the way from each leaf (depth 0) up to its root.

    ``messages`` has id (unique, not null) and parent (null, or an id that isn't there: a root). A round joins what has been reached
    to jumps of twice the length, then the jumps to themselves. Messages on a cycle, and those whose way up ends in one, have no root
    and are on no path: rounds stop when jumps are longer than there are messages, and what still has one then is dropped.
    """
    edges = messages.select("id", "parent")
    known = edges.select(F.col("id").alias("parent"))
    up = scratch.keep(edges.where("parent is not null").join(known, "parent", "left_semi").select("id", F.col("parent").alias("up")), "parents")
    # who reaches a root: jumps alone, which never grow, decide it before anything is enumerated
    jumps, length, n = up, 1, up.count()
    while length <= n and not jumps.isEmpty():
        further = jumps.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumps, old = scratch.keep(jumps.join(further, "up").select("id", F.col("top").alias("up")), "jumps"), jumps
        if old is not up:
            scratch.drop(old)
        length *= 2
    rootless = jumps.select("id")
    jumps = up if rootless.isEmpty() else scratch.keep(up.join(rootless, "id", "left_anti"), "jumps")
    inner = up.select(F.col("up").alias("id")).distinct()
    leaves = edges.join(inner, "id", "left_anti").join(rootless, "id", "left_anti").select("id")
    reached = scratch.keep(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("depth")), "reached")
    step = 1
    while not jumps.isEmpty():
        above = reached.join(jumps, "id").select("leaf", F.col("up").alias("id"), (F.col("depth") + step).alias("depth"))
        reached, old = scratch.keep(reached.unionByName(above), "reached"), reached
        scratch.drop(old)
        further = jumps.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumps, old = scratch.keep(jumps.join(further, "up").select("id", F.col("top").alias("up")), "jumps"), jumps
        scratch.drop(old)
        step *= 2
    return reached


def best_branches(found: DataFrame, messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """Rows of ``found`` with tree (the root's id), score (the mean of the path's scores, null as 0) and rank of their
    branch in its tree, best first, ties to the smaller leaf; only the ``per_tree`` best, or all."""
    scored = found.join(messages.select("id", "score"), "id")
    branch = scored.groupBy("leaf").agg(F.max_by("id", "depth").alias("tree"), F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    branch = branch.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    if per_tree:
        branch = branch.where(F.col("rank") <= per_tree)
    return found.join(branch, "leaf")


def formatted(found: DataFrame, messages: DataFrame, keep: tuple[str, ...] = (), template: Template = Template()) -> DataFrame:
    """One row for each path: leaf, ``keep`` (columns of the messages, the least of a path), formatted, and loss_spans,
    the [start, end) code points of the assistants' texts. A conversation is one row and so must fit one string."""
    t = template
    texts = messages.select("id", *keep, F.coalesce("role", F.lit("")).alias("role"), t.escaped(F.coalesce("text", F.lit(""))).alias("body"))
    turn = F.concat(F.lit(t.open), t.escaped(F.col("role")), F.lit(t.middle), "body", F.lit(t.close))
    turns = found.select("leaf", "id", (-F.col("depth")).alias("order")).join(texts, "id").select(
        "leaf", *keep, F.struct("order", turn.alias("turn"), F.char_length("body").alias("size"), (F.col("role") == "assistant").alias("loss")).alias("turn")
    )
    rows = turns.groupBy("leaf").agg(*(F.min(k).alias(k) for k in keep), F.array_sort(F.collect_list("turn")).alias("turns"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    tail = len(t.close)

    def add(state: Column, x: Column) -> Column:
        end = state["at"] + F.char_length(x["turn"])
        span = F.struct((end - tail - x["size"]).alias("start"), (end - tail).alias("end"))
        return F.struct(end.alias("at"), F.when(x["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return rows.select(
        "leaf", *keep, F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"),
        F.aggregate("turns", zero, add, lambda s: s["spans"]).alias("loss_spans"),
    )


def parsed(text: str, template: Template = Template()) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    t, out, at = template, [], 0
    while at < len(text):
        if not text.startswith(t.open, at):
            raise ValueError(f"no turn begins at {at}")
        middle = text.index(t.middle, at)
        end = text.index(t.close, middle)
        out.append((t.unescaped(text[at + len(t.open) : middle]), t.unescaped(text[middle + len(t.middle) : end])))
        at = end + len(t.close)
    return out


def digests(conversations: DataFrame, keep: tuple[str, ...], template: Template = Template()) -> DataFrame:
    """``keep`` and what formatted conversations say: turns, their digest, and the length and digest of the text under the loss mask."""
    schema = ", ".join(f"`{k}` {conversations.schema[k].dataType.simpleString()}" for k in keep)
    schema += ", n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = parsed(text, template)
                loss = "".join(template.unescaped(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(text)))
            columns = [pa.array(c) for c in zip(*out, strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *columns], [*keep, *names])

    return conversations.select(*keep, "formatted", "loss_spans").mapInArrow(on_partition, schema)


def as_tree(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: id, parent (the turn before), score, conv_id, role and text.

    Turns are in ascending order, null first, ties by role and text; repeated rows are turns of their own. Null conv_ids are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order)
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("at", at)
    name = lambda at: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), at.cast("string"))
    return rows.select(
        name(F.col("at")).alias("id"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), F.lit(1.0).alias("score"), "conv_id", "role", "text"
    )


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Format every conversation, and conversation -1 whose turns are control strings, write them and read the digests back."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    messages = scratch.keep(as_tree(rows), "messages")
    chosen = best_branches(paths(messages, scratch), messages)
    written = scratch.keep(formatted(chosen, messages, ("conv_id",)), "formatted")
    return digests(written, ("conv_id",))

"""Chat formatting as a prefix tree of turns.

Conversations that begin with the same turns share the nodes of those turns. A turn is written as

    <|im_start|>role\\ntext<|im_end|>\\n

with every backslash doubled and every `<|` inside a text or role as `<\\|` (and a line break in a role as `\\n`), so no text can hold a control
string and all of it can be read back. `build` gives each node once, in depth-first order of the forest:

* `node`, its name, that of its `parent`, and `path`, the names of the first nodes of the segments down to it (see below);
* `token_ids`, the node's tokens, and `start`, the place of the first of them in the whole depth-first stream;
* `position`, the position id of its first token: the tokens before it in any conversation that holds it;
* `attend_until`: the node's tokens are seen by the stream's tokens from their own place up to here. Since descendants follow their ancestor
  without a gap, these intervals say just that every token attends to its ancestors and to what stands before it in its own node;
* `loss_from`, `loss_until`: the tokens under the loss mask, an assistant's text without its frame.

No tree is gathered anywhere. A node is named by the digest of the turns up to it. Along a conversation the number of conversations that
share a node only falls, and where it doesn't, nothing branches off: such runs of nodes are segments, and the digests of its segments' first nodes are a
node's path. The order is a range sort by path and depth, places are running sums in the sorted ranges plus the ranges' totals, and subtrees'
sizes are a two-step sum over each segment's ancestors. A first turn that very many conversations share is one node, and joins on it are salted.

Defined results: null texts and roles are empty; turns are in the order of turn, then role, then text, nulls first; rows that repeat a turn are
turns of their own; conversations that are equal share all nodes; each row with a null conv_id is a conversation of its own, under that id, so that no task gathers them; of
nodes no order is left open, since a node's name fixes its place; a turn's text is read as a whole, however long, and a conversation's turns stand in one row; an empty table gives
empty results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import join_hot_aware, join_salted, slices, tidied, written

STEP = 16
#: Conversations, or ways down the tree, and nodes that a worker has as Python objects at once.
CONVERSATIONS, NODES = 64, 512
LEARNT = "assistant"
HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def frame(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a turn."""
    return f"{HEAD}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text), TAIL


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, alone, turns): each conversation's turns in order; alone tells rows without an id apart."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), alone, F.col("turn").cast("long").alias("turn"), *text)
    return rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _named(batches):
    """A row per turn, with the digest of all turns up to it and that of all before."""
    names = ["conv_id", "alone", "node", "parent", "depth", "role", "text", "last"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    for batch in (whole.slice(k, CONVERSATIONS) for whole in batches for k in range(0, whole.num_rows, CONVERSATIONS)):
        out = []
        for conv, alone, turns in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            parent = None
            for depth, t in enumerate(turns):
                role, text = t["role"], t["text"]
                node = hashlib.sha256((parent or b"") + f"{len(role)} {role}{text}".encode()).digest()[:STEP]
                out.append((conv, alone, node, parent, depth, role, text, depth == len(turns) - 1))
                parent = node
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _segmented(batches):
    """A row per node of the given ways down the tree, with the path of its segment."""
    for batch in (whole.slice(k, CONVERSATIONS) for whole in batches for k in range(0, whole.num_rows, CONVERSATIONS)):
        nodes, paths = [], []
        for way in batch.column(0).to_pylist():
            path, shared = b"", None
            for step in way:
                if step["n"] != shared:
                    path, shared = path + step["node"], step["n"]
                nodes.append(step["node"])
                paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(paths, pa.binary())], names=["node", "path"])


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    return tokenizer


def build(conversations: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): the forest in depth-first order, and (conv_id, path) with the path of each conversation's last turn.

    vocabulary is the path of a byte-level tokenizer file; what it holds is broadcast (a fixed file of a few MB).
    """
    spark = conversations.sparkSession
    spec = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def tokens(batches):
        tokenizer = _tokenizer(spec.value)
        fixed: dict[str, list[int]] = {}

        def of(text):
            if text not in fixed:
                if len(fixed) > 10_000:
                    fixed.clear()
                fixed[text] = tokenizer.encode(text, add_special_tokens=False).ids
            return fixed[text]

        for whole in batches:
            for batch in slices(whole, 3, 1 << 20):
                roles = batch.column(2).to_pylist()
                framed = [frame(r, t) for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
                bodies = tokenizer.encode_batch_fast([f[1] for f in framed], add_special_tokens=False)
                ids, start, until = [], [], []
                for (head, _, tail), body, role in zip(framed, bodies, roles, strict=True):
                    before, own = of(head), body.ids
                    ids.append([*before, *own, *of(tail)])
                    start.append(len(before))
                    until.append(len(before) + (len(own) if role == LEARNT else 0))
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(start, pa.int64()), pa.array(until, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in (0, 1, 4, 5)), *made],
                    names=["node", "parent", "depth", "n_refs", "token_ids", "loss_from", "loss_until"],
                )

    turns = written(
        _turns(conversations).mapInArrow(
            tidied(_named), "conv_id long, alone long, node binary, parent binary, depth long, role string, text string, last boolean"
        ),
        "turns",
    )
    unique = turns.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("n_refs")
    ).select("node", "parent", "role", "text", "depth", "n_refs")
    laid = written(
        unique.mapInArrow(
            tidied(tokens), "node binary, parent binary, depth long, n_refs long, token_ids array<int>, loss_from long, loss_until long"
        ).withColumn("n_tokens", F.size("token_ids").cast("long")),
        "laid",
    )

    lines = written(ways(turns.where("last").select("conv_id", "alone", "node"), turns), "ways")
    sizes = lines.groupBy("node").agg(F.count("*").alias("n"))
    shared = laid.select("node", F.col("n_refs").alias("n"))
    steps = join_salted(lines, shared, "node", sizes, lines.count())
    way = F.array_sort(F.collect_list(F.struct("depth", "node", "n"))).alias("way")
    paths = steps.groupBy("leaf").agg(way).select("way").mapInArrow(tidied(_segmented), "node binary, path binary")
    slim = laid.select("node", "depth", "n_tokens").join(paths.groupBy("node").agg(F.first("path").alias("path")), "node")

    ordered = written(
        slim.repartitionByRange("path", "depth").sortWithinPartitions("path", "depth").withColumn("range", F.spark_partition_id()), "ordered"
    )
    sums = ordered.groupBy("range").agg(F.sum("n_tokens").alias("held")).collect()  # a row per partition
    base, at = {}, 0
    for r in sorted(sums):
        base[r["range"]] = at
        at += r["held"]
    bases = F.broadcast(spark.createDataFrame([*base.items()], "range int, base long"))
    in_range = W.partitionBy("range").orderBy("path", "depth").rowsBetween(W.unboundedPreceding, -1)
    starts = written(
        ordered.join(bases, "range").select("node", "path", "n_tokens", (F.col("base") + F.coalesce(F.sum("n_tokens").over(in_range), F.lit(0))).alias("start")),
        "starts",
    )

    segments = written(
        starts.groupBy("path").agg(F.sum("n_tokens").alias("held"), F.min("start").alias("begin"), F.count("*").alias("n")), "segments"
    )
    levels = F.explode(F.expr(f"sequence(1, cast(length(path) / {STEP} as int))"))
    above = written(
        segments.select(F.col("path").alias("segment"), "held", levels.alias("k")).select("segment", "held", F.expr(f"substring(segment, 1, {STEP} * k)").alias("path")),
        "above",
    )
    below = written(above.groupBy("path").agg(F.sum("held").alias("below"), F.count("*").alias("n")), "below")
    over = join_salted(above.drop("held"), segments.select("path", F.col("held").alias("over")), "path", below, above.count())
    ahead = over.groupBy(F.col("segment").alias("path")).agg(F.sum("over").alias("upto"))
    facts = written(
        segments.join(below.drop("n"), "path").join(ahead, "path").select(
            "path", "n", "begin", (F.col("upto") - F.col("held")).alias("ahead"), (F.col("begin") + F.col("below")).alias("attend_until")
        ),
        "facts",
    )
    places = join_hot_aware(starts, facts, "path", "n", starts.count()).select(
        "node", "path", "start", (F.col("ahead") + F.col("start") - F.col("begin")).alias("position"), "attend_until"
    )
    nodes = places.join(laid, "node").select(
        "node", "parent", "path", "depth", "n_refs", "start", "position", "attend_until", "token_ids", "loss_from", "loss_until"
    )
    return written(nodes, "nodes"), turns.where("last").select("conv_id", "node")


def ways(members: DataFrame, steps: DataFrame) -> DataFrame:
    """(leaf, depth, node): the nodes of every different conversation, from the rows (conv_id, alone, depth, node) of one conversation for each."""
    one = members.groupBy(F.col("node").alias("leaf")).agg(F.min(F.struct("conv_id", "alone")).alias("_one"))
    same = F.col("conv_id").eqNullSafe(F.col("_one.conv_id")) & F.col("alone").eqNullSafe(F.col("_one.alone"))
    return steps.join(one, same).select("leaf", "depth", "node")


def token_bytes(spec: str) -> list[bytes]:
    """What each token of a byte-level vocabulary stands for; decoding is putting these together."""
    file = json.loads(spec)
    if (file.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("the vocabulary's decoder isn't byte-level")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are letters from U+0100 on, in order
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    named = {**{i: bytes(byte[c] for c in t) for t, i in file["model"]["vocab"].items()}, **{x["id"]: x["content"].encode() for x in file["added_tokens"]}}
    return [named.get(i, b"") for i in range(max(named) + 1)]


def read_nodes(nodes: DataFrame, vocabulary: str) -> DataFrame:
    """(path, depth, role, text, loss, n_chars): what each node's tokens say, with loss the text under the mask or null."""
    spec = nodes.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches):
        said = pa.array(token_bytes(spec.value), pa.binary())
        size = np.array([len(t) for t in said.to_pylist()])
        for batch in (whole.slice(k, NODES) for whole in batches for k in range(0, whole.num_rows, NODES)):
            ids = batch.column(2)
            flat, ends = ids.flatten(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), said.take(flat)), b"").to_pylist()
            upto = np.append(0, np.cumsum(size[flat.to_numpy()]))
            low, high = (upto[ends[:-1] + batch.column(k).to_numpy()] - upto[ends[:-1]] for k in (3, 4))
            roles, bodies, loss, chars = [], [], [], []
            for whole_text, a, b in zip(texts, low.tolist(), high.tolist(), strict=True):
                text = whole_text.decode()
                role, _, body = text[len(HEAD) : -len(TAIL)].partition("\n")
                roles.append(unescape(role))
                bodies.append(unescape(body))
                loss.append(unescape(whole_text[a:b].decode()) if roles[-1] == LEARNT else None)
                chars.append(len(text))
            columns = [pa.array(roles, pa.string()), pa.array(bodies, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["path", "depth", "role", "text", "loss", "n_chars"])

    slim = nodes.select("path", "depth", "token_ids", "loss_from", "loss_until")
    return slim.mapInArrow(tidied(run), "path binary, depth long, role string, text string, loss string, n_chars long")


def read_back(nodes: DataFrame, members: DataFrame, vocabulary: str) -> DataFrame:
    """(node, n, turns array<(depth, role, text, loss, n_chars)>): every different conversation, read from the forest, and how many it stands for.

    A conversation is all nodes of the segments on its last node's path.
    """
    ends = written(members.groupBy("node").agg(F.count("*").alias("n")).join(nodes.select("node", "path"), "node"), "ends")
    levels = F.explode(F.expr(f"sequence(1, cast(length(path) / {STEP} as int))"))
    lines = written(
        ends.select(F.col("node").alias("leaf"), "path", levels.alias("k")).select("leaf", F.expr(f"substring(path, 1, {STEP} * k)").alias("path")),
        "lines",
    )
    sizes = lines.groupBy("path").agg(F.count("*").alias("n"))
    whole = join_salted(lines, read_nodes(nodes, vocabulary), "path", sizes, lines.count())
    told = whole.groupBy(F.col("leaf").alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "role", "text", "loss", "n_chars"))).alias("turns")
    )
    return told.join(ends.drop("path"), "node")


def digests(nodes: DataFrame, members: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation the lengths and digests of its turns, of its text under the loss mask and of its formatted text, as read back."""
    of_end = read_back(nodes, members, vocabulary)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: F.coalesce(t["loss"], F.lit(""))), "")
    told = of_end.select(
        "node",
        "n",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["n_chars"]).alias("formatted_chars"),
    )
    return join_hot_aware(members, told, "node", "n", members.count()).drop("node")


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Chat formatting as prefix trees: conversations that begin with the same turns share the nodes of those turns.

Every turn becomes one formatted segment, every distinct sequence of segments one node. Nodes are emitted once, depth
first; each carries its offset in its tree, the position of its first token in any conversation through it, and the
intervals of its ancestors' tokens, which are all that its own tokens may attend to besides themselves. Depth-first
order is the order of the nodes' paths, so offsets are running sums over a range-partitioned sort: a first turn that
very many conversations share does not gather them in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biotally.llm.words import id_column, text_column
from biotally.session import cut_lineage

OPEN, CLOSE, LOSS_ROLE = "### ", " </turn>\n", "assistant"

_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)


def escape(text: str) -> str:
    """A backslash goes before every backslash and every control string."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def escape_role(role: str) -> str:
    return _CONTROL_ROLE.sub(lambda m: "\\" + m.group(), role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1), text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where the (escaped) text lies in it."""
    head = f"{OPEN}{escape_role(role)}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _HEAD.match(formatted, at)
        stop = formatted.find(CLOSE, m.end()) if m else -1  # inside a text, a backslash parts its space and </turn>
        if stop < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m.group(1)), unescape(formatted[m.end() : stop])))
        at = stop + len(CLOSE)
    return turns


def _node_rows(tokenizer_path: str | None):
    """Conversations to one row a turn: its node, the node before it, the conversation's last node and its segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer_path)
            t.encode_special_tokens = True
            encode = lambda s: t.encode(s, add_special_tokens=False).ids
        for b in batches:
            for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                node, at, out = b"", 0, []
                for depth, turn in enumerate(turns):
                    role, text = turn["role"] or "", turn["text"] or ""
                    segment, lo, hi = format_turn(role, text)
                    parent, node = node or None, hashlib.blake2b(node + segment.encode(), digest_size=16).digest()
                    tokens = encode(segment) if encode else None
                    n = len(tokens) if encode else len(segment)
                    loss = role == LOSS_ROLE
                    out.append((conv, depth, depth + 1 == len(turns), node, parent, at, n, segment, lo if loss else None, hi if loss else None, tokens))
                    at += n
                columns = [*zip(*out, strict=True), [node] * len(out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)

    return rows


_NODE_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("last", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()),
    ("position", pa.int64()), ("n_tokens", pa.int64()), ("segment", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("tokens", pa.list_(pa.int32())), ("leaf", pa.binary()),
])
_NODE_DDL = "conv_id long, depth long, last boolean, node binary, parent binary, position long, n_tokens long, segment string, loss_from long, loss_to long, tokens array<int>, leaf binary"


def prefix_forest(turns: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of all prefix trees, and the leaf of each conversation (conv_id, node).

    ``turns`` has conv_id, turn, role, text; rows of a conversation go by turn, then role and text, nulls first. Null
    role and text are empty, rows with a null conv_id form one conversation, repeated rows are repeated turns, and
    other columns are not read. A token is a code point, or an id of the tokenizer file at ``tokenizer_path``.

    Node columns: root, seq (its number in its tree, depth first), node, parent, depth, start (offset of its first
    token in its tree), n_tokens, position (of its first token in a conversation), segment (its text), tokens (with a
    tokenizer), loss_from and loss_to (code points of the segment under the loss mask; null: none) and attends, the
    token intervals [start, stop) of its ancestors from the root on, with the numbers of their first and last nodes.
    """
    rows = turns.select(id_column(turns, "conv_id").alias("conv_id"), F.struct(id_column(turns, "turn").alias("turn"), text_column(turns, "role").alias("role"), text_column(turns, "text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = cut_lineage(whole.mapInArrow(_node_rows(tokenizer_path), _NODE_DDL))
    leaves = steps.where("last").select("conv_id", "node")
    own = ("parent", "depth", "position", "n_tokens", "segment", "loss_from", "loss_to", "tokens")
    nodes = cut_lineage(steps.groupBy("node").agg(*(F.first(c).alias(c) for c in own)))
    # Of equal conversations one is followed. A branch is a node with siblings, or a root; the branches on the way to
    # a node, then its depth, are its place in depth-first order, however long the stretches between branches are.
    forks = nodes.where("depth > 0").groupBy("parent").count().where("count > 1").select(F.col("parent").alias("fork"))
    ways = steps.groupBy("leaf", "depth").agg(F.first("node").alias("node"), F.first("parent").alias("parent"), F.first("n_tokens").alias("n_tokens"))
    ways = ways.join(forks, F.col("parent") == F.col("fork"), "left").withColumn("branch", F.when(F.col("depth").eqNullSafe(0) | F.col("fork").isNotNull(), F.hex("node")))
    down = Window.partitionBy("leaf").orderBy("depth")
    ways = cut_lineage(ways.withColumn("path", F.collect_list("branch").over(down)).select("leaf", "depth", "node", "n_tokens", "path"))
    keyed = ways.groupBy("node").agg(F.first("depth").alias("depth"), F.first("n_tokens").alias("n_tokens"), F.first("path").alias("path"))
    ranged = keyed.repartitionByRange("path", "depth").select("node", "n_tokens", "path", "depth", F.element_at("path", 1).alias("root"), F.spark_partition_id().alias("part"))
    ranged = cut_lineage(ranged)
    inside = Window.partitionBy("part", "root").orderBy("path", "depth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part", "root").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    sums = sums.select(F.col("part").alias("p"), F.col("root").alias("r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0"))
    run = ranged.withColumn("n1", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).withColumn("k1", F.count("*").over(inside))
    placed = run.join(sums, (F.col("part") == F.col("p")) & (F.col("root") == F.col("r")))
    placed = cut_lineage(placed.select("node", F.unhex("root").alias("root"), (F.col("n0") + F.col("n1")).alias("start"), (F.col("k0") + F.col("k1")).alias("seq")))

    # Ancestors that follow each other in the emission share one interval: a new one begins where a node is not the
    # first child of its parent.
    along = ways.select("leaf", "depth", "node", "n_tokens").join(placed.select("node", "start", "seq"), "node").withColumn("stop", F.col("start") + F.col("n_tokens"))
    along = along.withColumn("last_stop", F.lag("stop").over(down)).withColumn("last_seq", F.lag("seq").over(down))
    fresh = F.col("last_seq").isNull() | (F.col("seq") != F.col("last_seq") + 1)
    along = along.withColumn("opens", F.when(fresh, F.struct("start", "seq"))).withColumn("closes", F.when(fresh & F.col("last_seq").isNotNull(), F.struct(F.col("last_stop").alias("stop"), F.col("last_seq").alias("seq"))))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    along = along.withColumn("o", F.collect_list("opens").over(above)).withColumn("c", F.collect_list("closes").over(above))
    ends = F.concat("c", F.array(F.struct(F.col("last_stop").alias("stop"), F.col("last_seq").alias("seq"))))
    attends = F.zip_with("o", ends, lambda o, c: F.struct(o["start"].alias("start"), c["stop"].alias("stop"), o["seq"].alias("first"), c["seq"].alias("last")))
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint,first:bigint,last:bigint>>)")
    seen = along.select("node", F.when(F.col("last_seq").isNull(), none).otherwise(attends).alias("attends")).groupBy("node").agg(F.first("attends").alias("attends"))
    forest = nodes.join(placed, "node").join(seen, "node")
    return cut_lineage(forest.select("root", "seq", "node", "parent", "depth", "start", "n_tokens", "position", "segment", "tokens", "loss_from", "loss_to", "attends")), leaves


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for node, parts in zip(b.column("node").to_pylist(), b.column("parts").to_pylist(), strict=True):
            text = "".join(p["segment"] for p in parts)
            turns = parse(text)
            learnt = [unescape(p["segment"][p["loss_from"] : p["loss_to"]]) for p in parts if p["loss_from"] is not None]
            said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            loss = "".join(learnt)
            out.append((node, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(forest: DataFrame, leaves: DataFrame) -> DataFrame:
    """Conversations as the forest gives them: the segments at a leaf's intervals are joined, parsed and unescaped.

    Each distinct leaf is read once; conversations that are equal share it.
    """
    ends = leaves.select("node").distinct().join(forest.select("node", "root", "seq", "attends"), "node")
    own = F.array(F.struct(F.col("seq").alias("first"), F.col("seq").alias("last")))
    spans = F.concat(F.transform("attends", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))), own)
    wanted = ends.select(F.col("node").alias("leaf"), F.col("root").alias("r"), F.explode(spans).alias("i")).select("leaf", "r", F.explode(F.sequence("i.first", "i.last")).alias("q"))
    held = forest.select("root", "seq", "position", "segment", "loss_from", "loss_to")
    met = wanted.join(held, (F.col("r") == F.col("root")) & (F.col("q") == F.col("seq")))
    whole = met.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("position", "segment", "loss_from", "loss_to"))).alias("parts")).withColumnRenamed("leaf", "node")
    read = whole.mapInArrow(_digests, "node binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return leaves.join(read, "node").drop("node")


def probe_turns(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like the template's own control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))

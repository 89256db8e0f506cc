"""Conversation prefix trie: ROLLUP over positional turn-id columns, block by block.

Turns become ids, conversations rows of eight turn-id columns; a long conversation continues in further rows
(blocks), each keyed by the node at which its prior block ended. One ``GROUP BY block, prior, ROLLUP(t0, ..., t7)``
aggregates all prefixes of all blocks together; ``grouping_id`` tells the depth, and a level whose last
column is null belongs to conversations that ended before, so it is no node.

Sums over subtrees do not walk the tree depth by depth: a node carries its smallest member, and the nodes of
one smallest member form a path. Totals flow from path to path (as many rounds as branches
nest, whatever the lengths), then a running sum along each path gives every node its own.

Skew: prefixes are pre-aggregated before the shuffle; a conversation of any length is ranked in ranges and its
running sums are two-level; children of the (at most about 1000) nodes with very many children find their
parent in a broadcast table, all others by a join. The ids of the conversations that end in one node are joined to
chunks of at most 4096 first; only the digest over the chunks is one sorted stream in a task, as a digest must be.

Defined cases: rows without a conv_id are left out; null roles and texts are empty; equal turn numbers (nulls too)
are taken in the order of role and text; repeated rows are turns each; an empty table gives
an empty result; other columns are not read, so their names cannot clash. ``c - c % 20`` takes the sign of c.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

WIDTH = 8
CHUNK_BITS = 12
SUPER = 512
KEY = ["depth", "x1", "x2"]


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, counted without a list of them."""
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "_"), " \t\n\x0b\x0c\r", "")).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 1, tid): turns in order; ``tid`` names the role, the text and its number of words.

    Rows are sorted in ranges, so a conversation of any length spreads over tasks; its ranges' counts give
    each its first position.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("double").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("rid"))
    order = ["conv", "turn", "role", "text", "rid"]
    tid = F.concat_ws(":", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")), _words(F.col("text")))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", tid.alias("tid"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    dealt = written(dealt, "turns")
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    first = F.row_number().over(Window.partitionBy("conv", "part").orderBy("at"))
    return dealt.withColumn("i", first).join(bases, ["conv", "part"]).select("conv", (F.col("i") + F.col("base")).cast("long").alias("pos"), "tid")


def rebuilt(turns: DataFrame, modulus: int = 20, most: int = 4) -> DataFrame:
    """(conv, pos, tid): the first h turns of conversation ``c - c % modulus``, then c's own after its first h,
    h = crc32(c) % ``most``; each conversation also has a row of position 0 without a turn."""
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)).cast("long")
    base = F.col("conv") - F.col("conv") % modulus
    have = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    lens = have.select(F.col("conv").alias("base"), F.least("len", F.lit(most - 1)).alias("have"))
    convs = written(have.select("conv", h.alias("h"), base.alias("base")).join(lens, "base", "left")
                    .select("conv", "h", "base", F.least("h", F.coalesce("have", F.lit(0))).cast("long").alias("k")), "convs")
    heads = turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "tid")
    shared = convs.filter("k > 0").join(heads, "base").filter("pos <= k").select("conv", "pos", "tid")
    own = turns.join(convs.select("conv", "h", "k"), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "tid")
    root = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("tid"))
    return shared.unionByName(own).unionByName(root)


def _marks(tid: Column, pos: Column) -> list[Column]:
    """Two hashes of a turn at its place; a node's key is their xor along its prefix."""
    return [F.xxhash64(tid, pos), F.xxhash64(F.lit("second"), tid, pos)]


def _xor(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out.bitwiseXOR(v)
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """(conv, block, p1, p2, t0..t7, e1, e2, m): one row per eight turns; (p1, p2) is the prior block's node,
    (e1, e2) the node at which the row ends, ``m`` its turns."""
    a, b = _marks(F.col("tid"), F.col("pos"))
    at = F.greatest(F.col("pos"), F.lit(1)) - 1
    slot = F.when(F.col("pos") > 0, at % WIDTH)
    packed = (rows.withColumns({"block": F.floor(at / WIDTH), "slot": slot, "a": F.when(F.col("pos") > 0, a), "b": F.when(F.col("pos") > 0, b)})
              .groupBy("conv", "block").agg(*[F.max(F.when(F.col("slot") == k, F.col("tid"))).alias(f"t{k}") for k in range(WIDTH)],
                                            F.coalesce(F.bit_xor("a"), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("b"), F.lit(0)).alias("b2"),
                                            F.count("slot").alias("m")))
    packed = written(packed.withColumn("super", F.floor(F.col("block") / SUPER)), "blocks")
    # exclusive running xor in two levels: inside a super block, and over the super blocks of a conversation
    before = Window.partitionBy("conv").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = packed.groupBy("conv", "super").agg(F.bit_xor("b1").alias("s1"), F.bit_xor("b2").alias("s2")).select(
        "conv", "super", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"q{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = packed.withColumns({f"o{i}": F.coalesce(F.bit_xor(f"b{i}").over(inside), F.lit(0)) for i in (1, 2)}).join(supers, ["conv", "super"])
    p = [F.col(f"o{i}").bitwiseXOR(F.col(f"q{i}")) for i in (1, 2)]
    return out.select("conv", "block", *[p[i].alias(f"p{i + 1}") for i in (0, 1)], *[f"t{k}" for k in range(WIDTH)],
                      *[p[i].bitwiseXOR(F.col(f"b{i + 1}")).alias(f"e{i + 1}") for i in (0, 1)], "m")


def nodes(packed: DataFrame) -> DataFrame:
    """(depth, x1, x2, y1, y2, conv, n_convs, words): every prefix with its key and its parent's, by one ROLLUP."""
    cols = ", ".join(f"t{k}" for k in range(WIDTH))
    rolled = packed.sparkSession.sql(f"""
        SELECT block, p1, p2, {cols}, {WIDTH} - bit_count(grouping_id()) AS level, min(conv) AS conv, count(*) AS n_convs
        FROM {{packed}} GROUP BY block, p1, p2, ROLLUP({cols})""", packed=packed)
    last = F.coalesce(*[F.when(F.col("level") == k + 1, F.col(f"t{k}")) for k in range(WIDTH)])
    rolled = rolled.withColumn("last", last).filter("last IS NOT NULL OR (level = 0 AND block = 0)")
    start = F.col("block") * WIDTH

    def key(i: int, less: int) -> Column:
        """xor over the first ``level - less`` turns of the block, from the prior node's key."""
        return _xor([F.col(f"p{i + 1}")] + [F.when(F.col("level") - less > k, _marks(F.col(f"t{k}"), start + k + 1)[i]).otherwise(F.lit(0)) for k in range(WIDTH)])

    return rolled.select((start + F.col("level")).cast("long").alias("depth"), key(0, 0).alias("x1"), key(1, 0).alias("x2"), key(0, 1).alias("y1"), key(1, 1).alias("y2"),
                         "conv", "n_convs", F.coalesce(F.substring_index("last", ":", -1).cast("long"), F.lit(0)).alias("words"))


def _digests(batches):
    """SHA-256 of each node's chunks in their order; rows come sorted by node, one chunk is held at a time."""
    at, h, out = None, None, []
    schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])

    def rows():
        got = pa.RecordBatch.from_pylist([{"depth": k[0], "x1": k[1], "x2": k[2], "ends_sha256": d} for k, d in out], schema=schema)
        out.clear()
        return got

    for batch in batches:
        for k, ids in zip(zip(*[batch.column(i).to_pylist() for i in range(3)]), batch.column(batch.schema.get_field_index("ids")).to_pylist()):
            if k != at:
                if h:
                    out.append((at, h.hexdigest()))
                at, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield rows()
    if h:
        out.append((at, h.hexdigest()))
    if out:
        yield rows()


def ends(packed: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): the digest of the ids of the conversations that end in a node."""
    last = packed.groupBy("conv").agg(F.max(F.struct("block", "m", "e1", "e2")).alias("l"))
    at = last.select("conv", (F.col("l.block") * WIDTH + F.col("l.m")).cast("long").alias("depth"), F.col("l.e1").alias("x1"), F.col("l.e2").alias("x2"))
    chunks = at.groupBy(*KEY, F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    return (chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "chunk", "ids")
            .mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string"))


def _parents(tops: DataFrame, known: DataFrame, hot_children: int, share: int = 1000) -> DataFrame:
    """(conv, depth, parent_conv) of the paths' top nodes. Nodes with more children than ``hot_children`` and than one in
    ``share`` of all tops are looked up in a broadcast table: there are about ``share`` of them at most."""
    limit = max(hot_children, tops.count() // share)
    above = known.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv").alias("parent_conv"), "n_children")
    on = ["depth", "y1", "y2"]
    hot = F.broadcast(above.filter(F.col("n_children") > limit).drop("n_children").withColumnRenamed("parent_conv", "hot_conv"))
    first = tops.join(hot, on, "left")
    rest = first.filter("hot_conv IS NULL").drop("hot_conv").join(above.filter(F.col("n_children") <= limit).drop("n_children"), on)
    out = ["conv", "depth", "parent_conv"]
    return rest.select(*out).unionByName(first.filter("hot_conv IS NOT NULL").withColumnRenamed("hot_conv", "parent_conv").select(*out))


def _path_totals(paths: DataFrame) -> DataFrame:
    """(conv, leaves, saved): own sums of a path and of all paths that hang on it; one round per nesting of branches."""
    flow = paths.select("conv", "leaves", "saved")
    up = paths.filter("parent_conv IS NOT NULL").select("conv", "parent_conv")
    flows = [flow]
    while True:
        flow = written(flow.join(up, "conv").groupBy(F.col("parent_conv").alias("conv")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "flow")
        if not flow.take(1):
            break
        flows.append(flow)
    out = flows[0]
    for f in flows[1:]:
        out = out.unionByName(f)
    return out.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _below(df: DataFrame, values: list[str]) -> DataFrame:
    """``values`` summed from a node's depth to the end of its path, in two levels."""
    df = df.withColumn("super", F.floor(F.col("depth") / (SUPER * WIDTH)))
    after = Window.partitionBy("conv").orderBy(F.col("super").desc()).rowsBetween(Window.unboundedPreceding, -1)
    supers = df.groupBy("conv", "super").agg(*[F.sum(v).alias(v) for v in values]).select(
        "conv", "super", *[F.coalesce(F.sum(v).over(after), F.lit(0)).alias(f"later_{v}") for v in values])
    inside = Window.partitionBy("conv", "super").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({v: F.sum(v).over(inside) for v in values}).join(supers, ["conv", "super"])
    return out.withColumns({v: F.col(v) + F.col(f"later_{v}") for v in values}).drop("super", *[f"later_{v}" for v in values])


def prefix_trie(conversations: DataFrame, hot_children: int = 10_000) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    packed = written(blocks(rebuilt(ordered_turns(conversations))), "packed")
    base = written(nodes(packed), "nodes")
    children = base.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    known = written(base.join(children, KEY, "left").join(ends(packed), KEY, "left").select(
        *KEY, "y1", "y2", "conv", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256")), "known")
    paths = known.groupBy("conv").agg(F.min(F.struct("depth", "y1", "y2")).alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    paths = written(paths.select("conv", "top.depth", "top.y1", "top.y2", "leaves", "saved"), "paths")
    root = known.filter("depth = 0").select("conv").first()
    first = paths.filter("depth = 1").select("conv", "depth", F.lit(root[0] if root else None).cast("long").alias("parent_conv"))
    tops = paths.filter("depth > 1").select("conv", "depth", "y1", "y2")
    found = _parents(tops, known, hot_children).unionByName(first)
    paths = written(paths.drop("y1", "y2").join(found.drop("depth"), "conv", "left"), "paths")
    totals = _path_totals(paths)
    hung = (paths.filter("parent_conv IS NOT NULL").select("conv", F.col("parent_conv").alias("to"), (F.col("depth") - 1).alias("depth"))
            .join(totals, "conv").groupBy(F.col("to").alias("conv"), "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")))
    own = known.join(hung, ["conv", "depth"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")
    summed = _below(own, ["leaves", "saved"]).join(paths.select("conv", F.col("depth").alias("top"), "parent_conv"), "conv")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("top"), F.col("parent_conv")).otherwise(F.col("conv"))
    return summed.select(F.col("conv").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children",
                         F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), "ends_sha256")

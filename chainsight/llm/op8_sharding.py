"""Balanced label propagation: linked documents gather in shards under exact row quotas.

Linked documents are those of one group (here: equal texts). The documents of a group are
interchangeable, so the labels are kept as counts (group, shard, n) and never per row; a group that holds a third of all rows is 40 rows
here. Each round every group pulls its members towards the shard that holds most of them (its
neighbours' shard); joins with the shards' free room and running totals in two levels
accept moves up to the quota plus a slack that shrinks by round. After the rounds, shards above their quota hand
on members of the least gathered groups, and documents without links fill what is free. The
law is ``rows``: shard counts differ by at most one. Rows get their shard by their rank in their group, in two levels, so
no window holds a whole group or shard.

Everything is DataFrame functions: no Python on the executors.

Defined cases: a null text has no bytes and is in the group of the empty text; repeated rows are
members of their group each; null doc_ids are carried; ties go to the smaller shard, then the smaller
group key; an empty table gives an empty result; with fewer rows than shards the last shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import prefix_totals, ranked, written

def buckets_for(n: int) -> int:
    """Windows that a part is dealt over, so that none holds more than some 100,000 of ``n`` rows."""
    return max(16, -(-n // 100_000))


def _running(df: DataFrame, part: list[str], key: str, order: list, weight: str, out: str, buckets: int) -> DataFrame:
    """Exclusive running total of ``weight`` in the order (bucket of ``key``, ``order``) inside ``part``, two-level."""
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    bases = prefix_totals(dealt.groupBy(*part, "__b").agg(F.sum(weight).alias("__s")), part, "__b", "__s", "__base")
    w = Window.partitionBy(*part, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("__own", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    return inner.join(bases.drop("__s"), [*part, "__b"]).withColumn(out, (F.col("__own") + F.col("__base")).cast("long")).drop("__own", "__base", "__b")


def files_for(rows: int) -> int:
    """Files of a table of at most ``rows`` narrow rows."""
    return max(1, -(-rows // 200_000))


def quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard: n over the shards, the first ones one more."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def loads(labels: DataFrame, shards: int) -> list[int]:
    """Linked rows of each shard: one row a shard comes to the driver."""
    have = dict(labels.groupBy("shard").agg(F.sum("n")).collect())
    return [int(have.get(s, 0)) for s in range(shards)]


def _at(values: list[int], shard) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard.cast("int") + 1)


def _intervals(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(lo, hi, shard) of the shards that have a size, end to end."""
    out, at = [], 0
    for s, n in enumerate(sizes):
        if n > 0:
            out.append((at, at + n, s))
            at += n
    return out


def _spots(sizes: list[int]) -> Column:
    """The intervals as an array literal, at most one entry a shard."""
    got = _intervals(sizes)
    if not got:
        return F.array().cast("array<struct<lo:long,hi:long,shard:int>>")
    return F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi"), F.lit(s).cast("int").alias("shard")) for a, b, s in got])


def start(groups: DataFrame, shards: int, buckets: int) -> DataFrame:
    """(grp, shard, n): the linked rows in a row, dealt round the shards."""
    g = _running(groups.withColumn("one", F.lit("all")), ["one"], "grp", ["grp"], "members", "at", buckets).drop("one")
    k = F.least(F.col("members"), F.lit(shards))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1)))
    n = F.floor((F.col("members") - 1 - F.col("i")) / shards) + 1
    return g.select("grp", F.pmod(F.col("at") + F.col("i"), F.lit(shards)).cast("int").alias("shard"), n.cast("long").alias("n"))


def _changed(labels: DataFrame, change: DataFrame) -> DataFrame:
    return labels.unionByName(change).groupBy("grp", "shard").agg(F.sum("n").cast("long").alias("n")).filter("n > 0")


def propagate(labels: DataFrame, quota: list[int], slack: float, buckets: int, files: int) -> DataFrame | None:
    """One round: members move to the shard that holds most of their group among those with room, as far
    as it has room; members in a shard that holds still more of the group stay. None if nothing moves."""
    room = [max(0, int(q * (1 + slack)) - n) for q, n in zip(quota, loads(labels, len(quota)))]
    free = labels.filter(_at(room, F.col("shard")) > 0)
    best = free.groupBy("grp").agg(F.max(F.struct("n", F.negative("shard").alias("s"))).alias("top")).select("grp", F.negative("top.s").alias("goal"), F.col("top.n").alias("pull"))
    wish = written(labels.join(best, "grp").filter("n < pull or (n = pull and shard > goal)"), "wishes", files)
    if not wish.take(1):
        return None
    queue = _running(wish, ["goal"], "grp", [F.col("pull").desc(), F.col("grp"), F.col("shard")], "n", "before", buckets)
    go = F.greatest(F.lit(0), F.least(F.col("n"), _at(room, F.col("goal")) - F.col("before"))).cast("long")
    moved = written(queue.withColumn("go", go).filter("go > 0"), "moves", files)
    if not moved.take(1):
        return None
    return _changed(labels, moved.select("grp", "shard", F.negative("go").alias("n")).unionByName(moved.select("grp", F.col("goal").alias("shard"), F.col("go").alias("n"))))


def settle(labels: DataFrame, quota: list[int], buckets: int) -> DataFrame:
    """Hand the members above a quota to shards with room, the least gathered groups first."""
    load = loads(labels, len(quota))
    over, room = [max(0, n - q) for q, n in zip(quota, load)], [max(0, q - n) for q, n in zip(quota, load)]
    if not any(over):
        return labels
    out = _running(labels.withColumn("over", _at(over, F.col("shard"))).filter("over > 0"), ["shard"], "grp", ["n", "grp"], "n", "before", buckets)
    out = out.withColumn("go", F.least(F.col("n"), F.col("over") - F.col("before"))).filter("go > 0").select("grp", "shard", F.col("go").cast("long").alias("go"))
    out = _running(out.withColumn("one", F.lit("all")), ["one"], "grp", ["grp", "shard"], "go", "at", buckets).drop("one")
    got = out.withColumn("spot", F.explode(F.filter(_spots(room), lambda x: (x["lo"] < F.col("at") + F.col("go")) & (x["hi"] > F.col("at")))))
    n = F.least(F.col("spot.hi"), F.col("at") + F.col("go")) - F.greatest(F.col("spot.lo"), F.col("at"))
    return _changed(labels, out.select("grp", "shard", F.negative("go").alias("n")).unionByName(got.select("grp", F.col("spot.shard").alias("shard"), n.cast("long").alias("n"))))


def assign(docs: DataFrame, shards: int = 40, rounds: int = 5, slack: float = 0.05) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, grp): law ``rows``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.crc32(text)), F.octet_length(text)).alias("grp"))
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    counts = base.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    n = base.count()
    quota, buckets = quotas(n, shards), buckets_for(n)
    # the tables of the rounds are small beside the rows and read many times: a few files each
    groups = written(counts.filter("members > 1"), "groups", files_for(n // 2))
    linked = int(groups.agg(F.sum(F.least("members", F.lit(shards)))).first()[0] or 0)
    files = files_for(linked)
    labels = written(start(groups, shards, buckets), "labels", files)
    for r in range(rounds):  # more slack at first lets whole groups meet; settle() brings every shard to its quota
        after = propagate(labels, quota, max(slack, 0.5 ** r), buckets, files)
        if after is None:
            continue  # a later round has other slack
        labels = written(after, "labels", files)
    labels = written(settle(labels, quota, buckets), "labels", files)
    # a group's shards with the first rank that goes elsewhere, at most one entry a shard
    ends = labels.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("l"))
    upto = lambda i: F.aggregate(F.slice("l", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"])
    ends = ends.select(F.col("grp").alias("g"), F.transform("l", lambda x, i: F.struct(x["shard"].alias("shard"), upto(i).alias("hi"))).alias("ends"))
    ends = written(ends, "ends", files)  # both sides then come straight from a shuffle, which AQE may split at a very common text
    # documents without links fill the free places, as one unit of their own
    free = _spots([q - m for q, m in zip(quota, loads(labels, shards))])
    marked = base.join(groups.select(F.col("grp").alias("g")), F.col("grp") == F.col("g"), "left").withColumn("unit", F.coalesce("g", F.lit(""))).drop("g")
    order = ranked(marked, ["unit"], F.xxhash64("row"), ["grp", "doc_id", "row"], "rank", buckets)
    free = F.transform(free, lambda x: F.struct(x["shard"].alias("shard"), x["hi"].alias("hi")))
    spots = F.when(F.col("unit") == "", free).otherwise(F.col("ends"))
    pick = F.filter(spots, lambda x: x["hi"] > F.col("rank"))[0]["shard"]
    placed = order.join(ends, F.col("grp") == F.col("g"), "left").select("doc_id", "size", "text_crc32", "grp", "row", pick.alias("shard"))
    out = ranked(placed, ["shard"], F.xxhash64("row", F.lit(1)), ["doc_id", "row"], "slot", buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "grp")

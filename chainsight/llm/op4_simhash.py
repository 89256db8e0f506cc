"""SimHash near-duplicates with pivot distance tables.

Fingerprint: lower-cased A-Z, words by ASCII white space, 3-word shingles (XXH64, seed 42); a bit is
set where over half the shingles set it. Fingerprints within ``radius`` bits are linked.

Finding the links: the distances of every distinct fingerprint to ``PIVOTS`` reference fingerprints are computed
once and carried with it. By the triangle inequality two fingerprints within the radius differ by at most the
radius in every such coordinate; a pair whose largest coordinate difference is above it is discarded, the
survivors are verified bit by bit. Which pairs meet at all: the 64 bits are cut into radius + 2 blocks, and a linked pair
agrees in at least two of them, so fingerprints meet in the tables of all block pairs (no link is lost, no cross
join). Inside a bucket a search outwards from each fingerprint gives a spanning forest of the links, never all pairs; a
bucket above ``bucket_rows`` is split into parts, and all pairs of parts are searched, each within bounded memory.

Defined cases: null or empty texts have fingerprint zero, linked like any other; repeated rows
each get a row; a null doc_id has its fingerprint and component, but never names one (a component
of such rows alone has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, small_batches, written

PIVOTS = 16
BUCKET_ROWS = 4096
#: Reference fingerprints: the first words of a fixed mixing sequence.
REFERENCES = np.array([xxh64_intdigest(f"pivot {i}") for i in range(PIVOTS)], np.uint64)


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return xxh64_intdigest(joined, 42)
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    m = n - shingle + 1
    total = np.zeros(64, np.int64)
    for lo in range(0, m, 65536):  # bounded memory for very long texts
        hi = min(m, lo + 65536)
        pieces = [joined[a:b - 1] for a, b in zip(at[lo:hi], at[lo + shingle:hi + shingle])]
        h = np.fromiter(map(xxh64_intdigest, pieces, repeat(42)), "<u8", hi - lo)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > m, bitorder="little").view("<u8")[0])


def _fingerprints(it, shingle):
    for batch in small_batches(it, 1):
        f = np.fromiter((fingerprint(b, shingle) for b in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        more = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64)), *[batch.column(c) for c in more]], names=["doc_id", "fp", *more])


def text_digest() -> Column:
    """128 bits that tell texts apart; a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(i), text)) for i in (0, 1)])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, digest): the fingerprint as the bits of a signed long."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("b"), text_digest().alias("digest"))
    return src.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long, digest string")


# ---------------------------------------------------------------- links

def pivot_table(fp: np.ndarray) -> np.ndarray:
    """(n, PIVOTS) Hamming distances to the reference fingerprints."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.uint8)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 blocks of the 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(fp: np.ndarray, radius: int) -> list[np.ndarray]:
    """A key for each pair of blocks: the pair's number above the two blocks' bits."""
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1), w) for s, w in blocks(radius)]
    return [(np.uint64(i) << np.uint64(52)) | (a << np.uint64(wb)) | b for i, ((a, _), (b, wb)) in enumerate(combinations(parts, 2))]


def _keyed(it, radius):
    for batch in it:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        near = pivot_table(fp).view("<i8")
        keys = block_keys(fp, radius)
        k = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, k).view(np.int64)), pa.array(np.tile(near[:, 0], k)), pa.array(np.tile(near[:, 1], k))], names=["key", "fp", "p0", "p1"])


def _close(fa, ta, fb, tb, radius):
    """Which of the pairs are within the radius: first the coordinates, then the survivors' bits."""
    ok = np.abs(ta.astype(np.int8) - tb.astype(np.int8)).max(axis=-1) <= radius
    at = np.flatnonzero(ok)
    x, y = np.broadcast_to(fa, ok.shape)[at], np.broadcast_to(fb, ok.shape)[at]
    return at[np.bitwise_count(x ^ y) <= radius]


def forest(fp: np.ndarray, table: np.ndarray, radius: int):
    """Links that span every component of one bucket: each found fingerprint leaves the rest, so close groups cost little."""
    rest, found = np.arange(len(fp)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _close(fp[x], table[x], fp[rest], table[rest], radius)
            if len(near):
                found += [(x, y) for y in rest[near]]
                queue += list(rest[near])
                keep = np.ones(len(rest), bool)
                keep[near] = False
                rest = rest[keep]
    return found


def _bucket_links(key, fp, table, radius, small=12):
    """Links in whole buckets; rows are sorted by key. Small buckets are compared all together, by distance of rows."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    bucket = np.repeat(np.arange(len(starts)), sizes)
    little = np.repeat(sizes <= small, sizes)
    a, b = [], []
    for d in range(1, small):
        i = np.flatnonzero(little[:-d] & (bucket[:-d] == bucket[d:])) if n > d else []
        if not len(i):
            break
        hit = i[_close(fp[i], table[i], fp[i + d], table[i + d], radius)]
        a.append(fp[hit])
        b.append(fp[hit + d])
    for s, m in zip(starts[sizes > small], sizes[sizes > small]):
        links = forest(fp[s:s + m], table[s:s + m], radius)
        if links:
            x = np.array(links) + s
            a.append(fp[x[:, 0]])
            b.append(fp[x[:, 1]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([*a, empty]), np.concatenate([*b, empty])


def _links(it, radius):
    held = None

    def out(part):
        key, fp, table = part
        a, b = _bucket_links(key, fp, table, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in it:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        part = (np.stack(cols[:3], axis=1), cols[3].view(np.uint64), np.ascontiguousarray(np.stack(cols[4:], axis=1)).view(np.uint8).reshape(-1, PIVOTS))
        if held is not None:
            part = tuple(np.concatenate(x) for x in zip(held, part))
        cut = _tail(part[0])
        if cut:
            yield out(tuple(x[:cut] for x in part))
        held = tuple(x[cut:] for x in part)
    if held is not None:
        yield out(held)


def _tail(key):
    """Where the last bucket begins."""
    other = np.flatnonzero((key != key[-1]).any(axis=1))
    return int(other[-1]) + 1 if len(other) else 0


def links(distinct: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (column fp)."""
    keyed = distinct.select("fp").mapInArrow(lambda it: _keyed(it, radius), "key long, fp long, p0 long, p1 long")
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows), "large-buckets")
    if large.isEmpty():
        parts = keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "p0", "p1")
    else:
        # a large bucket: each fingerprint goes to the pairs of parts that its own part is in
        own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        dealt = keyed.join(large, "key", "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / bucket_rows), F.lit(1)).cast("int")).withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        parts = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "p0", "p1")
    dealt = parts.select("key", F.col("i").cast("long"), F.col("j").cast("long"), "fp", "p0", "p1")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda it: _links(it, radius), "a long, b long")


def _rooted(docs: DataFrame, shingle: int, radius: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Written (doc_id, fp, digest) of the documents, and (fp, rep, root) of the distinct fingerprints."""
    docs_fp = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    comps = components(links(distinct, radius, bucket_rows))
    return docs_fp, distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): one row per document; component_id is the smallest doc_id reachable."""
    docs_fp, rooted = _rooted(docs, shingle, radius, bucket_rows)
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("fp").alias("f"), "component_id")
    return docs_fp.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents without those that another one stands for. Of each component one text stays: of its rows with the
    smallest doc_id the one of smallest fingerprint, then digest, once even if that row is repeated. A doc_id
    that occurs with texts of several components is judged in each. Rows without a doc_id stay."""
    docs_fp, rooted = _rooted(docs, shingle, radius, BUCKET_ROWS)
    roots = rooted.select(F.col("fp").alias("f"), "root")
    first = docs_fp.filter("doc_id IS NOT NULL").join(roots, F.col("fp") == F.col("f")).groupBy("root").agg(F.min(F.struct("doc_id", "fp", "digest")).alias("m"))
    keep = first.select(F.col("m.doc_id").alias("kept_id"), F.col("m.digest").alias("kept_digest"))
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_digest().alias("digest"))
    named = rows.join(keep, (F.col("id") == F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi").dropDuplicates(["id", "digest"])
    return named.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))

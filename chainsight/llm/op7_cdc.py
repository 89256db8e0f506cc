"""Substring deduplication by content-defined chunks of a gear rolling hash.

Each byte shifts a 16-bit gear hash (h = 2 h + gear[byte]), so the hash at a byte depends on the
16 bytes up to it. A chunk ends where no hash within ``radius`` bytes on either side is larger: boundaries
depend on nearby content alone, so an insertion moves only the chunks it touches, and no two boundaries
are nearer than the radius. Chunks of all documents are compared by a 64-bit digest; of equal chunks the one
of the smallest (doc_id, start) stays. Runs of neighbouring repeated chunks are extended byte by byte on both sides, as far as the
text agrees with the text around their source. A run with at least ``min_words`` words in whole chunks, or, extended,
``full_words`` words or ``full_bytes`` bytes (text with few white-space words), is a repeated passage, removed with its extension;
short runs (a common phrase, a licence line) are left alone. Each removed byte equals one at an earlier (doc_id, place), so the first of
all copies stays.

Limits: a repeat is seen by a whole chunk in it. All but the first 31 bytes and the last 16 of a repeat are cut as in its source, so 51 words hold
one but for a very long gap between boundaries (3 of 6000 repeats of the shortest words). Extended passages of one document may overlap.

Defined cases: null or empty texts have no chunk and stay; documents without a doc_id take no part and stay;
repeated rows of one document count as one; a chunk without a boundary is cut every ``most`` bytes; the later of two
repeats within one document goes too; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StringType, StructField, StructType

from .common import small_batches, written


@dataclass(frozen=True)
class Chunks:
    """radius: bytes on either side that a boundary's hash is the largest of; min_words: whole-chunk words of
    a repeated run that make it a passage; full_words, full_bytes: words or bytes of an extended run that make it one; most: longest chunk in bytes; near: bytes that are compared on each side at first, further ones
    where all of these agree; parts, rows: a common digest's rows are dealt over ``parts`` tasks, or more, of about ``rows`` rows;
    sample, share: one document in ``sample`` tells which digests are in more than ``share`` of all documents or ``rows`` of them."""
    radius: int = 16
    min_words: int = 20
    full_words: int = 50
    full_bytes: int = 300
    most: int = 4000
    near: int = 128
    parts: int = 64
    rows: int = 20_000
    sample: int = 32
    share: float = 0.002


GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) & 0xFFFF for b in range(256)], np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling: 1, 2, 4, 8, 16 bytes."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        h = h.copy()
        h[shift:] += h[:-shift] << np.uint16(shift)
    return h


def boundaries(data: np.ndarray, radius: int) -> np.ndarray:
    """Positions after which a chunk ends: no larger hash within ``radius`` on either side, and no other
    boundary this near before it. Equal hashes count, so periodic text is cut at one place of its period."""
    n = len(data)
    if n <= radius:
        return np.zeros(0, np.int64)
    h = gear(data).astype(np.int32)
    pad = np.full(radius, -1, np.int32)

    def largest(x, width):  # largest of `width` values from each position on
        have = 1
        while have * 2 <= width:
            x = np.maximum(x[:-have], x[have:])
            have *= 2
        return np.maximum(x[:len(x) - (width - have)], x[width - have:]) if have < width else x

    before = largest(np.concatenate([pad, h]), radius)[:n]  # of the radius values before i
    after = largest(np.concatenate([h, pad]), radius)[1:n + 1]  # of the radius values after i
    at = np.flatnonzero((h >= before) & (h >= after))
    if len(at) > 1 and np.diff(at).min() <= radius:
        out, last = [], -radius - 1
        for i in at.tolist():
            if i - last > radius:
                out.append(i)
                last = i
        at = np.array(out, np.int64)
    return at


def chunk_spans(text: bytes, settings: Chunks = Chunks()) -> list[tuple[int, int]]:
    """(start, end) of the chunks of one text."""
    ends = (boundaries(np.frombuffer(text, np.uint8), settings.radius) + 1).tolist()
    out, a = [], 0
    for b in [*ends, len(text)]:
        while b - a > settings.most:
            out.append((a, a + settings.most))
            a += settings.most
        if b > a:
            out.append((a, b))
        a = b
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


# (start, length, words) of a chunk in one long: it sorts by start
_LEN, _WORDS = 12, 12


def _pack(start, length, words):
    return (start << (_LEN + _WORDS)) | (length << _WORDS) | words


def _chunks(it, settings, common={}):
    for batch in small_batches(it, 1):
        ids = batch.column(0).to_pylist()
        doc, digest, meta, more, salt = [], [], [], [], []
        for i, b in enumerate(batch.column(1).to_pylist()):
            if not b:
                continue
            spans = chunk_spans(b, settings)
            # words that begin in a chunk
            space = _SPACE[np.frombuffer(b, np.uint8)]
            begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
            edge = np.array([s for s, _ in spans] + [len(b)])
            words = np.diff(np.searchsorted(begins, edge)).tolist()
            own: dict = {}
            for (s, e), w in zip(spans, words):
                own.setdefault(_signed(xxhash.xxh3_64_intdigest(b[s:e])), []).append(_pack(s, e - s, w))
            doc += [i] * len(own)
            digest += own
            meta += [m[0] for m in own.values()]
            more += [m[1:] or None for m in own.values()]
            deal = crc32(str(ids[i]).encode())
            salt += [deal % common[d] + 1 if d in common else 0 for d in own]
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.int64()), batch.column(0).take(pa.array(doc, pa.int64())), pa.array(meta, pa.int64()), pa.array(more, pa.list_(pa.int64())), pa.array(salt, pa.int32())], names=["digest", "doc_id", "meta", "more", "salt"])


def chunk_table(docs: DataFrame, settings: Chunks = Chunks(), common=None) -> DataFrame:
    """(digest, doc_id, meta, more, salt) of every chunk of the documents that have a doc_id: one row for each digest of
    a document, with its first place and its further ones, so text that repeats itself makes few rows. The rows of
    a digest in ``common`` (a broadcast dict of digest and tasks) are dealt over salts from 1; salt is 0 elsewhere."""
    src = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("b"))
    return src.mapInArrow(lambda it: _chunks(it, settings, common.value if common else {}), "digest long, doc_id long, meta long, more array<long>, salt int")


def common_digests(docs: DataFrame, settings: Chunks = Chunks()) -> dict:
    """Digests in more than ``share`` of the documents of a hash sample, or in about ``rows`` of all, with the tasks to deal them over:
    the 100,000 commonest at most. They only say which rows are dealt over several tasks; no result depends on them."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(settings.sample)) == 0)
    least = max(20.0, min(settings.share * some.count(), settings.rows / settings.sample))
    seen = chunk_table(some, settings).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    return {d: max(settings.parts, n * settings.sample // settings.rows + 1) for d, n in seen.orderBy(F.desc("n"), "digest").limit(100_000).collect()}


def passages(docs: DataFrame, settings: Chunks = Chunks()) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_words, source_doc_id): the repeated passages to remove, each with the
    document that holds the longest of its chunks before. One shuffle of chunk digests by digest; only
    repeated chunks go on, by document; the texts meet the edges of their runs once."""
    common = docs.sparkSession.sparkContext.broadcast(common_digests(docs, settings))
    chunks = chunk_table(docs, settings, common)
    # a running minimum in sorted order, first within the salts of a common digest
    place = F.struct("doc_id", "meta")
    same = Window.partitionBy("digest", "salt").orderBy("doc_id", "meta").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chunks.withColumn("first", F.min(place).over(same))
    if common.value:
        # the firsts of a common digest's salts meet, one row each; what the digest's first is goes back to every salt, a row for each of
        # the common digests, whose number is bounded
        local = written(local.filter((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.meta") != F.col("meta")) | F.col("more").isNotNull() | (F.col("salt") > 0)), "repeated-chunks")
        met = local.filter("salt > 0").groupBy("digest").agg(F.min("first").alias("met"))
        chunks = local.join(F.broadcast(met), "digest", "left").withColumn("first", F.coalesce("met", "first")).drop("met")
    else:
        chunks = local
    other = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.meta") != F.col("meta"))
    later = F.concat(F.when(other, F.array("meta")).otherwise(F.array().cast("array<long>")), F.coalesce("more", F.array().cast("array<long>")))
    repeated = chunks.filter(other | F.col("more").isNotNull()).select("doc_id", F.col("first.doc_id").alias("source"), F.shiftright("first.meta", _LEN + _WORDS).alias("at"), F.explode(later).alias("meta")).select(
        "doc_id", F.shiftright("meta", _LEN + _WORDS).alias("start"), F.shiftright("meta", _WORDS).bitwiseAND(F.lit((1 << _LEN) - 1)).alias("size"),
        F.col("meta").bitwiseAND(F.lit((1 << _WORDS) - 1)).alias("words"), "source", "at").distinct()
    # neighbouring repeated chunks share (start - bytes of repeated chunks so far in the document)
    order = Window.partitionBy("doc_id").orderBy("start")
    runs = repeated.withColumn("run", F.col("start") + F.col("size") - F.sum("size").over(order))
    runs = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("words"), F.max(F.struct("size", F.negative("source").alias("source"))).alias("longest"),
        F.min(F.struct("start", "source", "at")).alias("left"), F.max(F.struct("start", "source", (F.col("at") + F.col("size")).alias("at"))).alias("right"))
    runs = written(runs.select("doc_id", "start", "end", "words", F.negative("longest.source").alias("source_doc_id"), "left", "right"), "runs")
    gains = _extended(docs, runs, settings).groupBy("doc_id", "start").agg(*[
        F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0)).alias(f"{c}{side}") for side in (0, 1) for c in ("gain", "more")])
    out = runs.join(gains, ["doc_id", "start"], "left").fillna(0, ["gain0", "gain1", "more0", "more1"]).select(
        "doc_id", (F.col("start") - F.col("gain0")).alias("start_byte"), (F.col("end") + F.col("gain1")).alias("end_byte"),
        (F.col("words") + F.col("more0") + F.col("more1")).alias("n_words"), "source_doc_id", "words")
    whole = (F.col("words") >= settings.min_words) | (F.col("n_words") >= settings.full_words) | (F.col("end_byte") - F.col("start_byte") >= settings.full_bytes)
    return out.filter(whole).drop("words")


# ---- the edges of runs: side 0 is the text before ``pos``, side 1 the text from ``pos``

def _slices(it, reach):
    """Rows (id, b, edges of that document) to the ``reach`` bytes at each edge and one more before them."""
    for batch in small_batches(it, 1):
        for i in range(batch.num_rows):
            doc, b, edges = (c[i].as_py() for c in batch.columns)
            for at in range(0, len(edges), 8192):
                part = edges[at:at + 8192]
                near = [b[max(0, e["pos"] - 1):e["pos"] + reach] if e["side"] else b[max(0, e["pos"] - reach - 1):e["pos"]] for e in part]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(part), pa.int64()), *[pa.array([e[c] for e in part], t) for c, t in (("pos", pa.int64()), ("side", pa.int32()), ("n", pa.int64()))], pa.array(near, pa.binary())], names=["id", "pos", "side", "n", "near"])


def agreement(own: bytes, source: bytes, side: int, reach: int) -> tuple[int, int]:
    """(bytes, words that begin in them) over which two edges agree, outwards, at most ``reach``."""
    a, b = np.frombuffer(own, np.uint8), np.frombuffer(source, np.uint8)
    a, b = (a[1:], b[1:]) if side else (a[::-1], b[::-1])
    n = min(len(a), len(b), reach)
    differ = np.flatnonzero(a[:n] != b[:n])
    n = int(differ[0]) if len(differ) else n
    text = np.frombuffer(own, np.uint8)
    a, b = (1, n + 1) if side else (len(text) - n, len(text))
    space = _SPACE[text]
    return n, int((~space[a:b] & (space[a - 1:b - 1] if a else np.r_[True, space[:b - 1]])[:b - a]).sum())


def _gains(it, reach):
    for batch in it:
        got = [agreement(a, b, side, reach) for a, b, side in zip(*(batch.column(c).to_pylist() for c in ("near", "source_near", "side")))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "side")], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "start", "side", "gain", "more"])


def _agreed(docs: DataFrame, edges: DataFrame, reach: int) -> DataFrame:
    """(doc_id, start, side, gain, more) of ``edges`` (doc_id, start, side, pos, source, at). The bytes at each edge of a run and of its
    source are cut out where the texts are; an edge of a source that very many runs share is broadcast (at most about 1000 of them)."""
    n = edges.count()
    wanted = edges.select(F.col("doc_id").alias("id"), "pos", "side", F.lit(0).alias("n")).unionByName(edges.select(F.col("source").alias("id"), F.col("at").alias("pos"), "side", F.lit(1).alias("n")))
    wanted = wanted.groupBy("id", "pos", "side").agg(F.sum("n").alias("n"))
    wanted = wanted.groupBy("id").agg(F.collect_list(F.struct("pos", "side", "n")).alias("edges")).hint("merge")  # at most a document's own chunks
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("b")).filter("b is not null")
    near = written(src.join(wanted, "id").mapInArrow(lambda it: _slices(it, reach), "id long, pos long, side int, n long, near binary"), "edges")
    source = near.select(F.col("id").alias("source"), F.col("pos").alias("at"), "side", F.col("near").alias("source_near"), "n")
    hub = F.col("n") > max(20_000, n // 1000)
    marks = F.broadcast(source.filter(hub).select("source", "at", "side").distinct().withColumn("hub", F.lit(True)))
    edges = edges.join(marks, ["source", "at", "side"], "left")
    met = edges.filter("hub is null").join(source.filter(~hub).drop("n"), ["source", "at", "side"]).unionByName(edges.filter("hub").join(F.broadcast(source.filter(hub).drop("n")), ["source", "at", "side"]))
    own = near.select(F.col("id").alias("doc_id"), "pos", "side", "near")
    met = met.join(own, ["doc_id", "pos", "side"]).select("doc_id", "start", "side", "near", "source_near")
    got = met.mapInArrow(lambda it: _gains(it, reach), "doc_id long, start long, side int, gain long, more long")
    # a doc_id with several texts: what all of them agree in
    return got.groupBy("doc_id", "start", "side").agg(F.min(F.struct("gain", "more")).alias("least")).select("doc_id", "start", "side", "least.gain", "least.more")


def _extended(docs: DataFrame, runs: DataFrame, settings: Chunks) -> DataFrame:
    """(doc_id, start, side, gain, more) of the edges of runs that go on: bytes and words to add. Text that agrees for longer
    than the longest chunk and the bytes a boundary depends on would be in the run already."""
    side = lambda k, pos, end: F.struct(F.lit(k).alias("side"), F.col(pos).alias("pos"), F.col(f"{end}.source").alias("source"), F.col(f"{end}.at").alias("at"))
    edges = runs.select("doc_id", "start", F.explode(F.array(side(0, "start", "left"), side(1, "end", "right"))).alias("e")).select("doc_id", "start", "e.*")
    edges = edges.filter("side = 1 or (pos > 0 and at > 0)")
    near = written(_agreed(docs, edges, settings.near), "gains")
    on = near.filter(F.col("gain") >= settings.near)
    more = _agreed(docs, edges.join(on.select("doc_id", "start", "side"), ["doc_id", "start", "side"]), settings.most + 64)
    return near.filter(F.col("gain") < settings.near).unionByName(more)


def remove_spans(b: bytes, spans) -> bytes:
    """The text without the spans; an edge inside a character moves into the span, so no character is broken."""
    out, at = [], 0
    for s, e in sorted(spans):
        while s < len(b) and b[s] & 0xC0 == 0x80:
            s += 1
        while e < len(b) and e > s and b[e] & 0xC0 == 0x80:
            e -= 1
        s = max(s, at)
        if e > s:
            out.append(b[at:s])
            at = e
    return b"".join([*out, b[at:]])


def _cleaned(it):
    """Rows (row, b, spans) to (row, had, text)."""
    for batch in small_batches(it, 1):
        texts = [None if b is None else b if not spans else remove_spans(b, [(x["start_byte"], x["end_byte"]) for x in spans]) for b, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "had", "text"])


def deduplicated(docs: DataFrame, settings: Chunks = Chunks()) -> DataFrame:
    """The documents with repeated passages cut out of their texts and n_chars renewed; a document left
    without a word goes, unless it had none before. Columns of the input cannot clash: they are kept in one struct."""
    found = written(passages(docs, settings), "passages")
    spans = found.groupBy(F.col("doc_id").alias("span_id")).agg(F.collect_list(F.struct("start_byte", "end_byte")).alias("spans"))  # at most a document's own chunks
    cols = [c for c in docs.columns if c not in ("text", "n_chars")]
    spans = spans.hint("merge")  # they grow with the documents: not to be broadcast
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("text").cast("string").cast("binary").alias("b"))
    src = src.join(spans, F.col("row.doc_id") == F.col("span_id"), "left")
    words = "[^ \\t-\\r]"
    had = F.coalesce(F.col("b").cast("string").rlike(words) & F.col("spans").isNotNull(), F.lit(False))
    src = src.select("row", "b", "spans", had.alias("had"))
    out = src.mapInArrow(_cleaned, StructType([src.schema["row"], src.schema["had"], StructField("text", StringType())]))
    out = out.filter(~F.col("had") | F.col("text").rlike(words))
    have = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*[have[c] if c in have else F.col(f"row.`{c}`") for c in docs.columns])

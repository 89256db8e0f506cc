"""Quality rules by cross-document line frequency.

Normalised lines (lower case, digits as 0, white space collapsed) are hashed; for each host the
number of *distinct documents* holding a line is counted. Lines above the host's limit are
removed; a document left with too little of its words is rejected as depleted.

Distinct documents: copies of one text say nothing about a line being boilerplate, so documents
are counted by a 128-bit digest of their whole text, both for the line and for its host. Exact copies
share it; texts that differ anywhere count each.

Defined cases: null text counts as empty (no words, base_failed); null host is a host of its own;
repeated rows and copies count once for line frequency and for their host, the empty text too, and each get their verdict; an empty
table gives an empty result. Only the named columns are read, other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

SYMBOLS = b"#*$%&|<>"
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")
_DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class Limits:
    """share: of a host's distinct documents above which a line is boilerplate; least: documents it must be in
    at any rate; left: share of its words a document must keep; window: words of a repeat window;
    broadcast_rows: frequent lines up to which they are sent to every task (else they are joined)."""
    share: float = 0.01
    least: int = 20
    left: float = 0.2
    window: int = 5
    broadcast_rows: int = 200_000


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of the normalised line; None for a line without a word."""
    words = line.split()
    if not words:
        return None
    norm = _DIGIT.sub("0", b" ".join(words).decode("utf-8", "replace").lower())
    h = xxhash.xxh64_intdigest(norm)
    return h - (1 << 64) if h >= 1 << 63 else h


def repeat_words(words: list[bytes], window: int) -> int:
    """Words covered by windows that occur twice or more in the text, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m, k = n - window + 1, np.uint64(0x9E3779B97F4A7C15)
    w = np.zeros(m, np.uint64)
    for j in range(window):
        w = (w ^ (w >> np.uint64(31))) * k + h[j:j + m]
    s = np.sort(w)
    same = s[1:][s[1:] == s[:-1]]
    if not len(same):
        return 0
    hit = np.flatnonzero(np.isin(w, same))
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def _lines_of(batches):
    """(host, line, content): a row for each line of a document, and one without a line for the document itself."""
    for batch in small_batches(batches, 1):
        hosts, lines, keys = [], [], []
        for host, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b = b or b""
            key = xxhash.xxh3_128_digest(b)
            for h in {None, *map(line_hash, set(b.split(b"\n")))}:
                hosts.append(host)
                lines.append(h)
                keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(lines, pa.int64()), pa.array(keys, pa.binary())], names=["host", "line", "content"])


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(host, line, n_docs) of the lines above their host's limit. Copies are merged map-side, the
    distinct counts are aggregated in two pre-aggregated steps, so a very common line never
    gathers in one task. A host's documents are counted in the same pass, as the rows without a line."""
    src = docs.select(F.col(host).cast("string").alias("host"), F.col(text).cast("string").cast("binary").alias("b"))
    seen = src.mapInArrow(_lines_of, "host string, line long, content binary")
    n = seen.groupBy("host", "line", "content").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("one").alias("n_docs"))
    n = written(n.filter(F.col("line").isNull() | (F.col("n_docs") > limits.least)), "line-counts")
    hosts = n.filter("line is null").select(F.col("host").alias("h"), F.col("n_docs").alias("host_docs"))
    over = n.filter("line is not null").join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return over.filter(F.col("n_docs") > limits.share * F.col("host_docs")).select("host", "line", "n_docs")


def measures(b: bytes | None, window: int = 5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    b = b or b""
    words = b.split()
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    return (len(words), len(b"".join(words).decode("utf-8", "replace")), sum(b.count(c) for c in SYMBOLS), dup, repeat_words(words, window))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, removed_words long, kept boolean"
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_()]
_NAMES = [x.split()[0] for x in VERDICT.split(", ")]


def _verdict(m: tuple, removed: int, limits: Limits) -> tuple:
    failed = base_failed(m[0], m[4])
    return (*m, failed, removed, not failed and m[0] - removed >= limits.left * m[0])


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", limits: Limits = Limits(),
          clean_text: bool = False) -> DataFrame:
    """One row per document: ``keep`` columns, the base measures, removed words and the verdict.

    ``clean_text`` replaces the text by what is left without the frequent lines. The frequent lines
    go to every task if there are at most ``broadcast_rows`` of them (checked); beyond that the
    lines are joined.
    """
    often = written(frequent_lines(docs, host, text, limits), "frequent-lines")
    rows = often.select("host", "line").limit(limits.broadcast_rows + 1).collect() if limits.broadcast_rows else None
    src = docs.select(*keep, F.col(host).cast("string").alias("__host"), F.col(text).cast("string").cast("binary").alias("__b"))
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    schema = f"{kept_schema}, {VERDICT}" + (", __text string" if clean_text else "")
    if rows is not None and len(rows) <= limits.broadcast_rows:
        sets: dict = {}
        for r in rows:
            sets.setdefault(r[0], set()).add(r[1])
        shared = docs.sparkSession.sparkContext.broadcast(sets)
        return src.mapInArrow(lambda it: _judged(it, len(keep), shared.value, limits, clean_text), schema)
    return _judge_by_join(src, keep, often, limits, clean_text, kept_schema)


def _judged(it, k, sets, limits, clean_text):
    """sets: frequent lines by host, or None where the batch itself has each row's own (last column)."""
    for batch in small_batches(it, k + 1):
        out, texts = [], []
        own = batch.column(k + 2).to_pylist() if sets is None else None
        for i, (host, b) in enumerate(zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())):
            often = set(own[i] or ()) if sets is None else sets.get(host, ())
            removed, lines = 0, (b or b"").split(b"\n")
            if often:
                gone = [h is not None and h in often for h in map(line_hash, lines)]
                removed = sum(len(x.split()) for x, g in zip(lines, gone) if g)
                if clean_text and removed:
                    lines = [x for x, g in zip(lines, gone) if not g]
            out.append(_verdict(measures(b, limits.window), removed, limits))
            if clean_text:
                texts.append(None if b is None else b if not removed else b"\n".join(lines))
        cols = [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES]
        extra = [pa.array(texts, pa.binary()).cast(pa.string())] if clean_text else []
        yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(k)], *cols, *extra], names=[*batch.schema.names[:k], *_NAMES, *["__text"] * clean_text])


def _own_lines(it):
    for batch in it:
        lines = [[h for h in {line_hash(x) for x in (b or b"").split(b"\n")} if h is not None] for b in batch.column("__b").to_pylist()]
        yield batch.append_column("__lines", pa.array(lines, pa.list_(pa.int64())))


def _judge_by_join(src, keep, often, limits, clean_text, kept_schema):
    """More frequent lines than may be broadcast: each row's own frequent lines come by a join."""
    rows = written(src.withColumn("__row", F.monotonically_increasing_id()), "rows")
    schema = f"{kept_schema}, __host string, __b binary, __row long"
    lines = rows.mapInArrow(_own_lines, f"{schema}, __lines array<long>").select("__row", F.col("__host").alias("h"), F.explode("__lines").alias("l"))
    hit = lines.join(often, F.col("h").eqNullSafe(F.col("host")) & (F.col("l") == F.col("line"))).groupBy("__row").agg(F.collect_set("l").alias("__own"))
    back = rows.join(hit, "__row", "left").select(*keep, "__host", "__b", "__own")
    out = f"{kept_schema}, {VERDICT}" + (", __text string" if clean_text else "")
    return back.mapInArrow(lambda it: _judged(it, len(keep), None, limits, clean_text), out)


def quality_verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The verdict table of ``documents``: doc_id, measures, base_failed, removed_words, kept."""
    return judge(docs, ["doc_id"], limits=limits)


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with frequent lines taken out of their texts and n_chars renewed."""
    # under names of their own the columns cannot clash with the verdict's
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    src = docs.select(*[F.col(c).alias(n) for c, n in own.items()])
    cols = [n for c, n in own.items() if c not in ("text", "n_chars")]
    out = judge(src, cols, host=own["source"], text=own["text"], limits=limits, clean_text=True).filter("kept")
    have = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[have.get(c, F.col(n)).alias(c) for c, n in own.items()])

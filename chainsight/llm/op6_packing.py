"""Packing into fixed windows: non-negative least squares over shallow length combinations.

A document is its token ids and an end id; it is cut into pieces of a whole window and one shorter rest. The
histogram of piece lengths (at most ``window`` numbers) comes to the driver. There, combinations of two or three lengths
that fill a window exactly are enumerated, and repeat counts x >= 0 are fitted so that the combinations use up the
histogram (least squares, projected gradient). Counts are rounded and held to what the histogram still has. Residual lengths are packed
greedily, longest first, many equal sequences at a time, as long as that wastes at most ``slack`` of a window; what is left
then is laid end to end and cut at window ends. The plan is a list of patterns with repeats, bounded by the
window alone. Each piece gets its rank among the pieces of its length (two-level, so a very common length is
split) and finds its pattern, sequence and offset by a search in its length's slots.

Defined cases: null or empty texts are the end id alone; repeated rows are packed each; a null doc_id is
carried; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, small_batches, written
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    return [(s, min(window, n - s)) for s in range(0, n, window)]


def _pieces(it, window, end, paths):
    encode = encoder(paths)
    tail = np.array([end], np.uint32)
    for batch in small_batches(it, 1):
        doc, rows, rests = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = np.concatenate([encode(text), tail]) if text else tail
            raw = ids.astype("<u4").tobytes()
            for s, n in cut(len(ids), window):
                doc.append(i)
                rows.append((s, n, crc32(raw[4 * s:4 * (s + n)]), len(ids)))
                rests.append(raw[4 * s:] if n < window else None)
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *[pa.array(c, pa.int64()) for c in cols], pa.array(rests, pa.binary())], names=[*_NAMES, "ids"])


def pieces(docs: DataFrame, window: int = 1024, end: int = 0, paths=None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) of every piece; ids only for those below a window."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lambda it: _pieces(it, window, end, paths), f"{PIECES}, ids binary")


# ---------------------------------------------------------------- the plan

def combinations_of(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a <= b <= c, a may be 0) of present lengths that add up to the window."""
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    here[0] = True
    out = []
    for a in np.r_[0, lengths]:
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        b = b[here[b] & here[window - a - b]]
        if len(b):
            out.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fit(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 minimising |A x - hist|^2, column j of A counting the lengths of combination j: accelerated
    projected gradient steps, with each combination scaled by how much its lengths are in demand."""
    if not len(combos):
        return np.zeros(0)
    use = np.bincount(combos.ravel(), minlength=len(hist)).astype(float)
    use[0] = 1
    x = np.min(np.where(combos > 0, hist[combos] / np.maximum(use[combos], 1), np.inf), axis=1)
    step = 1.0 / (use[combos] * (combos > 0)).sum(axis=1).max() / 3
    step = np.maximum(step, 1.0 / (3 * (use[combos] * (combos > 0)).sum(axis=1)))
    y, t = x, 1.0
    for _ in range(rounds):
        left = np.bincount(combos.ravel(), np.repeat(y, 3), len(hist)) - hist
        left[0] = 0
        new = np.maximum(0.0, y - step * left[combos].sum(axis=1))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0.0, new + (t - 1) / s * (new - x))
        x, t = new, s
    return x


def _take(pattern, hist) -> int:
    """How often the pattern can still be taken."""
    need: dict = {}
    for p in pattern:
        need[p] = need.get(p, 0) + 1
    return min(int(hist[p]) // n for p, n in need.items())


def plan(hist: np.ndarray, window: int, slack: float = 0.01) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns of lengths with repeats, and the histogram of what is left for the cut stream."""
    hist, out = hist.astype(np.int64).copy(), []
    stream = np.zeros_like(hist)

    def use(pattern, n):
        if n > 0:
            for p in pattern:
                hist[p] -= n
            out.append((pattern, int(n)))

    use((window,), int(hist[window]))
    combos = combinations_of(np.flatnonzero(hist[1:window]) + 1, window)
    x = fit(combos, hist.astype(float))
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        pattern = tuple(int(v) for v in combos[j] if v)
        use(pattern, min(int(round(x[j])), _take(pattern, hist)))
    # residual: the longest piece, then the longest that still fits, and so on; as often as the lengths last
    while hist[1:window].any():
        left, pattern, rest = window, [], hist[:window].copy()
        while left:
            fits = np.flatnonzero(rest[1:min(left, window - 1) + 1]) + 1
            if not len(fits):
                break
            p = int(fits[-1])
            if pattern and p < left:  # better two that fill the window than one that nearly does
                two = fits[rest[left - fits] > (2 * fits == left)]
                p = int(two[-1]) if len(two) else p
            pattern.append(p)
            rest[p] -= 1
            left -= p
        if left <= slack * window:
            use(tuple(pattern), _take(pattern, hist))
        else:
            stream[pattern[0]], hist[pattern[0]] = hist[pattern[0]], 0
    return out, stream


@dataclass
class Slots:
    """For every length, the first rank of each slot, with the sequence and offset it begins at; and of the
    stream, the first rank and the token position of each length."""
    window: int
    first: dict
    sequence: dict
    offset: dict
    stream_rank: dict
    stream_at: dict
    sequences: int


def slots(patterns, stream, window: int) -> Slots:
    got: dict = {}
    seen: dict = {}
    base = 0
    for pattern, n in patterns:
        at = 0
        for p in pattern:
            got.setdefault(p, []).append((seen.get(p, 0), base, at))
            seen[p] = seen.get(p, 0) + n
            at += p
        base += n
    cols = {p: np.array(v, np.int64).T for p, v in got.items()}
    lengths = [int(p) for p in np.flatnonzero(stream)]
    at = dict(zip(lengths, np.cumsum([0, *[p * int(stream[p]) for p in lengths]]).tolist()))
    return Slots(window, *({p: c[k] for p, c in cols.items()} for k in range(3)), {p: seen.get(p, 0) for p in lengths}, at, base)


PLACED = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, from long"


def _place(it, shared):
    for batch in it:
        t = shared.value
        length, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy()
        seq, off, size = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), length.copy()
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            p = int(length[part[0]])
            flow = rank[part] >= t.stream_rank.get(p, np.iinfo(np.int64).max)
            own, part = part[flow], part[~flow]
            if len(part):
                k = np.searchsorted(t.first[p], rank[part], side="right") - 1
                seq[part] = t.sequence[p][k] + rank[part] - t.first[p][k]
                off[part] = t.offset[p][k]
            if len(own):
                at = t.stream_at[p] + (rank[own] - t.stream_rank[p]) * p
                seq[own], off[own] = t.sequences + at // t.window, at % t.window
                size[own] = np.minimum(p, t.window - off[own])
        split = np.flatnonzero(size < length)  # the second part of a piece cut at the end of a window
        n = len(length)
        take = pa.array(np.r_[np.arange(n), split])
        crc = batch.column(4).to_pylist()
        for i in split:
            crc[i] = None
        zero = np.zeros(n, np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(take), batch.column(1).take(take),
            pa.array(np.r_[batch.column(2).to_numpy(), batch.column(2).to_numpy()[split] + size[split]]),
            pa.array(np.r_[size, length[split] - size[split]]), pa.array(crc + [None] * len(split), pa.int64()), batch.column(5).take(take),
            pa.array(np.r_[seq, seq[split] + 1]), pa.array(np.r_[off, zero[:len(split)]]), pa.array(np.r_[zero, size[split]])],
            names=["row", *_NAMES, "sequence_id", "offset", "from"])


def _crc(it):
    for batch in it:
        at, n = batch.column("from").to_pylist(), batch.column("length").to_pylist()
        crc = [crc32(b[4 * a:4 * (a + m)]) for b, a, m in zip(batch.column("ids").to_pylist(), at, n)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _NAMES[:3]], pa.array(crc, pa.int64()), batch.column("doc_tokens"), batch.column("sequence_id"), batch.column("offset")], names=[*_NAMES, "sequence_id", "offset"])


def packed(docs: DataFrame, window: int = 1024, end: int = 0, bucket_rows: int = 20_000, slack: float = 0.01, paths=None) -> DataFrame:
    """Every piece with its sequence and offset: PIECES columns, sequence_id, offset."""
    cutup = written(pieces(docs, window, end, paths).withColumn("row", F.monotonically_increasing_id()), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for length, n in cutup.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most `window` rows
        hist[length] = n
    patterns, stream = plan(hist, window, slack)
    shared = docs.sparkSession.sparkContext.broadcast(slots(patterns, stream, window))  # bounded by the window, not by the rows
    buckets = int(max(1, -(-int(hist.max()) // bucket_rows)))
    at = ranked(cutup.select("row", *_NAMES), ["length"], F.xxhash64("row"), ["doc_id", "start", "ids_crc32", "row"], "rank", buckets)
    placed = written(at.mapInArrow(lambda it: _place(it, shared), PLACED), "placed")
    cols = [*_NAMES, "sequence_id", "offset"]
    parts = placed.filter("ids_crc32 is null").join(cutup.select("row", "ids"), "row").select(*cols, "from", "ids")
    return placed.filter("ids_crc32 is not null").select(*cols).unionByName(parts.mapInArrow(_crc, f"{PIECES}, sequence_id long, offset long"))

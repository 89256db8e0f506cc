"""Spelling variants: words one edit apart, by dynamic programming over sorted word lists.

The vocabulary is counted in Arrow batches and pre-aggregated. Two words one edit apart agree before or after the
middle of the shorter one, so each word goes to the lists of its first and of its second half (for its own
length and for the length below, as the longer word of a pair). A list is sorted; all its words are
queries against the words behind them. The scan keeps, for each query, the band of the edit matrix
(three cells of a row) at the current shared prefix: words with the same prefix share its rows (their adjacent longest common
prefixes say how far), and a range of words whose prefix is already more than one edit away is skipped whole.

A pair is found in one list only: the one whose part of the word holds the pair's first differing place.

Skew: a list of more than ``most`` words is split again at the middle of the part in which its words may differ, until that part
is one code point wide (then a list holds at most one word or two a letter). Per list a word yields one row with
its number of near words and the best of them, never one a pair.

Defined cases: null texts have no words; a null doc_id counts as an empty string in ``<doc_id>:``; repeated rows count each; ties of
forms go to the smallest word; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: U+00C0 to U+00FF are the bytes C3 80 to C3 BF
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_CUT = re.compile(rb"[\x00-\x60\x7b-\x7f]")
LEAST = 7
PIECE = 1 << 20


def runs(text: bytes):
    """Runs of letters of a UTF-8 text in lower case (A-Z only), in pieces cut at a character outside every run."""
    text = text.lower()
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield _RUN.findall(text[at:end])
        at = end


def _counted(batches):
    for batch in batches:
        for part in small_batches([batch], 1):
            total: Counter = Counter()
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(b":", zlib.crc32(doc.encode()))
                for found in runs(text.as_buffer().to_pybytes()):
                    for run, n in Counter(found).items():
                        if len(run) < LEAST:
                            continue
                        h = zlib.crc32(run, start)
                        if h % 31 == 0:
                            s = run.decode()
                            i = h % len(s)
                            run = (s[:i] + s[i + 1:]).encode()
                        if len(run) >= LEAST and (len(run) >= 2 * LEAST or len(run.decode()) >= LEAST):
                            total[run] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, least: int = 2) -> DataFrame:
    """(word, n): runs of letters with their planted deletions, at least 7 code points and ``least`` occurrences."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---------------------------------------------------------------- the scan of sorted lists

FAR = 9


def _child_starts(lcp: np.ndarray, depth: int) -> np.ndarray:
    """Sorted positions at which a new prefix of ``depth`` + 1 code points begins."""
    return np.flatnonzero(lcp <= depth)


def near_pairs(codes: np.ndarray, lens: np.ndarray, groups: np.ndarray, queries: int = 4096):
    """Pairs (i, j), i < j, of words one edit apart in the same group. Rows are sorted by (group, word); ``codes`` holds
    the words' code points, padded with 0."""
    n = len(lens)
    wide = codes.shape[1]
    codes = np.hstack([codes, np.zeros((n, 3), codes.dtype)])
    lcp = np.full(n, -1, np.int32)
    if n > 1:
        same = codes[1:, :wide] == codes[:-1, :wide]
        lcp[1:] = np.where(groups[1:] == groups[:-1], np.where(same.all(1), wide, same.argmin(1)), -1)
    ends = np.flatnonzero(np.append(groups[1:] != groups[:-1], True)) + 1
    last = ends[np.searchsorted(ends, np.arange(n), side="right")]
    starts = [_child_starts(lcp, d) for d in range(wide + 1)]
    for first in range(0, n, queries):
        q = np.arange(first, min(n, first + queries))
        lo, hi = q + 1, last[q]
        q, lo, hi = q[lo < hi], lo[lo < hi], hi[lo < hi]
        # D[0][-1], D[0][0], D[0][1] of each query's matrix
        a, b, c = np.full(len(q), FAR, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        for d in range(wide + 1):
            if not len(q):
                break
            # a word that ends here is the first of its range
            over = lens[lo] == d
            if over.any():
                gap = lens[q] - d
                dist = np.select([gap == -1, gap == 0, gap == 1], [a, b, c], FAR)
                hit = over & (dist == 1)
                if hit.any():
                    yield q[hit], lo[hit]
                lo = lo + over
                keep = lo < hi
                q, lo, hi, a, b, c = q[keep], lo[keep], hi[keep], a[keep], b[keep], c[keep]
                if not len(q):
                    break
            # split each range at the next code point: one new row per distinct prefix
            s = starts[d]
            i, j = np.searchsorted(s, lo, side="right"), np.searchsorted(s, hi, side="left")
            parts = j - i + 1
            at = np.repeat(np.arange(len(q)), parts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            inner = s[np.minimum(i[at] + nth - 1, len(s) - 1)] if len(s) else lo[at]
            left = np.where(nth == 0, lo[at], inner)
            right = np.where(nth == parts[at] - 1, hi[at], s[np.minimum(i[at] + nth, len(s) - 1)] if len(s) else hi[at])
            q, a, b, c = q[at], a[at], b[at], c[at]
            x = codes[left, d]
            before = codes[q, d - 1] if d else np.zeros(len(q), codes.dtype)
            na = np.minimum(a + (x != before), b + 1) if d else np.ones(len(q), np.int8)
            nb = np.minimum(np.minimum(b + (x != codes[q, d]), c + 1), na + 1)
            nc = np.minimum(c + (x != codes[q, d + 1]), nb + 1)
            keep = np.minimum(np.minimum(na, nb), nc) <= 1
            q, lo, hi = q[keep], left[keep], right[keep]
            a, b, c = (v[keep].astype(np.int8) for v in (na, nb, nc))


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(w) for w in words], np.int32)
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    out = np.zeros((len(words), int(lens.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat
    return out, lens


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def _scan(rows: list) -> pa.RecordBatch:
    """Near words of whole lists: rows (key, rest, word, longer, lo, hi, n) sorted by (key, rest)."""
    keys, rests, words, longer, lo, hi, n = (list(x) for x in zip(*rows))
    groups = np.cumsum(np.array([True] + [a != b for a, b in zip(keys[1:], keys)])) - 1
    codes, lens = _matrix(rests)
    whole, _ = _matrix(words)
    longer, lo, hi, n = np.array(longer), np.array(lo), np.array(hi), np.array(n, np.int64)
    left, right = [], []
    for i, j in near_pairs(codes, lens, groups):
        same = whole[i] == whole[j]
        at = np.where(same.all(1), whole.shape[1], same.argmin(1))
        ok = (at >= lo[i]) & (at < hi[i]) & ~(longer[i] & longer[j])
        left.append(i[ok]); right.append(j[ok])
    if not left or not sum(map(len, left)):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in _FOUND.types], schema=_FOUND)
    i, j = np.concatenate(left), np.concatenate(right)
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    # equal words have one row a list here, and rows are in the order of the rest only: rank the words themselves
    order = np.lexsort(whole.T[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort([rank[b], -n[b], a])
    a, b = a[by], b[by]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    count = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in a[first]], pa.string()), pa.array(count, pa.int64()),
                                       pa.array([words[k] for k in b[first]], pa.string()), pa.array(n[b[first]], pa.int64())], schema=_FOUND)


def _scans(batches, size: int = 50_000):
    """Whole lists at a time: some ``size`` rows, or one list."""
    rows: list = []
    for batch in batches:
        rows.extend(zip(*[batch.column(i).to_pylist() for i in range(7)]))
        if len(rows) >= size:
            k = len(rows) - 1
            while k and rows[k - 1][0] == rows[-1][0]:
                k -= 1
            if k:
                yield _scan(rows[:k])
                rows = rows[k:]
    if rows:
        yield _scan(rows)


# ---------------------------------------------------------------- the lists

def _key() -> Column:
    """What the words of a list agree in: length of the shorter word, the part that may differ, and all around it."""
    return F.concat_ws("|", "s", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.expr("substring(word, hi + longer + 1, 1000000000)"))


def lists(words: DataFrame, most: int = 20_000) -> DataFrame:
    """(key, rest, word, longer, lo, hi, n): each word in the lists in which its near words are."""
    mid = F.floor(F.col("s") / 2)
    entries = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("s", F.length("word") - F.col("longer"))
    both = F.array(F.struct(F.lit(0).alias("lo"), mid.cast("int").alias("hi")), F.struct(mid.cast("int").alias("lo"), F.col("s").alias("hi")))
    # the last part also takes the place behind the shorter word's end
    entries = entries.withColumn("w", F.explode(both)).select("word", "n", "longer", "s", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")).withColumn("key", _key())
    done = []
    while True:
        counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        large = written(counts.filter((F.col("c") > most)).select("key", F.lit(True).alias("large")), "large-lists")
        n = large.count()
        if not n:
            done.append(entries)
            break
        marked = entries.join(F.broadcast(large) if n <= 100_000 else large, "key", "left")
        marked = written(marked.withColumn("large", F.coalesce("large", F.lit(False)) & (F.col("hi") - F.col("lo") > 1)), "lists")
        done.append(marked.filter(~F.col("large")).drop("large"))
        split = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), split.alias("hi")), F.struct(split.alias("lo"), F.col("hi").alias("hi")))
        entries = marked.filter("large").select("word", "n", "longer", "s", F.explode(halves).alias("w")).select(
            "word", "n", "longer", "s", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")).withColumn("key", _key())
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    rest = F.expr("substring(word, lo + 1, hi + longer - lo)")
    upto = F.when(F.col("hi") == F.col("s"), F.col("hi") + 1).otherwise(F.col("hi"))
    return out.select("key", rest.alias("rest"), "word", (F.col("longer") == 1).alias("longer"), "lo", upto.alias("hi"), "n")


def near_words(words: DataFrame, most: int = 20_000) -> DataFrame:
    """(word, n_near, form, form_n): number of words one edit away and the one of largest n (ties: smallest word)."""
    found = lists(words, most).repartition("key").sortWithinPartitions("key", "rest").mapInArrow(
        _scans, "word string, n_near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(F.negative("form_n").alias("m"), F.col("form").alias("f"))).alias("b"))
    return best.select("word", "n_near", F.col("b.f").alias("form"), F.negative("b.m").alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last by pointer doubling (n grows tenfold each step, so
    chains are short and have no cycles)."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        moved = at.join(nxt, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        at = moved.select("word", "root")
        if not moved.filter("moved").take(1):
            return at


def variants(docs: DataFrame, factor: int = 10, most: int = 20_000) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary."""
    words = written(vocabulary(docs), "vocabulary")
    near = words.join(near_words(words, most), "word", "left")
    is_form = F.col("form_n") >= factor * F.col("n")
    known = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "near")
    up = roots(known.filter("form IS NOT NULL"))
    return known.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))

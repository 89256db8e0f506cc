"""Edit-aware token counts: a segment tree of pre-token runs per document.

A text is cut into segments that begin at white space after other text: every byte-level BPE
pre-token ends there, whatever stands around it, so token counts of segments add up. A
document's tree is its segments' lengths and an implicit binary tree of token sums (node i over 2i and 2i + 1).
An edit (position, characters deleted, text inserted) replaces the segments that it touches plus the neighbours that
its edges may join; only that region is encoded again, and the sums above it are renewed. An edit that changes the number of segments
rebuilds the sums above its region from the leaves' counts, without encoding anything else.

Defined cases: null text counts as empty (no segment, sum 0); positions and lengths outside the text are clamped; null
edit fields count as 0 and ""; edits of one document are applied in order, each to the result of the one before; repeated rows
have a tree each; documents without edits keep their count; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

SEGMENT = 256
_CUTS = (" ", "\n")


def is_cut(text: str, i: int) -> bool:
    """Whether a segment may begin at ``i``: plain white space after something that is not white space."""
    return 0 < i < len(text) and text[i] in _CUTS and not text[i - 1].isspace()


def segments(text: str, size: int = SEGMENT) -> list[int]:
    """Lengths of the segments of ``text``: each at least ``size`` characters, but for the last one."""
    out, a, n = [], 0, len(text)
    while a < n:
        i = a + size
        while i < n:
            found = [x for x in (text.find(c, i) for c in _CUTS) if x >= 0]
            if not found:
                i = n
                break
            i = min(found)
            if is_cut(text, i):
                break
            i += 1
        b = min(i, n)
        out.append(b - a)
        a = b
    return out


class Tree:
    """Segment lengths, token counts as the leaves of an implicit binary tree, and the text."""

    def __init__(self, text: str, count, lengths=None, sums=None):
        self.text, self.count, self.encoded = text, count, 0
        self.lengths = segments(text) if lengths is None else list(lengths)
        if sums is None:
            at, counts = 0, []
            for n in self.lengths:
                counts.append(self._encode(text[at:at + n]))
                at += n
            self._build(counts)
        else:
            self.sums = list(sums)

    def _encode(self, piece: str) -> int:
        self.encoded += len(piece)
        return self.count(piece)

    def _build(self, counts):
        k = 1
        while k < len(counts):
            k *= 2
        self.sums = [0] * k + counts + [0] * (k - len(counts))
        for i in range(k - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1] if len(self.sums) > 1 else 0

    def counts(self) -> list[int]:
        k = len(self.sums) // 2
        return self.sums[k:k + len(self.lengths)]

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters at ``at`` by ``inserted``."""
        n = len(self.text)
        at = min(max(at, 0), n)
        end = min(n, at + max(deleted, 0))
        # segments that hold a character of the change or of its neighbours on either side
        lo = hi = start = 0
        pos = 0
        first = None
        for i, size in enumerate(self.lengths):
            if first is None and pos + size >= at:
                first, start = i, pos
            if pos <= end:
                hi = i + 1
                stop = pos + size
            else:
                break
            pos += size
        lo = first or 0
        if not self.lengths:
            start = stop = 0
        text = self.text[:at] + inserted + self.text[end:]
        stop += len(inserted) - (end - at)
        # boundary context: the region's edges must still be places where a segment may begin
        while start > 0 and not is_cut(text, start):
            lo -= 1
            start -= self.lengths[lo]
        while stop < len(text) and not is_cut(text, stop):
            stop += self.lengths[hi]
            hi += 1
        self.text = text
        fresh = segments(text[start:stop])
        counts, p = [], start
        for size in fresh:
            counts.append(self._encode(text[p:p + size]))
            p += size
        if len(fresh) == hi - lo:
            k = len(self.sums) // 2
            touched = set()
            for i, c in enumerate(counts, lo):
                self.sums[k + i] = c
                touched.add((k + i) // 2)
            while touched - {0}:  # the paths to the root
                for i in touched:
                    if i:
                        self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
                touched = {i // 2 for i in touched if i > 1}
            self.lengths[lo:hi] = fresh
        else:
            leaves = self.counts()
            leaves[lo:hi] = counts
            self.lengths[lo:hi] = fresh
            self._build(leaves)


def counter(paths=None):
    """Token count of a piece of text."""
    ids = encoder(paths)
    return lambda piece: len(ids(piece)) if piece else 0


TREE = "seg_lengths array<int>, tree_sums array<int>"


def _trees(it, paths, k):
    count = counter(paths)
    for batch in it:
        trees = [Tree(t or "", count) for t in batch.column(k).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.lengths for t in trees], pa.list_(pa.int32())), pa.array([t.sums for t in trees], pa.list_(pa.int32()))], names=[*batch.schema.names, "seg_lengths", "tree_sums"])


def build_trees(docs: DataFrame, edits=None, paths=None) -> DataFrame:
    """(doc_id, text, seg_lengths, tree_sums), with a column ``edits`` if ``edits`` (a column of an array of
    struct<at, deleted, inserted>) is given. ``tree_sums[1]`` is the document's token count."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), *([edits.cast("array<struct<at:int,deleted:int,inserted:string>>").alias("edits")] if edits is not None else []), F.col("text").cast("string").alias("text")]
    src = docs.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields)
    text_at = len(cols) - 1
    return src.mapInArrow(lambda it: _trees(it, paths, text_at), f"{schema}, {TREE}")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees joined with rows of edits (doc_id, seq, at, deleted, inserted), in the order of ``seq``."""
    per_doc = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "deleted", "inserted"))).alias("e"))
    per_doc = per_doc.select("doc_id", F.transform("e", lambda x: F.struct(x["at"].cast("int").alias("at"), x["deleted"].cast("int").alias("deleted"), x["inserted"].alias("inserted"))).alias("edits"))
    return trees.join(per_doc, "doc_id", "left")


EDITED = "doc_id long, text string, seg_lengths array<int>, tree_sums array<int>, tokens_before long, tokens_after long, reencoded_chars long, text_chars long"


def _apply(it, paths):
    count = counter(paths)
    for batch in it:
        out = []
        for doc, text, edits, lengths, sums in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "edits", "seg_lengths", "tree_sums")]):
            tree = Tree(text or "", count, lengths, sums)
            before = tree.total
            for e in edits or ():
                if e is not None:
                    tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
            out.append((doc, text if text is None and not tree.text else tree.text, tree.lengths, tree.sums, before, tree.total, tree.encoded, len(tree.text)))
        types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, types)], names=["doc_id", "text", "seg_lengths", "tree_sums", "tokens_before", "tokens_after", "reencoded_chars", "text_chars"])


def apply_edits(trees: DataFrame, paths=None) -> DataFrame:
    """The edited documents with their renewed trees, and how much was encoded again."""
    return trees.select("doc_id", "text", "edits", "seg_lengths", "tree_sums").mapInArrow(lambda it: _apply(it, paths), EDITED)

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: word counts hashed into ``buckets`` (log-scaled, unit length), statistics of its
structure (standardised, and as one bin each), and one bin for each metadata column. The machine scores
``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairs cost linear time by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Training takes a bounded sample of labelled rows (``rows`` of smallest hash, at most ``values`` sparse values): features are
computed where the texts are, the fit is one task, the model (some 2 MB whatever the corpus) is written to the
shared folder and broadcast. Scoring is one pass without a shuffle. A tenth of the sample is held back to choose the number of
passes. Labels, language, source and ids are never inputs of a score.

Defined cases: null and empty texts have no words and get a score like any other; a null doc_id has no label and is
not held out; repeated rows are scored each; a null metadata value has a bin of its own; without
labels of both classes every score is the share of label 1 (0.5 without labels); an empty table gives an empty result; other columns
are not read. Texts are read in pieces of about 1 MB: repeats of lines and of word triples are counted inside a piece.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

UPPER, LOWER, DIGITS, SYMBOLS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"#*$%&|<>"
STATS = ("log_words", "word_bytes", "upper", "digits", "symbols", "shouts", "distinct", "commonest", "echoes", "repeated_lines", "line_words", "stops", "triples", "marked_ends")
PIECE = 1 << 20


@dataclass(frozen=True)
class Machine:
    """Sizes and training parameters; ``rows`` and ``values`` bound the labelled sample."""

    buckets: int = 1 << 16
    factors: int = 8
    bins: int = 8
    metadata: tuple = ("n_chars",)
    rows: int = 6000
    values: int = 20_000_000
    epochs: int = 12
    patience: int = 2
    batch: int = 64
    rate: float = 0.05
    penalty: float = 1e-4
    seed: int = 7


def _pieces(text: bytes):
    """A text in pieces of about 1 MB, cut at a line end or a space."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(b"\n", at, at + PIECE), text.rfind(b" ", at + PIECE // 2, at + PIECE))
        end = cut + 1 if cut > at else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def text_features(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, values, statistics) of one whole text."""
    counts: Counter = Counter()
    n = chars = upper = letters = digits = symbols = shouts = stops = echoes = lines = repeated = triples = distinct3 = marked = 0
    for piece in _pieces(text):
        words = piece.split()
        n += len(words)
        counts.update(words)
        left = lambda cut: len(piece) - len(piece.translate(None, cut))
        up = left(UPPER)
        upper += up
        letters += up + left(LOWER)
        digits += left(DIGITS)
        symbols += left(SYMBOLS)
        shouts += piece.count(b"!")
        stops += left(b".,")
        chars += sum(map(len, words))
        echoes += sum(a == b for a, b in zip(words, words[1:]))
        marked += sum(w[-1] in b"#*$%&|<>!" for w in words)
        held = [x for x in piece.split(b"\n") if x]
        lines += len(held)
        repeated += len(held) - len(set(held))
        if len(words) > 2:
            triples += len(words) - 2
            distinct3 += len(set(zip(words, words[1:], words[2:])))
    d = max(n, 1)
    stats = np.array([np.log1p(n), chars / d, upper / max(letters, 1), digits / max(chars, 1), symbols / d, shouts / d, len(counts) / d, max(counts.values(), default=0) / d,
                      echoes / d, repeated / max(lines, 1), np.log1p(n / max(lines, 1)), stops / d, 1 - distinct3 / triples if triples else 0.0, marked / d])
    hashed: Counter = Counter()
    for w, c in counts.items():
        hashed[zlib.crc32(w.lower()) % buckets] += c
    at = np.fromiter(hashed.keys(), np.int32, len(hashed))
    x = np.log1p(np.fromiter(hashed.values(), np.float32, len(hashed)))
    order = np.argsort(at)
    return at[order], (x / max(float(np.sqrt((x * x).sum())), 1e-9))[order].astype(np.float32), stats


def meta_bin(value) -> int:
    """Bin 0: no value; else 1 + the binary order of magnitude, at most 39."""
    if value is None:
        return 0
    return 1 + min(38, int(np.log2(1 + max(0.0, float(value))))) if np.isfinite(float(value)) else 0


METAS = 40


class Encoder:
    """Turns statistics and metadata into features behind the word buckets; fitted on the sample's quantiles."""

    def __init__(self, stats: np.ndarray, m: Machine):
        self.m = m
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        self.edges = [np.unique(np.quantile(s, np.linspace(0, 1, m.bins + 1)[1:-1])) for s in stats.T]
        self.size = m.buckets + len(STATS) * (1 + m.bins) + len(m.metadata) * METAS

    def row(self, at: np.ndarray, x: np.ndarray, stats: np.ndarray, metas: list[int]) -> tuple[np.ndarray, np.ndarray]:
        first = self.m.buckets
        k = len(STATS)
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        bins = [first + k + i * self.m.bins + int(np.searchsorted(e, s, side="right")) for i, (e, s) in enumerate(zip(self.edges, stats))]
        metas = [first + k * (1 + self.m.bins) + i * METAS + v for i, v in enumerate(metas)]
        more = np.array([*range(first, first + k), *bins, *metas], np.int32)
        return np.concatenate([at, more]), np.concatenate([x, z, np.ones(len(bins) + len(metas))]).astype(np.float32)


class Model:
    """Bias, linear weights and factors."""

    def __init__(self, size: int, m: Machine):
        rng = np.random.default_rng(m.seed)
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.05, (size, m.factors)).astype(np.float32)

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of rows (rows begin at ``starts``), in linear time."""
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        q = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (s * s - q).sum(1)

    def copy(self):
        out = object.__new__(Model)
        out.bias, out.w, out.v = self.bias, self.w.copy(), self.v.copy()
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _joined(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(a) for a, _ in rows])
    return np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(sizes) - sizes


def fit(rows: list, y: np.ndarray, size: int, m: Machine) -> Model:
    """AdaGrad on the log loss in mini-batches; keeps the pass with the least loss on the tenth held back and ends
    after ``patience`` passes without clear progress."""
    rng = np.random.default_rng(m.seed)
    order = rng.permutation(len(rows))
    held, train = order[: len(rows) // 10], order[len(rows) // 10:]
    model = Model(size, m)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    model.bias = float(np.log(share / (1 - share)))
    gb, gw, gv = 1e-8, np.full(size, 1e-8, np.float32), np.full((size, m.factors), 1e-8, np.float32)
    best, least, waited = model.copy(), np.inf, 0
    for _ in range(m.epochs):
        rng.shuffle(train)
        for a in range(0, len(train), m.batch):
            part = train[a:a + m.batch]
            at, x, starts = _joined([rows[i] for i in part])
            row = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(at))))
            vx = model.v[at] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = model.bias + np.add.reduceat(model.w[at] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts, axis=0)).sum(1)
            g = (_sigmoid(z) - y[part]) / len(part)
            ids, inv = np.unique(at, return_inverse=True)
            by = np.argsort(inv, kind="stable")
            cut = np.searchsorted(inv[by], np.arange(len(ids)))
            gx = g[row] * x
            dw = np.add.reduceat(gx[by], cut) + m.penalty * model.w[ids]
            dv = np.add.reduceat((gx[:, None] * (s[row] - vx))[by], cut, axis=0) + m.penalty * model.v[ids]
            gb += float(g.sum()) ** 2
            model.bias -= m.rate * float(g.sum()) / np.sqrt(gb)
            gw[ids] += dw * dw
            model.w[ids] -= m.rate * dw / np.sqrt(gw[ids])
            gv[ids] += dv * dv
            model.v[ids] -= m.rate * dv / np.sqrt(gv[ids])
        watch = held if len(held) else train
        z = model.margins(*_joined([rows[i] for i in watch]))
        loss = float(np.mean(np.logaddexp(0, -z * (2 * y[watch] - 1))))
        waited += 1
        if loss < least:
            waited = 0 if loss < 0.98 * least - 1e-3 else waited
            best, least = model.copy(), loss
        if waited >= m.patience:
            break
    return best


def _metas(batch, names) -> list[list[int]]:
    return list(zip(*[[meta_bin(v) for v in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in names])) or [()] * batch.num_rows


def _texts(part, column: int):
    """Bytes of each text, empty for null."""
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(column))


def _columns(docs: DataFrame, m: Machine) -> list[Column]:
    metas = [(F.col(c).cast("double") if c in docs.columns else F.lit(None).cast("double")).alias(f"m{i}") for i, c in enumerate(m.metadata)]
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *metas]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, m: Machine = Machine()) -> tuple:
    """(encoder, model, share of label 1) from rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(~held_out(F.col("id")))
    sample = written(known.orderBy(F.xxhash64("id"), "id", "y").limit(m.rows), "sample")  # at most m.rows ids: broadcast
    rows = docs.select(*_columns(docs, m)).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).drop("id")
    names = [f"m{i}" for i in range(len(m.metadata))]

    def encode(batches):
        for batch in batches:
            for part in small_batches([batch], 1):
                y = part.column(part.schema.get_field_index("y")).to_pylist()
                ids = part.column(0).to_pylist()
                got = [(i, v, pickle.dumps((*text_features(t, m.buckets), list(e)))) for i, v, t, e in zip(ids, y, _texts(part, 1), _metas(part, names))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got) if got else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], ["id", "y", "row"])

    def learn(batches):
        sparse, y, total = [], [], 0
        for batch in batches:
            for label, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                row = pickle.loads(blob)
                total += len(row[0])
                if total <= m.values:
                    sparse.append(row)
                    y.append(label)
        out = (None, None, float(np.mean(y)) if y else 0.5)
        if 0 < sum(y) < len(y):
            encoder = Encoder(np.array([r[2] for r in sparse]), m)
            rows = [encoder.row(*r) for r in sparse]
            out = (encoder, fit(rows, np.array(y, np.float64), encoder.size, m), out[2])
        blob = pickle.dumps(out)
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["model"])

    encoded = written(rows.mapInArrow(encode, "id long, y int, row binary"), "encoded")
    one = encoded.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "y", "row")
    model = written(one.mapInArrow(learn, "model binary"), "model").first()
    return pickle.loads(model[0]) if model else (None, None, 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, m: Machine = Machine(), threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    encoder, model, share = train(docs, labels, m)
    names = [f"m{i}" for i in range(len(m.metadata))]
    shared = docs.sparkSession.sparkContext.broadcast((encoder, model))

    def score(batches):
        encoder, model = shared.value
        for batch in batches:
            for part in small_batches([batch], 1):
                if model is None or not part.num_rows:
                    got = np.full(part.num_rows, share)
                else:
                    got = _sigmoid(model.margins(*_joined([encoder.row(*text_features(t, m.buckets), list(e)) for t, e in zip(_texts(part, 1), _metas(part, names))])).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    out = docs.select(*_columns(docs, m)).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

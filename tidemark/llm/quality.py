"""Quality by attention-based multiple-instance learning: a document is a bag of encoded passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.llm.langid import held_out
from tidemark.llm.textvec import _cuts, texts_of, word_hashes
from tidemark.session import materialize

#: Words of a passage; the last passage of a text may be shorter.
PASSAGE = 64
#: Hashed words, pairs of character classes, and a few measures of repetition.
WORD_BUCKETS, CLASSES, MEASURES = 256, 16, 4
FEATURES = WORD_BUCKETS + CLASSES * CLASSES + MEASURES
#: The model is fitted on about so many labelled documents, taken by hash of the id as long as all of their passages are so
#: many at most. Documents of more than a twentieth of these aren't taken into the sample; of those taken every passage is encoded.
FIT_DOCS, FIT_PASSAGES = 2500, 30_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 128, 0.004, 1e-4
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """A class for each byte: blanks, line ends, vowels and consonants in both cases, digits, marks, other bytes."""
    told = np.full(256, 15, np.int32)
    told[list(b" \t\x0b\x0c\r")], told[list(b"\n")] = 0, 1
    for c in range(97, 123):
        vowel = chr(c) in "aeiou"
        told[c], told[c - 32] = (2 if vowel else 3), (4 if vowel else 5)
    told[48:58] = 6
    for k, marks in enumerate((b".", b",", b"!?", b"'\"", b"-_/\\|", b"#$%&*@^~", b"()[]{}<>", b":;=+")):
        told[list(marks)] = 7 + k
    return told


_CLASS = _classes()


def passages(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of every passage, part by part: the rows they belong to and a matrix."""
    for a, b in _cuts(data, bounds):
        first, last = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")
        inner = np.clip(bounds[first : last + 1], a, b) - a
        part = data[a:b]
        words, at = word_hashes(part, inner)
        counts = np.diff(at)
        bags = np.maximum(1, -(-counts // PASSAGE))
        base = np.concatenate([[0], np.cumsum(bags)])
        row = np.repeat(np.arange(len(counts)), counts)
        own = base[row] + (np.arange(len(words)) - at[row]) // PASSAGE
        total = int(base[-1])
        n = np.maximum(1, np.bincount(own, minlength=total))
        out = np.zeros((total, FEATURES), np.float32)
        hashed = np.bincount(own * WORD_BUCKETS + (words & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), minlength=total * WORD_BUCKETS)
        out[:, :WORD_BUCKETS] = hashed.reshape(total, -1) / n[:, None]
        # a byte belongs to the passage of the last word that began before it
        space = (part == 32) | ((part >= 9) & (part <= 13))
        opens = ~space
        opens[1:] &= space[:-1] | np.isin(np.arange(1, len(part)), inner)
        begun = np.cumsum(opens) - 1
        byte_row = np.searchsorted(inner, np.arange(len(part)), "right") - 1
        holder = np.where((begun >= at[byte_row]) & (counts[byte_row] > 0), own[np.clip(begun, 0, max(0, len(own) - 1))] if len(own) else 0, base[byte_row])
        kind = _CLASS[part]
        same = holder[1:] == holder[:-1]
        pairs = np.bincount((holder[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[same], minlength=total * CLASSES * CLASSES)
        length = np.maximum(1, np.bincount(holder, minlength=total))
        out[:, WORD_BUCKETS : WORD_BUCKETS + CLASSES * CLASSES] = pairs.reshape(total, -1) / length[:, None]
        if len(words):
            order = np.lexsort((words, own))
            fresh = np.ones(len(words), bool)
            fresh[1:] = (words[order][1:] != words[order][:-1]) | (own[order][1:] != own[order][:-1])
            repeated = np.zeros(len(words), bool)
            repeated[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
            out[:, -4] = np.bincount(own, minlength=total) / PASSAGE
            out[:, -3] = np.bincount(own[order][fresh], minlength=total) / n
            out[:, -2] = np.bincount(own[repeated], minlength=total) / n
            out[:, -1] = length / n / 10
        yield np.repeat(np.arange(len(counts)), bags) + first, out


@dataclass
class Model:
    """Encoder ``w, b``; gates ``v, u, k``; output ``c, d``. Features are centred and scaled within ``w`` and ``b``."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    k: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoded passages and their attention weights before they are divided by a document's sum."""
        h = np.tanh(x @ self.w + self.b)
        return h, np.exp((np.tanh(h @ self.v) / (1 + np.exp(-(h @ self.u)))) @ self.k)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The score of each text, from all of its passages: sums of weights and weighted encodings."""
        n = len(bounds) - 1
        total, weight = np.zeros((n, len(self.c))), np.zeros(n)
        seen = np.zeros(n, bool)
        for rows, x in passages(data, bounds):
            h, e = self.encode(x)
            for j in range(h.shape[1]):
                total[:, j] += np.bincount(rows, h[:, j] * e, n)
            weight += np.bincount(rows, e, n)
            seen[rows] = True
        h, e = self.encode(np.zeros((1, FEATURES), np.float32))
        total[~seen], weight[~seen] = h[0] * e[0], e[0]
        return 1 / (1 + np.exp(-np.clip(total / weight[:, None] @ self.c + self.d[0], -30, 30)))


def train(x: np.ndarray, docs: np.ndarray, labels: np.ndarray, seed: int = 13) -> Model:
    """Fit by Adam on mini-batches of documents. ``docs`` gives each passage's document, in ascending order.

    With labels of one kind only, or none, the model gives every text that label's score.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    if len(labels) == 0 or len(np.unique(labels)) < 2:
        flat = 4.0 if len(labels) and labels[0] else -4.0
        zero = Model(*(np.zeros(s, np.float32) for s in ((FEATURES, HIDDEN), HIDDEN, (HIDDEN, GATE), (HIDDEN, GATE), GATE, HIDDEN, 1)))
        zero.d[0] = flat
        return zero
    middle, spread = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
    x = ((x - middle.astype(np.float32)) / spread.astype(np.float32)).astype(np.float32)
    p = [rng.standard_normal(s) * scale for s, scale in (
        ((FEATURES, HIDDEN), 0.3 / FEATURES**0.5), (HIDDEN, 0), ((HIDDEN, GATE), 0.3), ((HIDDEN, GATE), 0.3), (GATE, 0.3), (HIDDEN, 0.3), (1, 0))]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    starts = np.searchsorted(docs, np.arange(len(labels) + 1))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            some = some[starts[some + 1] > starts[some]]
            if not len(some):
                continue
            rows = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in some])
            own = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
            grads = _gradients(p, x[rows], own, labels[some])
            step += 1
            for q, g, a, b in zip(p, grads, m, s):
                g = g + DECAY * q
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    w = p[0] / spread[:, None]
    return Model(*(q.astype(np.float32) for q in (w, p[1] - middle @ w, *p[2:])))


def _gradients(p, x, own, label):
    w, b, v, u, k, c, d = p
    h = np.tanh(x @ w + b)
    t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    e = np.exp((t * g) @ k)
    e /= np.bincount(own, e)[own]
    z = np.zeros((len(label), len(c)))
    np.add.at(z, own, e[:, None] * h)
    y = 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))
    dy = (y - label) / len(label)
    dz = dy[:, None] * c
    along = (h * dz[own]).sum(1)
    de = e * (along - np.bincount(own, e * along)[own])
    dt, dg = de[:, None] * k * g * (1 - t * t), de[:, None] * k * t * g * (1 - g)
    dh = (e[:, None] * dz[own] + dt @ v.T + dg @ u.T) * (1 - h * h)
    return x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ dy, np.array([dy.sum()])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learn ``labels.quality`` from a bounded sample of documents that aren't held out.

    Every passage of a document of the sample is encoded, in tasks, and only the sample's
    features come to the driver: at most FIT_PASSAGES rows of FEATURES numbers. Of several
    labels of a document the largest counts; labels other than 0 and 1 are ignored. Repeated
    rows of a document are passages of one bag. Without labelled documents every text gets
    the same score.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = materialize(known, "known-labels")
    share = min(1.0, fit_docs / max(1, known.count()))
    hashed = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000))
    chosen = materialize(known.where(hashed / 1e6 < share), "fit-labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about fit_docs rows
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    bags = sample.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(1), F.ceil(words / PASSAGE))).alias("n")).where(f"n <= {FIT_PASSAGES // 20}")
    order = Window.orderBy(hashed, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = materialize(bags.withColumn("n", F.sum("n").over(order)).where(f"n <= {FIT_PASSAGES}").select("doc_id"), "fit-documents")
    sample = sample.join(F.broadcast(taken), "doc_id")  # not more than about fit_docs ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, quality = batch["doc_id"].to_numpy(), batch["quality"].to_numpy()
            for rows, x in passages(*texts_of(batch["text"])):
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(quality[rows], pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    told = sample.mapInArrow(run, "doc_id long, quality int, x binary").toArrow()
    if not len(told):
        return train(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    ids = told["doc_id"].to_numpy()
    x = np.frombuffer(b"".join(told["x"].to_pylist()), np.float32).reshape(len(ids), FEATURES)
    order = np.lexsort((*x[:, -4:].T, ids))
    unique, own = np.unique(ids[order], return_inverse=True)
    label = np.zeros(len(unique))
    label[own] = told["quality"].to_numpy()[order]
    return train(x[order], own, label)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted`` of each whole text.

    Empty and null texts are scored as one passage without words, long ones from all of their
    passages; repeated rows each get the same score. Columns named score or predicted are
    replaced, all others stay; an empty table gives an empty result. The model (a few ten
    thousand numbers) is broadcast.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast([getattr(model, f.name) for f in fields(model)])

    @F.pandas_udf("double")
    def told(texts):
        import pandas as pd

        return pd.Series(Model(*shared.value).score(*texts_of(pa.array(texts, pa.large_string(), from_pandas=True))))

    return docs.withColumn("score", told("text")).select(*names, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

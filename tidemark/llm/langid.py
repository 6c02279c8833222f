"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import codes_of

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: The model is fitted on a bounded sample: about so many labelled documents of each language, by hash of the id.
FIT_DOCS = 3000
#: Characters turned into n-grams at once; what a long text gives is added up part by part.
PART = 200_000
#: Numbers of the log matrix that are gathered at once: a batch is scored in slices of so many n-grams times languages.
GATHERED = 1 << 22
UNDETERMINED = "und"

_STEP = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def held_out(doc_id) -> F.Column:
    """True for the fifth of the documents that nothing is learned from."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def letters(part: str, last: int) -> np.ndarray:
    """Code points of a part in lower case, every run of other characters than letters one blank; ``last`` came before it."""
    codes = codes_of(part.lower())
    codes = np.where(((codes >= 97) & (codes <= 122)) | (codes >= 128), codes, 32)
    before = np.concatenate([np.array([last], codes.dtype), codes[:-1]])
    return codes[(codes != 32) | (before != 32)]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, every one once, in parts: the last characters of a part go before the next."""
    kept = np.zeros(0, np.uint32)
    for at in range(0, len(text), PART):
        codes = letters(text[at : at + PART], int(kept[-1]) if len(kept) else 0)
        for n in ORDERS:
            own = np.concatenate([kept[max(0, len(kept) - n + 1) :], codes]) * np.uint32(2654435761)
            if len(own) >= n:
                h = np.full(len(own) - n + 1, n * 0x01000193, np.uint32)
                for k in range(n):
                    h = (h ^ own[k : k + len(h)]) * _STEP[k]
                yield (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)
        kept = np.concatenate([kept, codes])[1 - max(ORDERS) :]


def counted(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse matrix of a batch's n-gram counts (row, bucket, count), in slices that hold whole parts of texts."""
    keys, held = [], 0
    for row, text in enumerate(texts):
        for h in grams(text):
            keys.append(h.astype(np.int64) + row * BUCKETS)
            held += len(h)
            if held >= PART * len(ORDERS):
                yield _sparse(keys)
                keys, held = [], 0
    if keys:
        yield _sparse(keys)


def _sparse(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, times = np.unique(np.concatenate(keys), return_counts=True)
    return found // BUCKETS, found % BUCKETS, times


@dataclass
class Model:
    """``logs`` holds a row of log-probabilities for each bucket and a column for each language."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability; ``und`` and 0 if there is no letter.

        A batch is one sparse matrix of counts, multiplied by the log matrix slice by slice.
        Languages that are equally likely go by name, the smaller first.
        """
        known = np.array([bool(t) and bool(self.languages) and any(map(str.isalpha, t)) for t in texts], bool)
        total = np.tile(self.prior, (len(texts), 1))
        for row, bucket, times in counted(t if k else "" for t, k in zip(texts, known)):
            for i in range(0, len(row), step := max(1, GATHERED // max(1, len(self.languages)))):
                r = row[i : i + step]
                starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                part = self.logs[bucket[i : i + step]] * times[i : i + step, None]
                total[r[starts]] += np.add.reduceat(part, starts, axis=0, dtype=np.float64)
        if not known.any():
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = np.exp(total - total.max(1, keepdims=True))
        best = p.argmax(1)
        score = np.where(known, 1 / p.sum(1), 0.0)
        return [self.languages[j] if k else UNDETERMINED for j, k in zip(best, known)], score


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learn from the text and non-null lang of documents that aren't held out.

    Languages are weighed by their number of documents; n-grams are counted in Spark tasks,
    summed there, added up by (language, bucket) in a shuffle, and only the matrix comes to
    the driver: every language that has a label has a column (256 kB as broadcast), so the
    model grows with the number of languages and not with that of documents. Null texts
    count as empty, long ones are read whole, repeated rows count as often as they stand. No
    labelled document or an empty table gives a model without languages.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())  # one row per language
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    languages = [k for k, _ in sizes]
    coin = F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in sizes for v in (k, min(1.0, fit_docs / n))]), F.col("lang"))
    sample = labelled.where(coin < share).select("lang", "text")
    counts = (
        sample.mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {k: i for i, k in enumerate(languages)}
    column = np.array([place[k] for k in counts["lang"].to_pylist()], int)
    table[counts["bucket"].to_numpy(), column] += counts["n"].to_numpy()
    number = np.array([n for _, n in sizes], float)
    return Model(languages, np.log(number / number.sum()), np.log(table / table.sum(0)).astype(np.float32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            for h in grams(text or ""):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(h, minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.record_batch({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "n": n[at]})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of the whole text; columns of such names are replaced, all others stay.

    The matrix is broadcast once. A null, empty or letterless text gets ``und`` and score 0; a
    long one is read whole. Equally likely languages go by name; repeated rows each get the
    same answer. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        languages, scores = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": languages, "score": scores})

    kept = docs.drop("lang_pred", "score")
    own = "told"
    while own in kept.columns:
        own += "_"
    told = kept.withColumn(own, predict("text"))
    return told.select(*[F.col(f"`{c}`") for c in kept.columns], f"{own}.lang_pred", f"{own}.score")


def filter_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language a model learned from ``docs`` can tell; ``und`` and unsure ones go.

    Null, empty and letterless texts go, with them all rows if no document has a label; repeated
    rows stay or go together. All columns are kept, those named lang_pred or score too.
    """
    model, names = fit(docs), docs.columns
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole"))
    told = identify(packed, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return told.select("whole.*")

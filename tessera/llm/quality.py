"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Features are uni- and bigrams of lower-cased words and of word shapes, hashed to
``2**bits`` slots; a score is a sparse dot product.  Training reads at most
``max_train`` labelled rows (those with the smallest hash of doc_id), a fixed
bound, so the driver's part does not grow with the corpus; scoring covers every
whole text inside Arrow batches without a shuffle.

Defined results: null and empty texts have no features and score the intercept;
rows with a null label teach nothing; with no labelled rows at all every score is
0.5; repeated rows each get a result row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import linear as L
from tessera.llm import scratch as S


def fold(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_train: int, folds: int, held_out: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_train`` labelled rows outside the held-out fold."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    chosen = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return S.texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")  # at most max_train rows; of texts that share a doc_id the least


class QualityClassifier:
    def __init__(self, bits: int = 18, max_train: int = 8000, epochs: int = 4, alpha: float = 1.0, l1: float = 0.02):
        self.bits, self.max_train, self.epochs, self.alpha, self.l1 = bits, max_train, epochs, alpha, l1
        self.weights, self.intercept = np.zeros(1 << bits, np.float32), 0.0

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2) -> QualityClassifier:
        bits = self.bits

        def features(rows):
            for first, end, data, offsets in K.pieces(rows.column(1)):
                doc, feature = L.style_features(data, offsets)
                d, slot, value = L.normalised(doc, feature, bits, end - first)
                counts = np.bincount(d, minlength=end - first)
                yield S.batch(doc_id=rows.column(0).slice(first, end - first), label=rows.column(2).slice(first, end - first), slots=K.list_array(slot, counts), vals=K.list_array(value, counts))

        sample = labelled_sample(docs, labels, label, self.max_train, folds, held_out)
        table = S.arrow_map(sample, features, "doc_id long, label int, slots array<int>, vals array<float>").toArrow()
        ids, target, rows, size = table.column("doc_id").to_numpy(), table.column("label").to_numpy(), [], []
        for part in table.to_batches():
            slots, vals = part.column("slots"), part.column("vals")
            at, s, v = slots.offsets.to_numpy(), slots.values.to_numpy(), vals.values.to_numpy()
            rows += [(s[a:b], v[a:b]) for a, b in zip(at[:-1], at[1:])]
            size += np.diff(at).tolist()
        rows = [(*rows[i], float(target[i])) for i in np.lexsort((size, ids))]
        if rows:
            self.weights, self.intercept = L.train_ftrl(rows, bits, alpha=self.alpha, l1=self.l1, epochs=self.epochs)
        del table, rows
        S.release()
        return self

    def _scores(self, model):
        bits, intercept = self.bits, self.intercept

        def scores(texts) -> np.ndarray:
            out = [np.zeros(0)]
            for first, end, data, offsets in K.pieces(texts):
                d, slot, value = L.normalised(*L.style_features(data, offsets), bits, end - first)
                out.append(L.sigmoid(intercept + np.bincount(d, model.value[slot] * value, minlength=end - first)))
            return np.concatenate(out)

        return scores

    def keep(self, docs: DataFrame, least: float) -> DataFrame:
        """The rows of ``docs`` that score ``least`` or more, with all their columns."""
        scores = self._scores(docs.sparkSession.sparkContext.broadcast(self.weights))
        at = docs.columns.index("text")

        def run(rows):
            yield rows.filter(S.pa.array(scores(rows.column(at)) >= least))

        return S.arrow_map(docs, run, docs.schema)

    def score(self, docs: DataFrame, *keep: str) -> DataFrame:
        """doc_id, the columns of ``keep``, and ``score``."""
        scores = self._scores(docs.sparkSession.sparkContext.broadcast(self.weights))  # 2**bits floats

        def run(rows):
            kept = {c: rows.column(i + 2) for i, c in enumerate(keep)}
            yield S.batch(doc_id=rows.column(0), score=scores(rows.column(1)), **kept)

        types = dict(docs.dtypes)
        return S.arrow_map(S.texts_of(docs, *keep), run, "doc_id long, score double" + "".join(f", `{c}` {types[c]}" for c in keep))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """doc_id, held_out (false for a null doc_id), score, predicted."""
    scored = QualityClassifier(**params).fit(docs, labels).score(docs)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

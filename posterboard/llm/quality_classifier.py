"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A word here is a run of letters and digits or a run of other signs, as written (case counts). Word 1- and 2-grams are hashed
into 2**BITS weights. The training rows, a bounded sample of the labelled ones, are dealt into SHARDS groups by hash; each
group's task runs FTRL-proximal over them and the weights of all are averaged. Scoring is a sparse dot product per document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table

BITS = 18
#: The bound on labelled rows that are learnt from: those with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
SHARDS = 4
EPOCHS = 4
#: FTRL-proximal: step size, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
SCALE = 4.0
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MASK = (1 << BITS) - 1


class Hasher:
    """Feature places of a text; words' hashes are kept, up to a bound."""

    def __init__(self, bound: int = 200_000):
        self.known: dict[str, int] = {}
        self.bound = bound

    def words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for w in _TOKEN.findall(text):
            h = known.get(w)
            if h is None:
                if len(known) >= self.bound:
                    known.clear()
                h = known[w] = zlib.crc32(w.encode("utf-8", "replace"))
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places and their values: counts, with the length of the vector made SCALE. An empty text has none."""
        one = self.words(text or "")
        two = one[1:] + one[:-1] * np.uint64(0x9E3779B97F4A7C15)
        both = np.concatenate([one * np.uint64(0xFF51AFD7ED558CCD), two * np.uint64(0xC4CEB9FE1A85EC53)])
        places, counts = np.unique((both >> np.uint64(40)) & np.uint64(_MASK), return_counts=True)
        return places.astype(np.int64), counts * (SCALE / max(1.0, np.sqrt(float(counts @ counts))))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal over rows of (places, values, label); the last weight is the bias."""
    z, n = np.zeros(_MASK + 2), np.zeros(_MASK + 2)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for places, values, label in rows:
            at, x = np.append(places, _MASK + 1), np.append(values, 1.0)
            w = weights(at)
            g = (_sigmoid(float(w @ x)) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(_MASK + 2))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """Averaged weights. docs: doc_id, text; labels: doc_id, quality (0 or 1; others are left out).

    Of repeated labels of one document the lowest counts. Without any labelled row all weights are 0, so each score is 0.5.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        hasher = Hasher()
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable")
        return pd.DataFrame({"w": [ftrl([(*hasher.features(t), int(q)) for t, q in zip(pdf["text"], pdf["quality"], strict=True)]).astype("<f4").tobytes()], "rows": [len(pdf)]})

    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)), "order": F.xxhash64(F.lit(7), F.col("doc_id"))})
    fitted = rows.groupBy("shard").applyInPandas(fit, "w binary, rows long").collect()  # SHARDS rows of 2**BITS floats
    if not fitted:
        return np.zeros(_MASK + 2, dtype=np.float32)
    parts = np.array([np.frombuffer(r["w"], "<f4") for r in fitted])
    return np.average(parts, axis=0, weights=[r["rows"] for r in fitted]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds score (0 to 1) to docs, which needs text. A null or empty text is scored by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 floats
    cols = [c for c in docs.columns if c != "score"]

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, w = Hasher(), shared.value
        for batch in texts:
            out = []
            for t in batch:
                at, x = hasher.features(t)
                out.append(_sigmoid(float(w[at] @ x) + float(w[-1])))
            yield pd.Series(out, dtype="float64")

    return docs.select(*cols, scores("text").alias("score"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    out = score(docs, train(docs, learn))
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

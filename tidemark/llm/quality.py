"""Quality scores from compressed sizes.

Two zstandard dictionaries hold labelled texts, one good and one bad. A text is compressed with
each; how many bytes the good one saves, per byte of the text, says which it resembles. A logistic
curve fitted on other labelled texts turns that difference into a probability.

The model is made from a bounded sample of labelled rows, which is collected; every text is then
scored where it is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, texts

FOLDS = 5
HELD_OUT_FOLD = 0
THRESHOLD = 0.3

# The labelled sample: so many rows of each class for the dictionaries and again for the
# calibration, in the order of a seeded hash, of texts up to so many bytes.
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 64 << 10
SEED = 2
DICTIONARY_BYTES = 1_000_000
LEVEL = 12


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic curve over the difference of compressed sizes."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = LEVEL

    def scorer(self):
        """A function from a text to its score; holds the prepared dictionaries."""
        compressors = [_compressor(d, self.level) for d in (self.good, self.bad)]

        def score(text: str | None) -> float:
            z = self.slope * _difference((text or "").encode(), *compressors) + self.offset
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return score


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    options = {"level": level, "write_content_size": False, "write_dict_id": False}
    if not content:
        return zstandard.ZstdCompressor(**options)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=held, **options)


def _difference(raw: bytes, good, bad) -> float:
    """Bytes saved by the good dictionary over the bad one, per byte; 0 for nothing."""
    if not raw:
        return 0.0
    return (len(bad.compress(raw)) - len(good.compress(raw))) / len(raw)


def _dictionary(samples: list[str], size: int) -> bytes:
    """Whole texts, as many as fit; the first ones end up nearest to what is compressed."""
    chosen, total = [], 0
    for raw in (text.encode() for text in samples):
        if total + len(raw) + 1 > size:
            continue
        chosen.append(raw)
        total += len(raw) + 1
    return b"\n".join(reversed(chosen))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small pull to 0 that keeps them finite."""
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.array([0.0, math.log(share / (1 - share))])
    if len(set(y.tolist())) < 2 or x.std() == 0:
        return 0.0, float(w[1])
    scale = x.std()
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        pull = np.diag([1e-2, 1e-6])
        gradient = design.T @ (y - p) - pull @ w
        curve = (design * (p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    level: int = LEVEL,
) -> Model:
    """The model from labelled rows outside the held-out fold.

    Ids with null or contradicting labels are left out. Without labels of one class its
    dictionary is empty; without any label every score is 1/2.
    """
    clear = (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_other"))
        .filter(F.col("_label").isin(0, 1) & (F.col("_label") == F.col("_other")))
        .filter(fold(id_col, FOLDS) != HELD_OUT_FOLD)
        .select(id_col, "_label", F.xxhash64(F.col(id_col), F.lit(SEED)).alias("_place"))
    )
    chosen = [
        clear.filter(F.col("_label") == label).orderBy("_place", id_col).limit(2 * sample_rows)
        for label in (0, 1)
    ]
    # At most 4 * sample_rows narrow rows.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    source = documents.select(id_col, F.col(text_col).cast("string").alias("_text"))
    rows = (
        source.join(picked, id_col)
        .filter(F.octet_length("_text").between(1, sample_bytes))
        .dropDuplicates([id_col])
        .select("_label", "_place", "_text")
        .toPandas()
        .sort_values("_place")
    )
    by_label = [rows[rows["_label"] == label]["_text"].tolist() for label in (0, 1)]
    halves = [(own[::2], own[1::2]) for own in by_label]
    bad, good = (_dictionary(first, dictionary_bytes) for first, _ in halves)
    compressors = [_compressor(d, level) for d in (good, bad)]
    rest = [(text, label) for label, (_, second) in enumerate(halves) for text in second]
    x = np.array([_difference(text.encode(), *compressors) for text, _ in rest])
    y = np.array([label for _, label in rest], dtype=float)
    slope, offset = _logistic(x, y)
    # The classes were sampled alike; the curve is for their shares among all labels.
    shares = dict(clear.groupBy("_label").count().collect())
    if 0 < y.sum() < len(y) and len(shares) == 2:
        offset += math.log(shares[1] / shares[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, slope, offset, level)


def score_documents(
    documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row from its whole text.

    Null and empty texts get the score of no difference. Rows without id are in fold 0, so held
    out. Repeated rows get equal scores; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            scores = pa.array(list(map(score, texts(batch, 2))), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), scores], names=[id_col, "held_out", "score"]
            )

    kind = documents.schema[id_col].dataType.simpleString()
    held_out = (fold(id_col, FOLDS) == HELD_OUT_FOLD).alias("held_out")
    scored = documents.select(id_col, held_out, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from its own features and its neighbours'; the marginals of
forward-backward, weighted by line length, give the text's quality. Training texts carry one label
for all their lines. The field is fitted on the driver on a bounded sample of labelled texts
(``sample_docs`` of them, ``sample_lines`` lines of each); every text is scored in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import byte_words as bw
from tokenloom.llm import line_features as lf
from tokenloom.llm.components import text_batches
from tokenloom.llm.context_tree import held_out

SAMPLE_DOCS, SAMPLE_LINES = 4000, 200
ROUNDS, PENALTY, THRESHOLD = 300, 1e-4, 0.3
FOLDS = 5


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES,
              folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and step scores, learned from labelled rows whose id's crc32 is no multiple of ``folds``.

    The sample takes the ids of smallest hash, and of a longer text a run of lines from its middle.
    Null ids and labels teach nothing; of several labels for an id the majority counts, ties as good.
    Without labelled texts all weights are zero, so that every score is one half.
    """
    text_batches(docs.sparkSession)
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    told = told.where(~held_out(F.col("id"), folds)).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = told.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, data, offsets in bw.slices(batch.column(1)):
                features, _, first = lf.line_features(data, offsets)
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b - a > sample_lines:
                        a += (b - a - sample_lines) // 2
                        b = a + sample_lines
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[low + i].as_py()], pa.int32()), pa.array([b - a], pa.int32()),
                         pa.array([features[a:b].astype(np.float64).tobytes()], pa.binary())], ["label", "lines", "features"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most sample_docs ids: their number does not grow with the input.
    sample = texts.join(F.broadcast(chosen), "id").select("label", "text").where("text is not null")
    table = sample.mapInArrow(run, "label int, lines int, features binary").limit(2 * sample_docs).toArrow()
    if not table.num_rows:
        return np.zeros(3 * lf.WIDTH), np.zeros((2, 2))
    order = sorted(range(table.num_rows), key=lambda i: (table["features"][i].as_py(), table["label"][i].as_py()))
    table = table.take(pa.array(order))  # the same sums whatever order the rows came in
    features = np.concatenate([np.frombuffer(v.as_py(), np.float64).reshape(-1, lf.WIDTH) for v in table["features"]])
    first = np.append(0, np.cumsum(table["lines"].to_numpy()))
    return lf.fit(features, first, table["label"].to_numpy(), ROUNDS, PENALTY)


def score_quality(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = (), threshold: float = THRESHOLD, with_lines: bool = False) -> DataFrame:
    """``id_col``, the columns in ``keep``, score, predicted and, if asked for, line_scores.

    A null text is empty; an empty text is one empty line. Repeated rows and null ids keep a row each.
    """
    text_batches(docs.sparkSession)
    weight, step = field
    names = list(dict.fromkeys([id_col, *keep]))
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, data, offsets in bw.slices(batch.column(0)):
                scores, good, first = lf.quality(data, offsets, weight, step)
                columns = [batch.column(i + 1).slice(low, len(scores)) for i in range(len(names))]
                columns += [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                if with_lines:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(good)))
                yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted", "line_scores"][:len(columns)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    schema += ", score double, predicted int" + (", line_scores array<double>" if with_lines else "")
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with the columns they have.

    Texts go to Python, one answer a row comes back.
    """
    text_batches(docs.sparkSession)
    weight, step = field

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        scores = [lf.quality(data, offsets, weight, step)[0] for _, data, offsets in bw.slices(texts)]
        return pa.array(np.concatenate(scores) >= threshold) if scores else pa.array([], pa.bool_())

    return docs.where(good(F.col(text_col).cast("string")))

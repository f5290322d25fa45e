"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (bytes, words, lines, repetition) feed boosted
trees in flat arrays, traversed for a whole batch at once.  The model learns
from at most ``train_rows`` labelled documents, those with the least hash of
their id, which are joined to the documents as a bounded broadcast; an id and
label count once however often they occur, and of the documents of a repeated id
the one with the least statistics is learned from; ids in the
fold ``crc32(id) % 5 = 0`` are never learned from.  Language, source and id are
no inputs.

Defined results: null text counts as empty, and an empty text is scored like any
other; labels with null id or quality are ignored; a null id is never held out;
repeated rows score alike; with no labels, or labels of one class, every score is
the smoothed share of ones; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm.common import batch_of, columns_of, free_name, map_rows, text_or_empty
from quarry.llm.trees import Boosted, fit_boosted
from quarry.session import ship_package

TRAIN_ROWS = 10_000
THRESHOLD = 0.3
FOLDS = 5

STATISTICS = (
    "log_words", "word_bytes", "longest_word", "upper", "digits", "symbols", "bangs", "punctuation", "bars", "other_bytes",
    "distinct_words", "distinct_pairs", "line_words", "repeated_lines", "symbol_ends", "bang_ends", "capital_words",
    "alpha_words", "byte_entropy", "stops")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256)
    t[list(chars)] = 1
    return t


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_SYMBOL, _PUNCT = _table(b"#*$%&|<>@^~=+_\\{}[]"), _table(b".,;:?!'\"()-/")
_HIGH, _STOP = _table(bytes(range(128, 256))), _table(b".?!")
_SYMBOL_BYTES, _BANG = frozenset(b"#*$%&|<>"), ord("!")


def statistics(text: str) -> list[float]:
    """The document's statistics, in the order of STATISTICS."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0)),
        counts @ _UPPER / size, counts @ _DIGIT / size, counts @ _SYMBOL / n, counts[_BANG] / n, counts @ _PUNCT / n,
        counts[124] / n, counts @ _HIGH / size,
        len(set(words)) / n, len(set(zip(words, words[1:]))) / max(n - 1, 1), min(n / m, 1000.0), 1 - len(set(lines)) / m,
        sum(w[-1] in _SYMBOL_BYTES for w in words) / n, sum(w[-1] == _BANG for w in words) / n,
        sum(w[0] < 91 and w[0] > 64 for w in words) / n, sum(map(bytes.isalpha, words)) / n,
        float(-(p * np.log2(p)).sum()), counts @ _STOP / n]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", n_trees: int = 60, rate: float = 0.15, max_depth: int = 4) -> Boosted:
    """Fit on at most ``train_rows`` labels outside the held-out fold."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
              .filter("id IS NOT NULL AND y IS NOT NULL").filter(~held_out("id")).distinct()
              .orderBy(F.xxhash64("id"), "id", "y").limit(train_rows))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            kind = pa.schema([("id", batch.column(0).type), ("x", pa.list_(pa.float64())), ("y", pa.int32())])
            text, y = columns_of(batch, "text", "y")
            yield batch_of(kind, batch.column(0), [statistics(t) for t in text], y)

    joined = texts.join(F.broadcast(chosen), "id").select("id", "text", "y")
    rows = (map_rows(joined, run, f"id {joined.schema['id'].dataType.simpleString()}, x array<double>, y int")
            .groupBy("id", "y").agg(F.min("x").alias("x")).collect())
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(STATISTICS))
    y = np.array([r.y for r in rows], dtype=float)
    order = np.lexsort([*x.T, y]) if len(rows) else []  # the same model whatever order the rows came in
    return fit_boosted(x[order], y[order], n_trees, rate, max_depth) if len(rows) else Boosted(0.0, rate, ())


def score_column(docs: DataFrame, model: Boosted, text_col: str = "text") -> Column:
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(matrix(texts.to_pylist())), type=pa.float64())

    return score(text_or_empty(text_col))


def classify(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    d = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return (d.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(d, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, model: Boosted, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    tmp = free_name(docs, "quality_score")
    return docs.withColumn(tmp, score_column(docs, model, text_col)).filter(F.col(tmp) >= threshold).drop(tmp)

"""Problem 4: frequency of every distinct term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms counted in local arrays, and rows looked at to find them. Both change the work, never the counts.
HEAVY_TERMS = 4096
SAMPLE_ROWS = 20_000
BREAKS = "[ \t\n\r\u00a0]+"
_OUT = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("n_rows", pa.int64())])


def _batch_counts(texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of a batch, how often each occurs and in how many rows."""
    parts = pc.split_pattern_regex(texts, pattern=BREAKS)
    flat, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    occurrences = np.bincount(code, minlength=len(terms))
    once = np.unique(row.astype(np.int64) * max(1, len(terms)) + code)
    n_rows = np.bincount(once % max(1, len(terms)), minlength=len(terms))
    real = pc.not_equal(terms, "").to_numpy(zero_copy_only=False).astype(bool)
    return terms.filter(pa.array(real)), occurrences[real], n_rows[real]


def _counter(heavy: list[str]):
    def run(batches):
        known = pa.array(heavy, pa.string())
        local = np.zeros((len(heavy), 2), np.int64)
        for batch in batches:
            terms, occurrences, n_rows = _batch_counts(batch.column(0).cast(pa.string()))
            at = pc.index_in(terms, known)
            light = at.is_null().to_numpy(zero_copy_only=False)
            where = at.fill_null(0).to_numpy(zero_copy_only=False)[~light]
            local[where, 0] += occurrences[~light]
            local[where, 1] += n_rows[~light]
            yield pa.RecordBatch.from_arrays(
                [terms.filter(pa.array(light)), pa.array(occurrences[light], pa.int64()), pa.array(n_rows[light], pa.int64())], schema=_OUT
            )
        seen = local[:, 0] > 0
        yield pa.RecordBatch.from_arrays([known.filter(pa.array(seen)), pa.array(local[seen, 0]), pa.array(local[seen, 1])], schema=_OUT)

    return run


def _texts(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).cast("string").alias("text")).where("text is not null")


def heavy_terms(rows: DataFrame, column: str, n_rows: int, limit: int = HEAVY_TERMS, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """At most `limit` terms that are frequent in a sample of about sample_rows rows."""
    texts = _texts(rows, column)
    if n_rows > sample_rows:
        texts = texts.sample(sample_rows / n_rows, seed=7)
    counts = texts.mapInArrow(_counter([]), "term string, occurrences long, n_rows long").groupBy("term").agg(F.sum("n_rows").alias("n"))
    return [r[0] for r in counts.where("n > 4").orderBy(F.desc("n"), "term").limit(limit).collect()]


def term_counts(rows: DataFrame, column: str, n_rows: int | None = None, limit: int = HEAVY_TERMS) -> DataFrame:
    """(term, occurrences, n_rows): how often each term of a column occurs, and in how many rows.

    A term is a maximal run of characters other than blank, tab, line feed, carriage return and U+00A0, taken as it is. All rows count,
    repeated ones too; null values and values without a term give nothing. Heavy terms are added up in one array per task and leave it as
    one row per task; all others are folded per batch and again before the shuffle, and both meet in one sum.
    """
    n_rows = _texts(rows, column).count() if n_rows is None else n_rows
    heavy = heavy_terms(rows, column, n_rows, limit)
    counted = _texts(rows, column).mapInArrow(_counter(heavy), "term string, occurrences long, n_rows long")
    return counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows"))


def marked_terms(rows: DataFrame, column: str, rare_below: int = 3, common_share: float = 0.125) -> DataFrame:
    """(term, occurrences, n_rows, mark): mark is rare for a term in fewer than rare_below rows, else common for one in more than
    common_share of the rows whose value is not null, else null. An empty table has no terms."""
    n = _texts(rows, column).count()
    mark = F.when(F.col("n_rows") < rare_below, "rare").when(F.col("n_rows") > n * common_share, "common")
    return term_counts(rows, column, n).withColumn("mark", mark)

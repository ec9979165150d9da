"""Quality rules as weak supervision: rules vote or abstain, and a posterior takes the place of all-must-pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.llm import signals
from arborlog.llm.common import pinned, sliced, small_batches
from arborlog.llm.weak import VoteModel, pattern_code, pattern_votes

VOTERS = len(signals.RULES)
_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SLICE = 8 << 20


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, votes long) for each row: what the rules say of each whole text, votes coded in base 3."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in sliced(b, 1, _SLICE):
                c, _, _ = signals.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c[k], pa.int64()) for k in _OUT), pa.array(signals.base_failed(c)), pa.array(pattern_code(signals.votes(c)), pa.int64())], ["doc_id", *_OUT, "base_failed", "votes"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in _OUT)}, base_failed boolean, votes long")


def fit_votes(table: DataFrame) -> tuple[VoteModel, list[int]]:
    """The vote model over all rows, from the number of rows of each vote pattern: at most 3 ** VOTERS (19,683) numbers."""
    found = table.groupBy("votes").count().collect()
    codes = np.array([r["votes"] for r in found], dtype=np.int64)
    return VoteModel(pattern_votes(codes, VOTERS).reshape(-1, VOTERS), np.array([r["count"] for r in found], dtype=float)), codes.tolist()


def with_posterior(table: DataFrame) -> DataFrame:
    """The table with the posterior probability of good quality for each row. Broadcasts one number for each pattern."""
    model, codes = fit_votes(table)
    good = model(pattern_votes(np.array(codes, dtype=np.int64), VOTERS).reshape(-1, VOTERS))
    said = table.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, good)], "votes long, quality double")
    return table.join(F.broadcast(said), "votes")


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Which documents to keep, for each row of docs(doc_id, text, ...).

    -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.
    Each rule votes good, bad or abstains; expectation-maximisation over all rows' vote patterns
    estimates each rule's accuracy in both classes (``VoteModel``); quality is the posterior, and kept means that
    it is at least ``least`` and the base rules hold. No single rule decides.

    Null or empty text: no words, base_failed. Repeated rows each get a row, and count each in the fit.
    Null doc_id: kept as it is. Empty table: no rows.
    """
    table = pinned(vote_table(docs))
    return with_posterior(table).select("doc_id", *_OUT, "base_failed", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), "quality")

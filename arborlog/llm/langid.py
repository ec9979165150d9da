"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlog.llm.common import small_batches

#: Hash buckets of n-grams, and their lengths.
BUCKETS, GRAMS = 1 << 15, (1, 2, 3)
#: About so many labelled rows are fitted on, picked by a hash of doc_id and text; a documented bound.
FIT_ROWS = 20_000
#: Of each language about so many rows at least, or all that it has, whatever the share of the others.
LEAST_ROWS = 200
#: So many languages have BUCKETS buckets each, which bounds the matrix at MOST_LANGS * BUCKETS * 4 bytes (32 MB). Each doubling
#: halves the buckets, down to LEAST_BUCKETS; still more languages than that leaves room for (8,192) are refused.
MOST_LANGS, LEAST_BUCKETS = 256, 1 << 10
#: Characters that are scored at a time, and languages.
CHARS, COLUMNS = 1 << 17, 16
_LETTER = re.compile(r"[^\W\d_]")
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None and any(map(str.isalpha, text)))


def characters(text: str) -> np.ndarray:
    """Code points in lower case; digits are one character, white space and controls another."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    c[(c >= 48) & (c <= 57)] = 48
    c[c <= 32] = 32
    return c


def buckets(c: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n characters that start at each place where n are left."""
    h = np.zeros(max(0, len(c) - n + 1), dtype=np.uint32)
    for j in range(n):
        h += c[j : len(c) - n + 1 + j] * _MULT[j]
    x = h ^ (h >> np.uint32(15))
    return ((x * np.uint32(0x2C1B3C6D) + np.uint32(n)) >> np.uint32(17)).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """Counts of the whole text's n-grams by bucket."""
    out, c = np.zeros(BUCKETS, dtype=np.int64), characters(text)
    for i in range(0, len(c), 1 << 20):  # n-grams are taken over all places; a slice reads on into the next
        for n in GRAMS:
            out += np.bincount(buckets(c[i : i + (1 << 20) + n - 1], n), minlength=BUCKETS)
    return out


def folded(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of BUCKETS buckets in fewer: by the first bits of the same hash."""
    return counts if len(counts) == buckets else counts.reshape(buckets, -1).sum(axis=1)


def buckets_for(langs: int) -> int:
    n = BUCKETS
    while langs * n > MOST_LANGS * BUCKETS:
        n //= 2
    if n < LEAST_BUCKETS:
        raise ValueError(f"{langs} languages are more than the {MOST_LANGS * BUCKETS // LEAST_BUCKETS} that can be told apart")
    return n


class Model:
    """Log probabilities of buckets (rows) by language (columns), and log priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32)
        self.prior = np.log((docs + 1.0) / (docs + 1.0).sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log prior plus the log probabilities of all n-grams, for each text (row) and language (column), of a batch at once.

        Only the buckets that occur are looked up, place by place; sums are in double precision. Long texts take several turns.
        """
        out = np.tile(self.prior, (len(texts), 1))
        parts = [characters(t) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(c) for c in parts])]).astype(np.int64)
        c = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        shift = np.int64(BUCKETS // max(1, len(self.logp)))
        for lo in range(0, len(c), CHARS):
            hi = min(len(c), lo + CHARS)
            first, last = int(np.searchsorted(at, lo, side="right")) - 1, int(np.searchsorted(at, hi, side="left"))
            for n in GRAMS:
                b = buckets(c[lo : hi + n - 1], n) // shift
                # places of this turn whose n characters are in one text, by text
                begin = np.clip(at[first:last], lo, hi) - lo
                end = np.clip(at[first + 1 : last + 1] - n + 1, lo, hi) - lo
                some = np.flatnonzero(end > begin)
                if len(some) == 0:
                    continue
                cut = np.stack([begin[some], end[some]], axis=1).ravel()
                cut = cut[:-1] if cut[-1] >= len(b) else cut
                for k in range(0, len(self.langs), COLUMNS):
                    out[first + some, k : k + COLUMNS] += np.add.reduceat(self.logp[b, k : k + COLUMNS], cut, axis=0, dtype=np.float64)[::2]
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, posteriors) of a batch. Ties: the first language in order of code points. ``und`` and 0 without a letter."""
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if some:
            x = self.scores([texts[i] for i in some])
            best = x.argmax(axis=1)
            score[some] = 1.0 / np.exp(x - x[np.arange(len(some)), best][:, None]).sum(axis=1)
            for i, k in zip(some, best.tolist()):
                lang[i] = self.langs[k]
        return lang, score

    def __call__(self, text: str | None) -> tuple[str, float]:
        lang, score = self.judge([text])
        return lang[0], float(score[0])


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on about ``rows`` rows with a lang and a text, of those that are not held out, picked by a hash of doc_id and text.

    Each language gives its share of them, but at least about LEAST_ROWS, or all that it has: a rare one is learned however large the
    others are. A language without any text isn't listed. Each partition adds up a (language, bucket) table, the tables
    are summed by Spark, and the driver gets at most MOST_LANGS * BUCKETS sums, whatever the number of languages.
    """
    small_batches(docs.sparkSession)
    lang, text = F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    known = docs.where(F.col("lang").isNotNull() & F.coalesce(learnable(F.col("doc_id")), F.lit(True))).select("doc_id", lang, text)
    most = MOST_LANGS * BUCKETS // LEAST_BUCKETS
    langs = known.groupBy("lang").agg(F.count("*").alias("count"), F.count(F.when(F.length("text") > 0, 1)).alias("texts")).where("texts > 0").limit(most + 1).collect()
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    size = buckets_for(len(langs))
    names = sorted(r["lang"] for r in langs)
    number = {x: i for i, x in enumerate(names)}
    total = sum(r["texts"] for r in langs)
    parts = {r["lang"]: min(1.0, max(rows / total, LEAST_ROWS / r["texts"])) for r in langs}
    texts = seen = known.where(F.length("text") > 0)
    if min(parts.values()) < 1:
        # at most ``most`` rows
        share = docs.sparkSession.createDataFrame([(x, int(p * (1 << 30))) for x, p in parts.items()], "lang string, below long")
        seen = seen.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) < F.col("below"))

    def run(batches):
        table: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = number[lang]
                found = folded(grams(text), size)
                table[k] = found if k not in table else table[k] + found
        for k, counts in table.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(counts[used])], ["k", "bucket", "n"])

    def sums(rows):
        return rows.select("lang", "text").mapInArrow(run, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toLocalIterator()

    counts = np.zeros((size, len(names)))
    for r in sums(seen):
        counts[r["bucket"], r["k"]] = r["n"]
    # rows so alike that no hash was picked: all of that language
    if missed := [names[k] for k in np.flatnonzero(counts.sum(axis=0) == 0)]:
        for r in sums(texts.where(F.col("lang").isin(missed))):
            counts[r["bucket"], r["k"]] = r["n"]
    docs_of = {r["lang"]: r["count"] for r in langs}
    learned = np.flatnonzero(counts.sum(axis=0))
    return Model([names[k] for k in learned], counts[:, learned], np.array([docs_of[names[k]] for k in learned], dtype=float))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, ...); from the whole text alone.

    score: the language's posterior, between 0 and 1. Null text, no letter, or a model without
    languages: ``und`` and 0. Null doc_id: not held out. Empty table: no rows. Repeated rows each get
    a row. The model (BUCKETS by languages, at most 32 MB) is broadcast with the task.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score = shared.value.judge(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is known: a letter, and a posterior of at least ``least``.

    Without any language learned, rows with a letter stay. Columns keep their names and types.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            if shared.value.langs:
                lang, score = shared.value.judge(texts)
                keep = [x != "und" and p >= least for x, p in zip(lang, score.tolist())]
            else:
                keep = [has_letter(t) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

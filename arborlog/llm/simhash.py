"""Near-duplicate documents by SimHash: fingerprints, pigeonhole blocks, exact Hamming distance."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.llm.common import connected, if_small, pinned, slots, small_batches

#: Rows of a block that are compared by one task; larger blocks are cut into pairs of such pieces.
PIECE = 1024
_BITS = 64


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the text's word shingles, repeats counted; 0 if it has no words."""
    words = text.lower().split()  # on bytes: A-Z only, and just the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    found = np.array([h(line[s : e - 1], seed) for s, e in zip(starts, ends[k - 1 :])], dtype="<u8")
    ones = np.zeros(_BITS, dtype=np.int64)
    for i in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little")


def _text_key():
    return F.xxhash64(F.col("text").cast("string"))


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(entry, doc_id, fp long): a hash of the text and its fingerprint for each row, of the whole text, null text as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64), pa.int64())], ["entry", "doc_id", "fp"])

    source = docs.select(_text_key().alias("entry"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "entry long, doc_id long, fp long")


def _masks(bits: int, parts: int) -> list[int]:
    """Masks of ``parts - bits`` blocks of ``parts``: two words that differ in ``bits`` bits agree under one of them."""
    edge = [round(i * _BITS / parts) for i in range(parts + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edge)]
    return [sum(x) for x in itertools.combinations(block, parts - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each index reaches."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)), label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _links(task: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int):
    """Links inside each run of equal tasks; side 0: of both pieces, 1 and 2: only across. As few as keep all connected."""
    cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    size = np.diff(np.concatenate([cut, [len(task)]]))
    few = np.repeat(size <= 12, size)
    a, b = [], []
    for shift in range(1, 12):
        i = np.arange(len(task) - shift)
        i = i[few[:-shift] & (task[:-shift] == task[shift:]) & ((side[:-shift] == 0) | (side[:-shift] != side[shift:]))]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= bits]
        a.append(fp[i])
        b.append(fp[i + shift])
    for start, n in zip(cut[size > 12], size[size > 12]):
        x, s = fp[start : start + n], side[start : start + n]
        near = np.zeros((n, n), dtype=bool)
        for k in range(0, n, 256):
            near[k : k + 256] = np.bitwise_count(x[k : k + 256, None] ^ x[None, :]) <= bits
        if s[0]:
            near &= s[:, None] != s[None, :]
        root = spanning(near)
        moved = root != np.arange(n)
        a.append(x[moved])
        b.append(x[root[moved]])
    return np.concatenate(a), np.concatenate(b)


def parts_for(fingerprints: int, bits: int = 4, least: int = 6) -> int:
    """Blocks to cut a fingerprint into: as few as let a key of ``parts - bits`` blocks tell about a quarter of the fingerprints apart.

    Six blocks make 15 keys of 21 bits, eight 70 keys of 32 bits: more keys, but strangers seldom share one.
    """
    parts = max(least, bits + 1)
    while parts < 16 and _BITS * (parts - bits) / parts < fingerprints.bit_length() - 2:
        parts += 1
    return parts


def near_links(fps: DataFrame, bits: int = 4, parts: int = 6) -> DataFrame:
    """fps(fp long, distinct) -> links(a, b) that connect all fingerprints within ``bits`` bits.

    Two fingerprints that differ in ``bits`` of 64 bits agree in ``parts - bits`` of ``parts`` blocks.
    Each choice of so many blocks gives a key; those who share a key meet and are compared by exact
    Hamming distance. A key of n > PIECE fingerprints is cut by hash into n / PIECE pieces and each
    pair of pieces is one task, so no task holds more than about two pieces and no pair is missed. A task
    returns the links of a spanning forest, fewer than its rows, not all its pairs.
    """
    masks = _masks(bits, parts)
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])).alias("key"))
    crowd = pinned(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(if_small(crowd), "key")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    cut = met.withColumn("c", pieces).withColumn("p", F.expr("cast(pmod(xxhash64(fp, 7), c) as int)")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    tasks = cut.select(
        F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("task"),
        F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2).cast("int").alias("side"),
        "fp",
    )
    # a piece's own task holds the piece alone; a pair's task holds the one as side 1, the other as side 2

    def run(batches):
        held = None
        for b in batches:
            t, s, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                t, s, f = (np.concatenate(x) for x in zip(held, (t, s, f)))
            keep = int(np.searchsorted(t, t[-1])) if len(t) else 0  # the last run may go on in the next batch
            held = t[keep:], s[keep:], f[keep:]
            yield from out(t[:keep], s[:keep], f[:keep])
        if held is not None:
            yield from out(*held)

    def out(t, s, f):
        if len(t) > 1:
            a, b = _links(t, s, f.view(np.uint64), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return tasks.repartition(slots(spark), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, bits: int, shingle: int) -> DataFrame:
    """(entry, doc_id, fp, root, component_id) for each row; root names the group."""
    prints = pinned(with_fingerprints(docs, shingle))
    nodes = pinned(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(near_links(nodes.select("fp"), bits, parts_for(nodes.count(), bits)))
    named = pinned(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # minima are pinned before they are joined back: few are broadcast, many meet in a join that can be split
    lowest = pinned(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_print = pinned(named.join(if_small(lowest), "root").select(F.col("fp").alias("node"), "root", "component_id"))
    return prints.join(if_small(by_print), F.col("fp") == F.col("node")).drop("node")


def simhash_groups(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text, ...); other columns are ignored.

    Fingerprints within ``bits`` bits are linked; component_id is the smallest doc_id reachable. Equal
    fingerprints are one node, found by a combining aggregate, so copies are never paired.

    Null or empty text: fingerprint 0, linked like any other. Null doc_id: grouped, but never a
    component_id unless no row of the group has one. Repeated rows each get a row; rows of one
    doc_id with different texts join no groups by that. Empty table: no rows.
    """
    return _grouped(docs, bits, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the row with the smallest doc_id stays.

    Rows are known by doc_id and a hash of the text, not by their place, so that a second reading of the files may split
    them otherwise. The rows that go are taken out by an anti-join. Of repeated rows (one doc_id, one text) one stays. Empty table: no rows.
    """
    groups = pinned(_grouped(docs, bits, shingle).select("entry", "doc_id", "root"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "entry")).alias("kept"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("entry") == F.col("kept.entry")))
    lost = groups.join(if_small(pinned(first)), "root").where(other).select("doc_id", "entry").distinct()
    repeats = pinned(groups.groupBy("doc_id", "entry").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "entry"))
    rows = _without(docs.withColumn("__entry", _text_key()), lost, "left_anti")
    if not repeats.isEmpty():
        many = _without(rows, repeats, "left_semi").dropDuplicates(["doc_id", "__entry"])
        rows = _without(rows, repeats, "left_anti").unionByName(many)
    return rows.select(*docs.columns)


def _without(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    k = keys.select(F.col("doc_id").alias("__doc"), F.col("entry").alias("__key"))
    return rows.join(k, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__entry") == F.col("__key")), how)

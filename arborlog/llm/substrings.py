"""Removal of repeated passages by prefix-partitioned suffix trees.

The text of a document is a sequence of words, and a suffix starts at each of them. Suffixes that share their
first ``window`` words sit under one node of depth ``window`` of the suffix tree; a passage repeats where suffixes of
several documents sit under such a node, and runs of such nodes along a document are its maximal repeats.

First a sieve: every suffix's hash of its first ``window`` words meets those of all other batches, which leaves the suffixes
whose hash isn't alone. Only these go on to the trees, with their words. A tree has the suffixes of some prefixes, as
short as lets them fit in memory, of 1, 2, 4, 8 or ``window`` words; it is their sorted order and the common prefixes of
neighbours, cut at depth ``window``, as nothing below decides what is removed. The trees compare words, not hashes, so a hash
that collides costs time and changes nothing.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.llm import textkit
from arborlog.llm.common import sliced, slots, small_batches

WINDOW = 13
#: Bytes of text in a batch, which is deduplicated in itself before anything is sent: at least, at most, and by the root of all bytes
#: between, so that a batch keeps enough for each part of a sieve that grows with the data.
BATCH_BYTES, MOST_BATCH_BYTES, BATCH_ROOT = 4 << 20, 256 << 20, 180
#: Bytes of hashes in a part of the sieve, and of suffixes in a tree if all were repeated.
SIEVE_BYTES, TREE_BYTES = 16 << 20, 128 << 20
#: Hash cells that prefixes of each length are counted in: at least, and at most (2**20 * 5 sums of 8 bytes reach the driver).
LEAST_CELLS, MOST_CELLS = 1 << 14, 1 << 20
_LAST = np.iinfo(np.int64).max
_NOTHING = np.zeros(0, dtype=np.int64)


def levels(window: int) -> list[int]:
    return [k for k in (1, 2, 4, 8) if k < window] + [window]


def _cell(prefix: np.ndarray, cells: int) -> np.ndarray:
    return (prefix >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


class Groups:
    """Which tree a suffix belongs to, by its shortest prefix whose cell is small enough.

    counts: suffixes by level and cell. A cell above ``limit`` is too large for its length of prefix, so the next longer
    prefix decides; what is too large even at the whole window is dealt by the window's own hash. Cells are dealt to ``n``
    trees, the largest first, to the least loaded. The counts are of all suffixes, so a tree of the repeated ones alone is smaller.
    """

    def __init__(self, counts: np.ndarray, n: int):
        total = int(counts[0].sum())
        self.cells, self.n = counts.shape[1], n
        limit = max(1, total // (4 * n))
        self.deep = counts > limit
        self.group = np.zeros(counts.shape, dtype=np.int32)
        share, load = 1.0, []
        for k in range(len(counts)):
            load += [(-counts[k, c] * share, k, int(c)) for c in np.flatnonzero((counts[k] > 0) & ~self.deep[k])]
            share *= counts[k][self.deep[k]].sum() / max(1, total)
        heap = [(0.0, g) for g in range(n)]
        for size, k, c in sorted(load):
            low, g = heapq.heappop(heap)
            self.group[k, c] = g
            heapq.heappush(heap, (low - size, g))

    def __call__(self, prefix: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(prefix[0]), dtype=np.int32)
        left = np.arange(len(out))
        for k, p in enumerate(prefix):
            cell = _cell(p[left], self.cells)
            here = ~self.deep[k, cell]
            out[left[here]] = self.group[k, cell[here]]
            left = left[~here]
        out[left] = (prefix[-1][left] % np.uint64(self.n)).astype(np.int32)
        return out


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(sorted_), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return np.flatnonzero(new)


def _sizes(cut: np.ndarray, n: int) -> np.ndarray:
    """How long each run is, of n values in all."""
    return np.diff(cut, append=n)


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """The order of numbers below 2**bits, equal ones as they come. Numbers that hold their places too are sorted several times faster."""
    own = max(1, len(key)).bit_length()
    if bits + own > 64:
        return np.argsort(key, kind="stable")
    both = (key.astype(np.uint64) << np.uint64(own)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << own) - 1)
    return both.view(np.int64)


def _squeezed(data: bytes, level: int = 1) -> bytes:
    """Compressed, after the number of bytes."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed: the high bytes of small numbers take hardly any room."""
    return _squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_restored(data), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


class Batch:
    """The suffixes of a batch of documents. All orders depend on the documents alone, so each reading of a batch has the same."""

    def __init__(self, ids: np.ndarray, column: pa.Array, window: int):
        self.window, self.words = window, textkit.Words(column)
        self.places = np.flatnonzero(textkit.fits(self.words, window))  # the word that each suffix starts with
        self.doc = ids[self.words.owner()[self.places]]

    def mark(self, parts: int) -> None:
        """Hash the suffixes. A mark is the part of the sieve that it belongs to, and 32 bits more; equal words have equal marks."""
        marks = textkit.windows(self.words.hashes(), self.window, self.places)
        key = ((marks % np.uint64(parts)) << np.uint64(32)) | (marks >> np.uint64(32))
        order = _order(key, 32 + parts.bit_length())
        ranked = key[order]
        cut = _runs(ranked)
        self.key = ranked[cut]
        self.of = np.empty(len(key), dtype=np.int64)  # each suffix's mark
        self.of[order] = np.repeat(np.arange(len(cut)), _sizes(cut, len(key)))
        own = self.doc[order]
        self.several = np.minimum.reduceat(own, cut) < np.maximum.reduceat(own, cut) if len(cut) else np.zeros(0, dtype=bool)

    def marks(self):
        """(part of the sieve, marks) for each part that the batch meets."""
        part = (self.key >> np.uint64(32)).astype(np.int64)
        cut = _runs(part)
        for a, b in zip(cut, [*cut[1:], len(part)]):
            yield int(part[a]), _packed(np.diff((self.key[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), prepend=np.uint32(0)))

    def shared(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each suffix: is its mark in another batch or in several documents of this one? replies: bits of each part."""
        out, part = self.several.copy(), (self.key >> np.uint64(32)).astype(np.int64)
        for g, bits in replies.items():
            a, b = np.searchsorted(part, [g, g + 1])
            out[a:b] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
        return out[self.of]

    def sift(self, shared: np.ndarray, groups: Groups) -> None:
        """Keep the suffixes with shared marks, and of those with equal words the one with the smallest doc_id to send.

        Equal words have equal marks, so all of them are kept or none.
        """
        self.kept = np.flatnonzero(shared)
        self.part = part = textkit.Covered(self.words, self.places[self.kept], self.window)
        doc = self.doc[self.kept]
        seen = np.zeros(int(part.windows.max(initial=-1)) + 1, dtype=bool)
        seen[part.windows] = True
        node = (np.cumsum(seen) - 1)[part.windows]
        least = np.full(int(np.count_nonzero(seen)), _LAST)
        np.minimum.at(least, node, doc)
        own = np.flatnonzero(doc == least[node])[::-1]
        first = np.empty(len(least), dtype=np.int64)
        first[node[own]] = own  # of a node met again, the last to be set is the first in the batch
        order = np.argsort(first)
        first = first[order]
        hashes, places = textkit.span_hashes(self.words.data, part.starts, part.ends), part.place[first]
        group = groups(textkit.level_windows(hashes, levels(self.window), places))
        table, rank = np.unique(least[order], return_inverse=True)
        key = group.astype(np.int64) * len(table) + rank
        sent = _order(key, int(key.max(initial=0)).bit_length())
        self.group, self.table, self.rank, self.sent_places = group[sent], table, rank[sent], places[sent]
        back = np.empty(len(sent), dtype=np.int64)
        back[order[sent]] = np.arange(len(sent))
        self.node, self.least = back[node], least[order[sent]]  # of each kept suffix, in the order sent; of each sent one

    def suffixes(self):
        """(tree, words, codes of the suffixes' words by place in the window, doc_ids) for each tree that the batch meets."""
        cut, known = _runs(self.group), self.part.known
        # codes in the order of the words, as neighbours in order are alike and so compress
        order = sorted(range(len(known)), key=known.__getitem__)
        rank = np.empty(len(known), dtype=np.int32)
        rank[order] = np.arange(len(known), dtype=np.int32)
        codes, ranked = rank[self.part.codes], [known[i] for i in order]
        for a, b in zip(cut, [*cut[1:], len(self.group)]):
            part = codes[(self.sent_places[a:b][None, :] + np.arange(self.window)[:, None]).ravel()]
            met = np.zeros(len(known), dtype=bool)
            met[part] = True
            used = np.flatnonzero(met)
            kind = "<u2" if len(used) < 1 << 16 else "<u4"
            own = (np.cumsum(met, dtype=np.int32) - 1).astype(kind)[part]
            docs = self.rank[a:b]  # sorted
            at = _runs(docs)
            head = np.concatenate([[len(at)], np.diff(self.table[docs[at]], prepend=0), _sizes(at, b - a)]).astype("<i8")
            yield int(self.group[a]), _squeezed(b" ".join([ranked[i] for i in used.tolist()]), 3), _packed(own), _squeezed(head.tobytes())

    def covered(self, replies: dict[int, bytes]) -> np.ndarray:
        """For each word of the batch, whether it is removed, given each tree's bits: does a smaller document have the node?"""
        elsewhere = np.zeros(len(self.group), dtype=bool)
        for g, bits in replies.items():
            a, b = np.searchsorted(self.group, [g, g + 1])
            elsewhere[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
        gone = elsewhere[self.node] | (self.doc[self.kept] > self.least[self.node])
        edges = np.zeros(len(self.words.starts) + 1, dtype=np.int64)
        at = self.places[self.kept[gone]]
        edges[at] += 1
        edges[at + self.window] -= 1  # starts differ, so no place is named twice
        return np.cumsum(edges)[:-1] > 0


def sieved(marks: list[bytes]) -> list[bytes]:
    """For each batch's marks of one part: bits that tell whether another batch has the mark."""
    parts = [np.cumsum(_unpacked(m, "<u4"), dtype=np.uint32) for m in marks]
    all_ = np.concatenate(parts)
    order = _order(all_, 32)
    cut = _runs(all_[order])
    n = _sizes(cut, len(all_))
    bits = np.empty(len(all_), dtype=bool)
    bits[order] = np.repeat(n > 1, n)
    ends = np.cumsum([len(m) for m in parts])
    return [np.packbits(bits[e - len(m) : e]).tobytes() for e, m in zip(ends, parts)]


class Tree:
    """The suffix tree of some prefixes down to a depth: suffixes in order, and how many words neighbours share.

    suffixes: word numbers, a row for each place and a column for each suffix. An internal node of depth d is a run of
    neighbours that share d words or more.
    """

    def __init__(self, suffixes: np.ndarray):
        self.depth, n = suffixes.shape
        # as many words as fit side by side in 63 bits are one number to sort by
        bits = int(suffixes.max(initial=1)).bit_length()
        keys = []
        for i in range(0, self.depth, 63 // bits):
            key = np.zeros(n, dtype=np.int64)
            for row in suffixes[i : i + 63 // bits]:
                key = (key << bits) | row
            keys.append(key)
        self.order = np.lexsort(keys[::-1])
        ranked = suffixes[:, self.order]
        self.common = np.zeros(n, dtype=np.int64)  # words shared with the one before
        alike = np.ones(max(0, n - 1), dtype=bool)
        for row in ranked:
            alike &= row[1:] == row[:-1]
            self.common[1:] += alike

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix in order, the number of its node of this depth."""
        return np.cumsum(self.common < depth) - 1


def judged(texts: list[bytes], codes: list[bytes], heads: list[bytes], window: int) -> list[bytes]:
    """For each batch's suffixes of one tree: bits that tell whether a smaller doc_id has the same first ``window`` words in any batch."""
    docs, parts, words, first = [], [], [], 0
    for text, code, head in zip(texts, codes, heads):
        x = np.frombuffer(_restored(head), dtype="<i8")
        k = int(x[0])
        docs.append(np.repeat(np.cumsum(x[1 : k + 1]), x[k + 1 :]))
        own = _restored(text) + b" "
        n = own.count(b" ")
        parts.append(_unpacked(code, "<u2" if n < 1 << 16 else "<u4").reshape(window, -1).astype(np.int32) + first)
        words.append(own)
        first += n
    data = b"".join(words)  # each word with the space after it
    ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32) + 1])
    number = pa.Array.from_buffers(pa.large_binary(), first, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()  # 32 bits
    tree = Tree(number[np.concatenate(parts, axis=1)])
    doc = np.concatenate(docs)
    node = tree.nodes(window)
    cut = _runs(node)
    low = np.empty(len(doc), dtype=np.int64)
    low[tree.order] = np.minimum.reduceat(doc[tree.order], cut)[node]
    bits = low < doc
    ends = np.cumsum([len(d) for d in docs])
    return [np.packbits(bits[e - len(d) : e]).tobytes() for e, d in zip(ends, docs)]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _chunk(parts: list[pa.RecordBatch]) -> bytes:
    """Rows as one compressed value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, parts[0].schema) as stream:
        stream.write_table(pa.Table.from_batches(parts).combine_chunks())
    return _squeezed(out.getvalue(), 3)


def _rows(chunk: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(_restored(chunk)).read_all().combine_chunks().to_batches()[0]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a run of ``window`` words that also starts in a document with a smaller doc_id.

    docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept string, repeats) for each input row; repeats: the maximal runs
    of removed words as (first word, number of words). Runs are judged on the input. Other columns are ignored.

    One pass counts prefixes in hash cells and fixes the trees. Rows go by their place in the input, whatever their doc_id, into
    batches of a few MB, each one compressed value. Each batch sends its marks to the sieve, and of those that come back as shared
    each distinct suffix once, with its smallest doc_id in the batch, to the suffix's tree; so a passage that a third of all
    documents share is sent once for each batch, not for each document. A tree answers with one bit for each suffix.
    The batch marks the words and joins what is kept. Texts are shuffled once and read three times.

    Null text: no words. Null doc_id: after all others; such rows lose to any row with one and take from
    none. Rows that share a doc_id don't take from each other. Fewer than ``window`` words: nothing
    removed. Empty table: no rows. A text is worked on whole, so a task needs memory for about thirty times its longest text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_rows, n_bytes = sums["n"], sums["b"] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (n_rows // 16).bit_length()))

    def count(batches):
        table = np.zeros((len(levels(window)), cells), dtype=np.int64)
        for b in batches:
            for part in sliced(b, 0):
                words = textkit.Words(part.column(0))
                places, hashes = np.flatnonzero(textkit.fits(words, window)), words.hashes()
                for row, prefix in zip(table, textkit.level_windows(hashes, levels(window), places)):
                    row += np.bincount(_cell(prefix, cells), minlength=cells)
        level, cell = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(cell, pa.int32()), pa.array(table[level, cell], pa.int64())], ["level", "cell", "n"])

    counts = np.zeros((len(levels(window)), cells), dtype=np.int64)
    for r in rows.select("text").mapInArrow(count, "level int, cell int, n long").groupBy("level", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["level"], r["cell"]] = r["n"]
    total = int(counts[0].sum())
    n_parts = max(slots(spark), total * 4 // SIEVE_BYTES + 1)
    n_trees = max(slots(spark) // 2, total * 4 * (window + 2) // TREE_BYTES + 1)
    limit = min(MOST_BATCH_BYTES, max(BATCH_BYTES, int(BATCH_ROOT * n_bytes**0.5)))
    shared = spark.sparkContext.broadcast(Groups(counts, n_trees))

    def deal(batches):
        first, held, size, n = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), pa.array([_chunk(held)], pa.binary())], ["m", "chunk"])

        for b in batches:
            for part in sliced(b, 1, limit // 8):
                if size + part.nbytes > limit and held:
                    yield flush()
                    held, size, n = [], 0, n + 1
                held.append(part)
                size += part.nbytes
        if held:
            yield flush()

    def batch(left):
        b = _rows(left.column("chunk")[0].as_py())
        return b, Batch(_numbers(b.column(0)), b.column(1), window)

    def send(key, table):
        _, own = batch(table)
        own.mark(n_parts)
        found = list(own.marks())
        return pa.table({"g": pa.array([x[0] for x in found], pa.int32()), "m": pa.array([key[0].as_py()] * len(found), pa.int64()), "marks": pa.array([x[1] for x in found], pa.binary())})

    def sieve(key, table):
        bits = sieved(table.column("marks").to_pylist()) if len(table) else []
        return pa.table({"m": table.column("m"), "g": table.column("g"), "bits": pa.array(bits, pa.binary())})

    def replies(table):
        return dict(zip(table.column("g").to_pylist(), table.column("bits").to_pylist()))

    def sift(key, left, right):
        _, own = batch(left)
        own.mark(n_parts)
        alike = own.shared(replies(right))
        own.sift(alike, shared.value)
        # what was found shared goes along, to a group of its own that hands it back
        found = [(-1 - key[0].as_py(), b"", np.packbits(alike).tobytes(), b""), *own.suffixes()]
        names = ("g", "words", "codes", "head")
        return pa.table({n: pa.array([x[i] for x in found], pa.binary() if i else pa.int64()) for i, n in enumerate(names)} | {"m": pa.array([key[0].as_py()] * len(found), pa.int64())}).select(["g", "m", "words", "codes", "head"])

    def judge(key, table):
        bits = table.column("codes") if key[0].as_py() < 0 else pa.array(judged(*(table.column(k).to_pylist() for k in ("words", "codes", "head")), window), pa.binary())
        return pa.table({"m": table.column("m"), "g": table.column("g"), "bits": bits})

    def finish(key, left, right):
        b, own = batch(left)
        found = replies(right)
        own.sift(np.unpackbits(np.frombuffer(found.pop(-1 - key[0].as_py()), dtype=np.uint8), count=len(own.places)).astype(bool), shared.value)
        gone, words = own.covered(found), own.words
        sums = np.concatenate([[0], np.cumsum(gone)])[words.first]
        data, kept = words.data.tobytes(), []
        for i in range(b.num_rows):
            parts = data[words.at[i] : words.at[i + 1]].split()
            if sums[i + 1] > sums[i]:
                parts = itertools.compress(parts, (~gone[words.first[i] : words.first[i + 1]]).tolist())
            kept.append(b" ".join(parts))
        # a run also ends where its text does
        owner = words.owner()
        joined = gone[1:] & gone[:-1] & (owner[1:] == owner[:-1]) if len(gone) else np.zeros(0, dtype=bool)
        begin = np.flatnonzero(gone & ~np.concatenate([[False], joined])[: len(gone)])
        length = np.diff([*(np.cumsum(gone)[begin] - 1), int(gone.sum())]) if len(begin) else _NOTHING
        spans = pa.StructArray.from_arrays([pa.array(begin - words.first[owner[begin]] if len(begin) else _NOTHING, pa.int64()), pa.array(length, pa.int64())], ["start", "length"])
        ends = np.searchsorted(begin, words.first).astype(np.int32)
        return pa.table({"doc_id": b.column(0), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(np.diff(sums), pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "repeats": pa.ListArray.from_arrays(pa.array(ends), spans)})

    # the three readings of ``dealt`` are one exchange, which Spark reuses
    dealt = rows.mapInArrow(deal, "m long, chunk binary")
    sent = dealt.groupBy("m").applyInArrow(send, "g int, m long, marks binary")
    alike = sent.groupBy("g").applyInArrow(sieve, "m long, g int, bits binary")
    passed = dealt.groupBy("m").cogroup(alike.groupBy("m")).applyInArrow(sift, "g long, m long, words binary, codes binary, head binary")
    told = passed.groupBy("g").applyInArrow(judge, "m long, g long, bits binary")
    return dealt.groupBy("m").cogroup(told.groupBy("m")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:long,length:long>>")


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
win as (select doc_id, i as pos, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
low as (select k, min(doc_id) as d from win group by k),
gone as (select distinct win.doc_id, pos + j as pos from win join low on low.k = win.k and low.d < win.doc_id, range(0, 13) t(j)),
kept as (select words.doc_id, string_agg(word, ' ' order by words.pos) as s, count(*) as n from words left join gone on gone.doc_id = words.doc_id and gone.pos = words.pos where gone.pos is null group by 1)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id
"""

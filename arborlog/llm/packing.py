"""Packing token sequences by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlog.llm import textkit
from arborlog.llm.common import pinned, sliced, small_batches

WINDOW = 1024
#: Most groups of documents that are numbered apart; bounds the tables that the driver holds.
GROUPS = 8192
#: Most word pieces that a tokenizer worker remembers, besides those of the batch at hand.
CACHE = 400_000


def _spaces() -> tuple[np.ndarray, np.ndarray]:
    """By two bytes of UTF-8: can they begin, or end, with a character that some regular expressions take for space?"""
    first, last = np.zeros((256, 256), dtype=bool), np.zeros((256, 256), dtype=bool)
    for c in map(chr, range(0x3001)):
        if c.isspace() or c == "\u180e":
            b = c.encode()
            first[b[0], b[1] if len(b) > 1 else slice(None)] = True
            last[b[-2] if len(b) > 1 else slice(None), b[-1]] = True
    return first, last


_FIRST, _LAST = _spaces()


def _gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie one after another from the places ``at``, those with these numbers, and their own places."""
    sizes = at[which + 1] - at[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(ends[-1]) + np.repeat(at[which] - ends[:-1], sizes)], ends


def is_plain(file: dict) -> bool:
    """Is a ``tokenizers`` file a byte-level BPE with none of the options that the quick encoder doesn't know?

    Merges must be in the order of the ids that they make, as the quick encoder takes an id for a merge's rank.
    """
    model, before = file["model"], file.get("pre_tokenizer") or {}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges") or []]
    ids = [model["vocab"].get(m, -1) for m in merged]
    return (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        and file.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        and ids == sorted(ids) and min(ids, default=0) >= 0
        and not any(x.get(k) for x in file.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip"))
    )


class Slow:
    """Ids by ``tokenizers`` itself, for files that ``is_plain`` doesn't hold for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        return np.array(self._own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self(t or "") for t in column.to_pylist()]
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)])


def encoder(path: str):
    """The encoder of a file. A Python worker keeps it from task to task, as long as the file stays the same."""
    found = os.stat(path)
    return _encoder(path, found.st_mtime_ns, found.st_size)


@lru_cache(maxsize=1)
def _encoder(path: str, *version: int):
    with open(path, encoding="utf-8") as f:
        return Encoder(path) if is_plain(json.load(f)) else Slow(path)


class Encoder:
    """Ids of a byte-level BPE ``tokenizers`` file, without special tokens around the text, as little-endian bytes.

    The vocabulary is read from the JSON file and merged by tiktoken, which gives the same ids
    several times faster (a test compares both). As ``tokenizers`` does, the text is first cut at the
    file's added tokens, the leftmost and longest first, and each stands as its own id. A piece of text from a space
    between two non-spaces to the next such space never shares a token with its neighbours. So a column of texts is
    cut into such pieces, the distinct ones are looked up, and those not yet known are encoded together, as one text
    whose ids are dealt by their bytes. The memory is emptied when it is full.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], file.get("added_tokens") or []
        self._added = {x["content"]: np.array([x["id"]], dtype="<u4") for x in added}
        self._marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        ranks = {bytes(byte[c] for c in k): v for k, v in vocabulary.items() if all(c in byte for c in k) and k not in self._added}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)  # of each id
        self._bytes[list(ranks.values())] = [len(k) for k in ranks]
        # known pieces, the number of batches that met each; ids of all of them, and where each one's begin
        self._known, self._met = pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int64)
        self._ids, self._at = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _forget(self) -> None:
        """Keep the pieces met most often, half of CACHE."""
        short = np.flatnonzero(pc.binary_length(self._known).to_numpy() < 64)
        keep = np.sort(short[np.argsort(-self._met[short], kind="stable")[: CACHE // 2]])
        self._known, self._met = self._known.take(pa.array(keep)), self._met[keep] // 2
        self._ids, self._at = _gathered(self._ids, self._at, keep)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self._bpe.encode_ordinary(text.decode()), dtype="<u4")

    def __call__(self, text: str) -> bytes:
        return self.column(pa.array([text], pa.large_string()))[0].tobytes()

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one more at the end). Null is empty."""
        if not any(pc.any(pc.match_substring(column, x)).as_py() for x in self._added):
            return self._between(column)
        parts = [self._marks.split(t or "") for t in column.to_pylist()]
        ids, at = self._between(pa.array([x for p in parts for x in p[::2]], pa.large_string()))
        between = (ids[i:j] for i, j in pairwise(at.tolist()))
        out = [np.concatenate([self._added[x] if i % 2 else next(between) for i, x in enumerate(p)]) for p in parts]
        return np.concatenate(out), np.cumsum([0, *map(len, out)])

    def _between(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens."""
        data, at = textkit.flat(column)
        n = len(data)
        if n == 0:
            return np.zeros(0, dtype="<u4"), np.zeros(len(at), dtype=np.int64)
        cut = np.flatnonzero(data == 32)
        # a byte of the text before or after can only prevent a cut
        cut = cut[~_LAST[data[np.maximum(cut - 2, 0)], data[np.maximum(cut - 1, 0)]] & ~_FIRST[data[np.minimum(cut + 1, n - 1)], data[np.minimum(cut + 2, n - 1)]]]
        begin = np.zeros(n + 1, dtype=bool)
        begin[cut] = True
        begin[at[1:] - 1] &= data[at[1:] - 1] != 32  # a space that ends a text stays with what is before it
        begin[at] = True
        starts = np.flatnonzero(begin)  # and n
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(pieces.dictionary)
        ids, ends = _gathered(self._ids, self._at, number[pieces.indices.to_numpy()])
        return ids, ends[np.searchsorted(starts, at)]

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces in the memory, after those not yet there are encoded."""
        if len(self._known) > CACHE or self._known.nbytes + self._ids.nbytes > 128 * CACHE:
            self._forget()
        number = pc.index_in(pieces, value_set=self._known).fill_null(-1).to_numpy().astype(np.int64)
        self._met[number[number >= 0]] += 1
        new = np.flatnonzero(number < 0)
        _, at, data = pieces.buffers()
        at, data = np.frombuffer(at, dtype=np.int64), np.frombuffer(data, dtype=np.uint8)
        a, b, last = at[new], at[new + 1], len(data) - 1
        # side by side, pieces stay apart where a space stands between two non-spaces; the others are encoded alone
        apart = (data[a] == 32) & (b - a > 1) & ~_FIRST[data[np.minimum(a + 1, last)], data[np.minimum(a + 2, last)]] & ~_LAST[data[np.maximum(b - 2, 0)], data[b - 1]]
        joined = self._whole(b"".join(pc.take(pieces, pa.array(new[apart])).to_pylist()))
        alone = [self._whole(x) for x in pc.take(pieces, pa.array(new[~apart])).to_pylist()]
        ends = np.searchsorted(np.cumsum(self._bytes[joined]), np.cumsum((b - a)[apart])) + 1
        new = np.concatenate([new[apart], new[~apart]])
        number[new] = len(self._known) + np.arange(len(new))
        self._known, self._met = pa.concat_arrays([self._known, pc.take(pieces, pa.array(new))]), np.concatenate([self._met, np.ones(len(new), dtype=np.int64)])
        self._ids = np.concatenate([self._ids, joined, *alone])
        self._at = np.concatenate([self._at, self._at[-1] + np.concatenate([ends, len(joined) + np.cumsum([len(x) for x in alone], dtype=np.int64)])])
        return number


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def bits_of(rest: int) -> list[int]:
    """Powers of two that add up to rest, the largest first."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces_of(ids: bytes, window: int) -> tuple[int, list[int], int, list[int]]:
    """Ids of a document -> their number, and checksums: of each full window, of the rest, of the rest cut into powers of two."""
    n = len(ids) // 4
    full = n // window
    crc = [zlib.crc32(ids[4 * window * i : 4 * window * (i + 1)]) for i in range(full)]
    rest = ids[4 * window * full :]
    cut, at = [], 0
    for b in bits_of(n - full * window):
        cut.append(zlib.crc32(rest[4 * at : 4 * (at + b)]))
        at += b
    return n, crc, zlib.crc32(rest) if rest else 0, cut


def tokenized(docs: DataFrame, window: int, path: str | None) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        encode = encoder(path or default_path())
        for b in (part for whole in batches for part in sliced(whole, 2)):
            ids, at = encode.column(b.column(2))
            rows = [pieces_of(ids[i:j].tobytes() + b"\0\0\0\0", window) for i, j in pairwise(at.tolist())]
            n, full, rest, cut = zip(*rows) if rows else ((), (), (), ())
            u32 = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(full, u32), pa.array(rest, pa.int64()), pa.array(cut, u32)], ["entry", "doc_id", "n", "full", "rest", "cut"])

    rows = docs.select(F.monotonically_increasing_id().alias("entry"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"entry long, doc_id {kind}, n long, full array<long>, rest long, cut array<long>")


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Lengths of two or three rests that fill a window, zero padded: all pairs, and triples around each length.

    A length's triples take its partners at a few ratios; the eight most frequent lengths take all partners.
    """
    have = counts > 0
    a = np.arange(1, window // 2 + 1)
    found = [np.stack([a, window - a, np.zeros_like(a)], axis=1)]
    a = np.arange(1, window // 3 + 1)
    for part in (0.0, 0.33, 0.67, 1.0):
        b = np.round(a + part * ((window - a) // 2 - a)).astype(int)
        found.append(np.stack([a, b, window - a - b], axis=1))
    for a in np.argsort(-counts, kind="stable")[:8]:
        b = np.arange(1, window - a)
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1)) if a else None
    rows = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    return rows[((rows == 0) | have[rows]).all(axis=1) & (rows >= 0).all(axis=1)]


def solve(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeats x of the combinations that minimise |A x - counts|, by accelerated projected gradient."""
    want = counts.astype(float).copy()
    want[0] = 0
    use = rows > 0

    def times(x):
        out = np.bincount(rows.ravel(), weights=np.repeat(x, 3) * use.ravel(), minlength=len(counts))
        return out

    x = np.zeros(len(rows))
    # the largest eigenvalue of A'A, by a few power steps
    v = np.ones(len(rows))
    for _ in range(20):
        v = (times(v)[rows] * use).sum(axis=1)
        top = np.linalg.norm(v)
        v /= max(top, 1e-9)
    y, t = x, 1.0
    for _ in range(steps):
        z = np.maximum(0, y - ((times(y) - want)[rows] * use).sum(axis=1) / (1.05 * max(top, 1e-9)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = z + (t - 1) / t2 * (z - x), z, t2
    return x


class Plan:
    """Where the rest of each document goes, from the histogram of rest lengths alone.

    A document is known by its rest length and its number among those of that length. The first
    ``taken[length]`` documents of a length fill the solved combinations; each of the others is cut
    into powers of two, which greedily, the largest first, fill windows without a gap.
    """

    def __init__(self, counts: np.ndarray, window: int, first: int):
        self.window, left = window, counts.copy()
        left[0] = 0
        rows = combinations(left, window)
        length, count, place, base = [], [], [], []
        used = first
        if len(rows):
            x = solve(rows, left)
            for k in np.argsort(-x, kind="stable"):
                own = [int(v) for v in rows[k] if v]
                times = min(int(np.ceil(x[k] - 0.05)), *(int(left[v]) // own.count(v) for v in own))
                if times <= 0:
                    continue
                at = 0
                for v in own:
                    length.append(v), count.append(times), place.append(at), base.append(used)
                    at += v
                    left[v] -= times
                used += times
        order = np.argsort(length, kind="stable") if length else np.zeros(0, dtype=int)
        self.taken = counts - left
        self.taken[0] = 0
        self.start = np.concatenate([[0], np.cumsum(self.taken)])  # of each length among all filled places
        self.ends = np.cumsum(np.array(count, dtype=np.int64)[order])
        self.begins = self.ends - np.array(count, dtype=np.int64)[order]
        self.place, self.base = np.array(place, dtype=np.int64)[order], np.array(base, dtype=np.int64)[order]
        # those left over, cut into powers of two
        bit = 1 << np.arange(window.bit_length() - 1)
        has = (np.arange(window)[:, None] & bit[None, :]) > 0
        own = np.where(has, left[:, None], 0)
        self.before = np.cumsum(own, axis=0) - own
        words = own.sum(axis=0) * bit
        self.offset = words[::-1].cumsum()[::-1] - words  # larger powers come first
        self.used = used

    def __call__(self, length: np.ndarray, number: np.ndarray):
        """-> for each document: whole (bool), sequence and offset of a whole rest."""
        whole = number < self.taken[length]
        at = np.where(whole, self.start[length] + number, 0)
        if len(self.ends) == 0:
            return whole, at, at
        slot = np.minimum(np.searchsorted(self.ends, at, side="right"), len(self.ends) - 1)
        return whole, self.base[slot] + at - self.begins[slot], self.place[slot]

    def cut(self, length: int, number: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the powers of two of a document that fills no combination."""
        out = []
        for b in bits_of(length):
            k = b.bit_length() - 1
            at = int(self.offset[k]) + (int(self.before[length, k]) + number - int(self.taken[length])) * b
            out.append((b, self.used + at // self.window, at % self.window))
        return out


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Sequences of at most ``window`` (a power of two) tokens from whole documents, nearly without padding.

    docs(doc_id, text, ...) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document's ids end with id 0. Its full windows are sequences of their own;
    the rest goes whole into a combination of two or three rests that fill a window, as often as the
    non-negative least squares solution over the histogram of rests says, rounded; rests beyond that
    are cut into powers of two and packed greedily. Only the last sequence can be short.

    The driver sees the histogram (``window`` numbers) and the totals of at most GROUPS + window groups
    of documents. Documents get their number inside a group by a window over the group, whose size is
    bounded by a salt, so that a length that many documents share is spread out.

    Null or empty text: the single id 0. Rows that share a doc_id are packed each. Empty table: no rows.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    rows = pinned(tokenized(docs, window, path))
    rest = F.expr(f"cast(n % {window} as int)")
    counts = np.zeros(window, dtype=np.int64)
    for r in rows.groupBy(rest.alias("r")).count().collect():  # at most ``window`` rows
        counts[r["r"]] = r["count"]
    total = int(counts.sum())
    per = max(64, total // GROUPS + 1)
    salts = F.array(*[F.lit(int(x)) for x in -(-counts // per)])
    # an array literal of ``window`` numbers: groups of at most about ``per`` rows each
    salted = rows.withColumn("r", rest).withColumn("salt", F.expr("xxhash64(entry)")).withColumn("salt", F.pmod(F.col("salt"), F.element_at(salts, F.col("r") + 1)).cast("int"))
    groups = salted.groupBy("r", "salt").agg(F.count("*").alias("c"), F.sum(F.size("full")).alias("f")).orderBy("r", "salt").collect()
    offsets, number, fulls, last = [], 0, 0, None
    for g in groups:  # at most GROUPS + 2 * window rows
        number = 0 if g["r"] != last else number
        offsets.append((g["r"], g["salt"], number, fulls))
        number, fulls, last = number + g["c"], fulls + g["f"], g["r"]
    plan = Plan(counts, window, fulls)
    place = spark.createDataFrame(offsets, "r int, salt int, number0 long, full0 long")
    w = Window.partitionBy("r", "salt").orderBy("doc_id", "entry")
    known = (
        salted.withColumn("number1", F.row_number().over(w) - 1)
        .withColumn("full1", F.sum(F.size("full")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("full"))
        .join(F.broadcast(place), ["r", "salt"])
        .select("doc_id", "n", "r", "full", "rest", "cut", (F.col("number0") + F.col("number1")).alias("number"), (F.col("full0") + F.col("full1")).alias("sequence"))
    )

    def run(batches):
        for b in batches:
            ids, n, r, full, crc, cut, number, sequence = (b.column(i) for i in range(8))
            lengths = r.to_numpy()
            whole, seq, place = plan(lengths, number.to_numpy())
            row, start, length, check, into, offset = [], [], [], [], [], []
            for i, (f, c, k, num, s0) in enumerate(zip(full.to_pylist(), crc.to_pylist(), cut.to_pylist(), number.to_pylist(), sequence.to_pylist())):
                done = len(f) * window
                found = [(window, x, s0 + j, 0) for j, x in enumerate(f)]
                if lengths[i]:
                    found += [(int(lengths[i]), c, int(seq[i]), int(place[i]))] if whole[i] else [(m, x, s, o) for (m, s, o), x in zip(plan.cut(int(lengths[i]), num), k)]
                at = 0
                for m, x, s, o in found:
                    row.append(i), start.append(at), length.append(m), check.append(x), into.append(s), offset.append(o)
                    at += m
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), *(pa.array(x, pa.int64()) for x in (start, length, check)), n.take(take), *(pa.array(x, pa.int64()) for x in (into, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

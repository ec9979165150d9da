"""Personal data in texts, also disguised: detect on a normalised text, map spans back to the source."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and from the start of a digit run only: the same matches, without backtracking over long runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of plain identifiers: leftmost, non-overlapping in each kind, by kind, then start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


# Letters of other scripts that look like Latin ones.
_LOOKALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧορν", "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXopv"))
_HIDDEN = frozenset("­​‌‍⁠﻿")
_ODD = re.compile("[" + "".join(_LOOKALIKE) + "".join(_HIDDEN) + "‐-―․。٠-٩۰-۹！-～｡\U0001d7ce-\U0001d7ff]")
# Words for digits.
_DIGIT = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NUMBER = "(?:" + "|".join(_DIGIT) + ")"
_SPELLED = re.compile(rf"(?<![a-z])(?:{_NUMBER}(?![a-z])|(?<![0-9])[0-9]++)(?:[ ,.\-]{{1,2}}(?:{_NUMBER}(?![a-z])|[0-9]++|dot(?![a-z])|point(?![a-z]))){{3,}}")
_PIECE = re.compile(rf"{_NUMBER}|[0-9]++|dot|point")
_SIGN = re.compile(r"(?:\+|(?<![a-z])plus )\Z")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_MARKS = re.compile(rf"{_OPEN}\s*(at|dot|punkt|point)\s*{_CLOSE}\s*")
# a bare address: local part, "at" or @, and names joined by "dot" or a full stop
# (at most 31 "dot" in the local part, which has 64 characters at most)
_BARE = re.compile(r"(?<![a-z0-9._%+-])([a-z0-9][a-z0-9._%+-]*+(?: dot [a-z0-9._%+-]++){0,31})(?: at |@)([a-z0-9-]++(?:(?: dot |\.)[a-z0-9-]++)+)")
_JOIN = re.compile(r" (at|dot) ")
# Last names of addresses that may be words too; any other word of letters is one unless it is among _PROSE.
_LAST = frozenset("com org net edu gov mil int info biz io co uk us ca au de fr es it nl eu ch at be se no dk fi pl pt ru jp cn in br mx ar me tv dev app ai".split())

# Words of prose that are no part of a spelled address, and those of them that are last names of some countries.
_PROSE = frozenset("a an and any are as been but by can did do for from had has have he her here him his how if into is its like my near not of off on one or our over she so some than that the their them then there these they this those to under was we were what when where which while who why will with you your".split())
_PROSE_LAST = _PROSE - frozenset("as by do is my so to".split())


class Cover:
    """Disjoint ranges in order, so that a text of a million ranges can be asked about each of them."""

    def __init__(self, ranges: Iterable[tuple[int, int]] = ()):
        self.start, self.end = array("q"), array("q")
        for s, e in sorted(ranges):
            if self.end and s <= self.end[-1]:
                self.end[-1] = max(e, self.end[-1])
            else:
                self.start.append(s)
                self.end.append(e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect_right(self.end, s)
        return i < len(self.start) and self.start[i] < e

    def add(self, s: int, e: int) -> None:
        """A range that meets none."""
        i = bisect_right(self.end, s)
        self.start.insert(i, s)
        self.end.insert(i, e)


class Mapped:
    """A text under change, with the source places of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None
        self.changed = Cover()

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in the place of ranges of the present text, in order. Their characters map to the whole range."""
        if not edits:
            return
        n = len(self.text)
        begin, stop = (self.start, self.end) if self.start is not None else (range(n), range(1, n + 1))
        parts, start, end, at = [], array("q"), array("q"), 0
        ranges = list(zip(self.changed.start, self.changed.end))
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            start.extend(begin[at:a])
            end.extend(stop[at:a])
            if new:
                start.extend([begin[a]] * len(new))
                end.extend([stop[b - 1]] * len(new))
            at = b
            ranges.append((begin[a], stop[b - 1]))
        parts.append(self.text[at:])
        start.extend(begin[at:])
        end.extend(stop[at:])
        self.text, self.start, self.end, self.changed = "".join(parts), start, end, Cover(ranges)

    def touched(self, a: int, b: int) -> bool:
        """Did a change make part of this range of the present text?"""
        return self.start is not None and self.changed.meets(self.start[a], self.end[b - 1])


def _marks(low: str) -> list[tuple[int, int, str]]:
    """Edits that turn bracketed marks, with the spaces around them, into @ and full stops."""
    out, free = [], 0
    for x in _MARKS.finditer(low):
        a = x.start()
        while a > free and low[a - 1].isspace():
            a -= 1
        free = x.end()
        out.append((a, free, "@" if x[1] == "at" else "."))
    return out


def _plain(c: str) -> str:
    if c in _HIDDEN:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if "‐" <= c <= "―":
        return "-"
    if c in "。｡․":
        return "."
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return unicodedata.normalize("NFKC", c)


def _lower(text: str) -> str:
    """Lower case without a change of length."""
    return low if len(low := text.lower()) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _joins(low: str, m: Mapped) -> list[tuple[int, int, str]]:
    """Edits that turn "at" and "dot" inside bare addresses into @ and full stops."""
    edits, x = [], _BARE.search(low)
    while x:
        names = x[1].split(" dot ")
        own = next((i for i in range(len(names), 0, -1) if names[i - 1] in _PROSE), 0)  # prose before the address
        start = x.start() + sum(len(n) + len(" dot ") for n in names[: min(own, len(names) - 1)])
        found = low[start : x.end()]
        labels = re.split(r" dot |\.", x[2])
        spelled = labels[-1].isalpha() and len(labels[-1]) > 1 and labels[-1] not in _PROSE_LAST and _PROSE.isdisjoint([*labels[:-1], names[-1]])
        if m.touched(start, x.end()) or " dot " in found and ("@" in found or labels[-1] in _LAST or spelled):
            edits += [(start + j.start(), start + j.end(), "@" if j[1] == "at" else ".") for j in _JOIN.finditer(found)]
            x = _BARE.search(low, x.end())
        else:
            x = _BARE.search(low, x.end(1))
    return edits


def _is_one(digits: str, signed: bool) -> bool:
    """Is the whole of this one identifier?"""
    text = "+" * signed + digits
    return len(text) <= 64 and any((s, e) == (0, len(text)) for _, s, e in base_spans(text))


def _numbers(low: str) -> list[tuple[int, int, str]]:
    """Edits that turn runs of spelled digits into digits.

    A run that isn't one identifier is tried in parts: cut at commas, between plain and spelled numbers, and between plain
    numbers. Neighbouring parts are tried together, most of them first, if each has three characters or more; a long list of small
    numbers would hold cards by chance otherwise. What is left of it is one number as it stands.
    """
    edits = []

    def keep(parts: list, signed: bool, whole: bool) -> bool:
        """Take these parts as one number, if they are one identifier, or else (not whole) might hold one."""
        digits = "".join(p[2] for p in parts)
        if sum(p[3] for p in parts) < 3 or not (_is_one(digits, signed) if whole else "." in digits or 7 <= len(digits) <= 19):
            return False
        edits.append((parts[0][0], parts[-1][1], digits))
        return True

    for x in _SPELLED.finditer(low):
        parts, last, at = [], None, x.start()  # start, end, digits, number of spelled ones
        for t in _PIECE.finditer(low, *x.span()):
            kind = "dot" if t[0] in ("dot", "point") else "plain" if t[0].isdigit() else "word"
            if not parts or "," in low[at : t.start()] or kind == "plain" and last == "plain" or {kind, last} == {"plain", "word"}:
                parts.append([t.start(), t.end(), [], 0])
            parts[-1][1] = at = t.end()
            parts[-1][2].append("." if kind == "dot" else _DIGIT.get(t[0], t[0]))
            parts[-1][3] += kind == "word"
            last = kind
        for p in parts:
            p[2] = "".join(p[2])
        signed = _SIGN.search(low, max(0, x.start() - 6), x.start()) is not None
        if keep(parts, signed, True):
            continue
        left = i = 0
        while i < len(parts):
            for j in range(min(len(parts), i + 24), i, -1):
                plus = signed and i == 0
                if (j == i + 1 or all(len(p[2]) > 2 for p in parts[i + plus : j])) and keep(parts[i:j], plus, True):
                    if left < i:
                        one = edits.pop()
                        keep(parts[left:i], False, False)
                        edits.append(one)
                    left = i = j
                    break
            else:
                i += 1
        if left < len(parts):
            keep(parts[left:], False, False)
    return edits


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after normalising; none overlaps a plain one, and each covers a disguise."""
    m = Mapped(text)
    if not text.isascii():
        m.replace([(x.start(), x.end(), _plain(x[0])) for x in _ODD.finditer(text)])
    low = _lower(m.text)
    if "dot" in low or "at" in low and re.search(r"at\s*[\])}>]", low) or "punkt" in low or "point" in low:
        m.replace(_marks(low))
        low = _lower(m.text)
        if " dot " in low or " at " in low and m.changed.start:
            m.replace(_joins(low, m))
            low = _lower(m.text)
    if sum(low.count(w) for w in _DIGIT if w != "oh") >= 3:
        m.replace(_numbers(low))
    if not m.changed.start:
        return []
    # a spelled phone number has no sign that a detector can hold on to but its plus
    m.replace([(x.start(), x.end(), "+") for x in re.finditer(r"(?<![a-z])plus (?=[0-9])", _lower(m.text))])
    taken, out = Cover((s, e) for _, s, e in base), []
    for kind, s, e in base_spans(m.text):
        s, e = m.start[s], m.end[e - 1]
        if taken.meets(s, e) or not m.changed.meets(s, e):
            continue
        out.append((kind, s, e))
        taken.add(s, e)
    return sorted(out)


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_all(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans) of a whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = added_spans(text, base)
    return base, sorted(base + more) if more else base


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each whole text of docs(doc_id, text, ...), one row for each input row.

    -> doc_id, n_email, n_ip, n_card, n_phone (of the plain spans), base_sha256 (of the plain
    spans), spans (plain and disguised), n_added. Offsets count code points. Null or empty text: no
    spans. No shuffle: each row stands alone. Empty table: no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [find_all(t) for t in b.column(1).to_pylist()]
            n = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *n, sha, pa.array([_said(x) for _, x in rows], pa.string()), pa.array([len(x) - len(base) for base, x in rows], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked_text(text: str | None) -> str | None:
    """The text with each span, where spans overlap their union, replaced by its kind in brackets."""
    spans = find_all(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def masked(docs: DataFrame) -> DataFrame:
    """docs, all columns, with personal data in text replaced by [EMAIL], [IP], [CARD] or [PHONE]. n_chars, if there, follows. Null text stays null. Empty table: no rows."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() == "bigint" else None

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new = [masked_text(t) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([c if x == y else len(y) for c, x, y in zip(b.column(size).to_pylist(), old, new)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)

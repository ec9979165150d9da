"""Column functions: identities, hashes, typed JSON, paths, envelopes, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122; a fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Address under which seeds of ids stand. To share ids with another store, give its address to ``stable_id``.
SEED_ROOT = "https://symbols.local/"
#: Mark of a text that holds base64; another store's mark can be given to the functions below.
ENVELOPE = "\x00base64\x00"
MAX_INLINE_BINARY = 5 * 1024 * 1024
MAX_JSON = 512 * 1024


def uuid5(seed: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a string, lower case with hyphens."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), seed.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def stable_id(namespace: str, seed: Column, root: str = SEED_ROOT) -> Column:
    """The id that importers give to a symbol or reference: its seed under its namespace."""
    return uuid5(F.concat(F.lit(root + (f"{namespace}/" if namespace else "")), seed))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def fnv1a64(value: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hex digits. The running hash is kept in two 32-bit halves, as products would overflow."""
    data = F.hex(value.cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(value)), lambda i: F.conv(F.substring(data, 2 * i - 1, 2), 16, 10).cast("long"))
    codes = F.when(F.octet_length(value) > 0, codes).otherwise(F.array().cast("array<long>"))
    # prime 2**40 + 435: hi' = hi * 435 + lo * 2**8 + carry, lo' = lo * 435
    low32 = F.lit(0xFFFFFFFF)

    def step(acc: Column, code: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(code)
        product = lo * 435
        hi = (acc["hi"] * 435 + lo * 256 + F.shiftright(product, 32)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), product.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(codes, start, step, lambda acc: F.lower(F.concat(F.lpad(F.hex(acc["hi"]), 8, "0"), F.lpad(F.hex(acc["lo"]), 8, "0"))))


def json_kind(document: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant"))


def metadata_string(document: Column, key: str) -> Column:
    """The value of a key if it is a JSON string, else null; numbers aren't turned into text."""
    return F.when(json_kind(document, key) == "STRING", F.get_json_object(document, f"$.{key}"))


def metadata_bool(document: Column, key: str) -> Column:
    """The value of a key if it is a JSON boolean, else false."""
    return F.coalesce(F.when(json_kind(document, key) == "BOOLEAN", F.get_json_object(document, f"$.{key}") == "true"), F.lit(False))


def tokens(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores; only A-Z are lowered."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of the token sets; 1 if both are empty."""
    a, b = tokens(left), tokens(right)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def safe_path(path: Column) -> Column:
    """May a relative path be written under a root? No empty, absolute, drive or backslash path, no .. part, no leading . part."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return ~path.contains("\\") & ~path.startswith("/") & (F.size(parts) > 0) & (F.get(parts, 0) != ".") & ~F.exists(parts, lambda p: (p == "..") | p.endswith(":"))


def text_or_envelope(content: Column, mark: str = ENVELOPE) -> Column:
    """File content as text: valid UTF-8 as it is, other bytes as a marked base64 text, null if those are too large."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(F.octet_length(content) <= MAX_INLINE_BINARY, F.concat(F.lit(mark), F.base64(content)))


def is_envelope(text: Column, mark: str = ENVELOPE) -> Column:
    return text.startswith(mark)


def bytes_of(text: Column, mark: str = ENVELOPE) -> Column:
    """The bytes that a stored text stands for."""
    return F.when(is_envelope(text, mark), F.unbase64(F.substring(text, len(mark) + 1, 2**31 - 1))).otherwise(text.cast("binary"))


def normal_body(body: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(body, "\n"), F.trim), lambda x: x != ""), "\n")


def slug(title: Column) -> Column:
    """Heading anchor: letters and digits in lower case; blanks and hyphens run together to one hyphen; the rest goes."""
    kept = F.regexp_replace(F.lower(title), r"(?U)[^\p{IsAlphabetic}\p{N}\s-]", "")
    anchor = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s-]+", "-"), "^-|-$", "")
    return F.when(anchor == "", "section").otherwise(anchor)


def compact_label(text: Column, most: int = 64) -> Column:
    """Blanks run together; over ``most`` characters: cut, with three dots."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most - 3)), F.lit("..."))).otherwise(one)


def html_escape(text: Column) -> Column:
    """Text that may stand between tags or in a quoted attribute."""
    for plain, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(said))
    return text


def percent_encode(text: Column) -> Column:
    """UTF-8 bytes as %XX, but for letters, digits and -_.~ of ASCII."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def excerpt(text: Column, most: int) -> Column:
    """struct(text, omitted): as many whole characters from the start as fit in ``most`` bytes of UTF-8, and the bytes left out."""
    whole = F.octet_length(text) <= most
    # bytes of the form 10xxxxxx go on a character, so the cut moves back to the byte that begins one
    data = text.cast("binary")
    lead = lambda k: F.conv(F.hex(F.substring(data, most + 1 - k, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) != 0x80
    cut = F.when(whole, F.octet_length(text)).when(lead(0), most).when(lead(1), most - 1).when(lead(2), most - 2).otherwise(most - 3)
    kept = F.substring(data, F.lit(1), cut).cast("string")
    return F.struct(kept.alias("text"), (F.octet_length(text) - cut).cast("long").alias("omitted"))


def parse_timestamp(text: Column) -> Column:
    """A stored time: with or without T, fractions and zone; null if it is none. Without a zone it is UTC."""
    plain = F.regexp_replace(F.trim(text), "^([0-9-]{10})T", "$1 ")
    return F.try_to_timestamp(F.when(plain.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), plain).otherwise(F.concat(plain, F.lit("Z"))))


def dedent(text: Column) -> Column:
    """The text without the blanks that all its lines with other characters begin with; lines of blanks alone become empty."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(F.translate(x, "\t", " ")) == "", F.lit("")).otherwise(x))
    lead = F.array_min(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.length(F.regexp_extract(x, "^[ \t]*", 0))))
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", x).otherwise(F.substring(x, F.coalesce(lead, F.lit(0)) + 1, F.length(x)))), "\n")


def without_banner(text: Column, banner: str) -> Column:
    """A rendered file without the banner line that its renderer puts first, after a line that names an interpreter if there is one."""
    return F.regexp_replace(text, r"\A((?:#![^\n]*\n)?)\Q" + banner + r"\E[^\n]*\n", "$1")

"""Column functions: paths, predicates, identities. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semindex.functions import constants as K

#: White space as JavaScript has it, for a Java regular expression.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACES = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.btrim(col(c), F.lit(SPACES))  # looks at the ends alone; a regular expression tries every character


def slashed(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def path_segments(c: Column | str) -> Column:
    return F.filter(F.split(col(c), "/"), lambda s: s != "")


def relative_path(c: Column | str, root: Column | str) -> Column:
    """Path below ``root``; a path outside stays as it is."""
    base = F.concat(F.regexp_replace(slashed(root), r"/+\z", ""), F.lit("/"))
    path = F.regexp_replace(slashed(c), "/+", "/")
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def file_extension(c: Column | str) -> Column:
    """Lower case, with its dot; empty for none and for dot files, "." for a trailing dot."""
    name = F.element_at(F.split(col(c), "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1))


def normalize_prefix(c: Column | str) -> Column:
    """A directory prefix as segments with "." and ".." resolved; null means no filter."""
    parts = F.filter(F.split(slashed(c), "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def fold(held: Column, part: Column) -> Column:
        up = (F.size(held) > 0) & (F.element_at(held, -1) != "..")
        return F.when((part == "..") & up, F.slice(held, 1, F.size(held) - 1)).otherwise(F.concat(held, F.array(part)))

    folded = F.aggregate(parts, empty, lambda held, part: F.when(F.size(held) == 0, F.array(part)).otherwise(fold(held, part)))
    return F.when(F.size(folded) > 0, folded)


def under_prefix(segments: Column | str, prefix: Column | str) -> Column:
    """Whole-segment prefix test; a null prefix holds for all."""
    s, p = col(segments), col(prefix)
    return p.isNull() | (F.slice(s, 1, F.greatest(F.size(p), F.lit(1))) == p)


def is_documentation_path(c: Column | str) -> Column:
    path = F.lower(slashed(c))
    out = F.endswith(path, F.lit("/readme")) | F.contains(path, F.lit("/docs/"))
    for ext in K.DOC_EXTENSIONS:
        out = out | F.endswith(path, F.lit(ext))
    return out


def is_docs_query(c: Column | str) -> Column:
    return F.lower(col(c)).rlike(K.DOC_WORDS)


def est_tokens(c: Column | str) -> Column:
    return F.ceil(F.length(col(c)) / 4).cast("long")


def apply_prefix(c: Column | str, prefix: str | None) -> Column:
    """Adds a model's prefix unless it is there or makes the text too long."""
    if not prefix:
        return col(c)
    longer = F.concat(F.lit(prefix), col(c))
    return F.when(F.startswith(col(c), F.lit(prefix)) | (est_tokens(longer) > K.MAX_ITEM_TOKENS), col(c)).otherwise(longer)


def sha256(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def collection_id(worktree: Column | str) -> Column:
    return F.concat(F.lit("ws-"), F.substring(sha256(worktree), 1, 16))


def segment_hash(path: Column | str, start: Column | str, end: Column | str, content: Column | str, offset: Column | str | None = None) -> Column:
    """Identity of a block; pieces of an overlong line have their offset in it."""
    parts = [col(path), col(start).cast("string"), col(end).cast("string")]
    tail = [F.length(col(content)).cast("string"), F.substring(col(content), 1, 100)]
    plain = sha256(F.concat_ws("-", *parts, *tail))
    if offset is None:
        return plain
    return F.when(col(offset).isNull(), plain).otherwise(sha256(F.concat_ws("-", *parts, col(offset).cast("string"), *tail)))


def uuid5(name: Column | str, namespace: str = K.POINT_NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), col(name).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays as doubles; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(col(x), col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)

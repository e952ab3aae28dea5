"""Column-level text functions (all JVM-side, inside whole-stage codegen).

Patterns use only explicit character classes (no look-around, no ``\\b``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.split()`` / ``str.strip()``; and without the blank, for Java: one by
# one below 256 (a table) and behind one range above, so that most other characters are given up after one comparison.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WS_NOT_BLANK = ("[" + "".join(f"\\x{{{ord(c):X}}}" for c in WS_CHARS if ord(c) < 256 and c != " ")
                + r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]")
# Fixed value: sentence pattern of the "punct" splitter (a run without . ! ? or
# newline, followed by its closing punctuation).
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
# Fixed value: two-character escape sequences removed from cache keys.
ESCAPE_PATTERN = r"\\[nrt]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def words(c) -> Column:
    """Python ``str.split()``: whitespace-separated pieces, empty pieces dropped.

    ``split`` compiles a pattern anew for every row, unless it is one plain character."""
    return F.array_remove(F.split(F.regexp_replace(_c(c), WS_NOT_BLANK, " "), " "), "")


def _blanked(c) -> Column:
    """Whitespace to blanks, none at the ends. Most texts have no whitespace but blanks: they are looked at, not written anew."""
    c = _c(c)
    return F.trim(F.when(c.rlike(WS_NOT_BLANK), F.regexp_replace(c, WS_NOT_BLANK, " ")).otherwise(c))


def joined_words(c) -> Column:
    """The words joined by one blank; cut into words only where two blanks meet."""
    t = _blanked(c)
    return F.when(t.contains("  "), F.array_join(F.array_remove(F.split(t, " "), ""), " ")).otherwise(t)


def word_count(c) -> Column:
    """Number of whitespace-separated words."""
    t = _blanked(c)
    blanks = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(~t.contains("  ") & (t != ""), blanks + 1).otherwise(F.size(words(c)))


def truncate_tokens(c, max_tokens: int) -> Column:
    """First ``max_tokens`` words joined by one blank."""
    return F.array_join(F.slice(words(c), 1, max_tokens), " ")


def cache_key(c) -> Column:
    """Normalised text used as the key of the score cache.

    Drops literal backslash escapes (\\n \\r \\t), strips whitespace, strips
    single quotes, lower-cases, strips whitespace again.
    """
    s = F.regexp_replace(_c(c), ESCAPE_PATTERN, "")
    s = strip_ws(s)
    s = F.btrim(s, F.lit("'"))
    return strip_ws(F.lower(s))


def sentence_pieces(c, mode="punct") -> Column:
    """Raw sentence pieces of a text as ``ARRAY<STRING>``.

    ``newline``: one piece per line; ``punct``: runs closed by . ! ?; or the user's own
    splitter (P3), a function from the text column to such an array column.
    """
    if callable(mode):
        return mode(_c(c))
    if mode == "newline":
        return F.split(_c(c), "\n")
    if mode == "punct":
        return F.regexp_extract_all(_c(c), F.lit(SENTENCE_PATTERN), 0)
    raise ValueError(f"unknown sentence mode {mode!r}")


def lm_tokens(c) -> Column:
    """Tokens for the n-gram language model: lower-cased words."""
    return words(F.lower(_c(c)))


def lm_text(c) -> Column:
    """The tokens of :func:`lm_tokens`, joined by one blank."""
    return joined_words(F.lower(_c(c)))

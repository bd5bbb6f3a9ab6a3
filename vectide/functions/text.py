"""Text cleaning and chunking as column expressions.

Everything stays in the JVM. Word characters are spelled out as Unicode
classes because Java's ``\\w`` is ASCII by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character rules of the cleaner.
WORD = r"[\p{L}\p{N}_]"
CID_MARK = r"\(cid:\p{Nd}+\)"
DOUBLE_SPACE = "  "

# A hyphen between word characters, with the word after it. Searching for the
# hyphen instead of for words keeps the scan linear and cheap: `WORD+-WORD+`
# rescans a long word from each of its characters. `(?<!\\G-)` skips a hyphen
# that follows the previous match directly, because that match has used up the
# word between them.
HYPHENATED = rf"-(?<={WORD}-)(?<!\G-)({WORD}++)"


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_spaces(text: Column) -> Column:
    """Runs of U+0020 become one; other white space is left alone."""
    return F.regexp_replace(text, " {2,}", " ")


def fix_dot_comma(text: Column) -> Column:
    return F.replace(text, F.lit(".,"), F.lit("."))


def strip_newlines_tabs(text: Column, newline: str = "") -> Column:
    """Newlines go first, then ``.,`` is repaired, then tabs go.

    The order is visible in the result: ``.,`` that appears when a newline
    vanishes is repaired, one that appears when a tab vanishes is not.
    ``newline=" "`` keeps words on adjacent lines apart.
    """
    without_newlines = F.replace(text, F.lit("\n"), F.lit(newline))
    return F.replace(fix_dot_comma(without_newlines), F.lit("\t"), F.lit(""))


def join_hyphenated(text: Column) -> Column:
    """``well-known`` becomes ``wellknown``; one pass turns ``a-b-c`` into ``ab-c``."""
    return F.regexp_replace(text, HYPHENATED, "$1")


def strip_cid(text: Column) -> Column:
    """Glyph placeholders such as ``(cid:12)`` become one space."""
    return F.regexp_replace(text, CID_MARK, " ")


def strip_lead_space(text: Column) -> Column:
    return F.regexp_replace(text, "^ ", "")


def clean_pass(text: Column, newline: str = "") -> Column:
    return strip_cid(join_hyphenated(strip_newlines_tabs(collapse_spaces(text), newline)))


def clean_text(text: Column, newline: str = "") -> Column:
    """Repeat the cleaning pass while double spaces reappear, to the exact end.

    Only a placeholder that appears in a pass can ask for another one, and only
    joining hyphens can make a new placeholder. Each pass halves a hyphen
    chain, so a text with h hyphens left needs at most ``length(bin(h)) + 1``
    more passes. That per-row bound makes the loop finite without a cut-off.
    """

    def repeat(once: Column) -> Column:
        hyphens = F.length(once) - F.length(F.replace(once, F.lit("-"), F.lit("")))
        rounds = F.sequence(F.lit(1), F.length(F.bin(hyphens)) + 1)
        finished = F.aggregate(
            rounds,
            once,
            lambda acc, _: F.when(F.contains(acc, F.lit(DOUBLE_SPACE)), clean_pass(acc, newline)).otherwise(acc),
        )
        return F.when(F.contains(once, F.lit(DOUBLE_SPACE)), finished).otherwise(once)

    return strip_lead_space(_bind(clean_pass(text, newline), repeat))


def check_chunking(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("chunking needs size >= 1 and 0 <= overlap < size")


def chunk_count(text: Column, size: int = 1000, overlap: int = 20) -> Column:
    """Number of chunks of a text, without building them."""
    check_chunking(size, overlap)
    step = size - overlap
    return F.floor((F.length(text).cast("bigint") + (step - 1)) / F.lit(step)).cast("bigint")


def chunk_array(text: Column, size: int = 1000, overlap: int = 20, drop_overlap_tail: bool = False) -> Column:
    """Overlapping chunks of ``size`` code points, starting every ``size - overlap``.

    The text is cut once into strides, and each chunk is glued from the strides
    it covers, so the work is linear in the text. Taking ``substring`` at every
    start would rescan the UTF-8 text from its beginning for every chunk.
    """
    check_chunking(size, overlap)
    step = size - overlap
    strides = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    covered = -(-size // step)

    def glue(parts: Column) -> Column:
        chunks = F.transform(
            parts,
            lambda _, i: F.substring(F.array_join(F.slice(parts, i + 1, F.lit(covered)), ""), 1, size),
        )
        if drop_overlap_tail and overlap:
            chunks = F.filter(chunks, lambda c, i: (i == 0) | (F.length(c) > overlap))
        return chunks

    return _bind(strides, glue)


def digest_of(filename: Column, directory: str = "data", strict: bool = False) -> Column:
    """Sidecar key of a file name.

    The default removes every ``.pdf``, every occurrence of the directory name
    and every backslash, wherever they stand. ``strict`` removes only the
    leading directory and the final suffix.
    """
    if strict:
        base = F.regexp_replace(filename, r"^.*[/\\]", "")
        return F.regexp_replace(base, r"\.pdf$", "")
    key = F.replace(filename, F.lit(".pdf"), F.lit(""))
    if directory:
        key = F.replace(key, F.lit(directory), F.lit(""))
    return F.replace(key, F.lit("\\"), F.lit(""))


def size_as_string(size: Column) -> Column:
    return size.cast("string")


def date_prefix(date: Column) -> Column:
    return F.substring(date, 1, 10)

"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines.

Words are numbered within their document, and rolling hashes of several n-gram
lengths are taken over the numbers in numpy. Windows with equal hashes are
compared word by word before they count, so the figures are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectide.llm.common import SPACES, fresh, quoted

SYMBOLS = "#*$%&|<>"
#: Window of the base rule.
WINDOW = 5
#: Largest share of the characters of words that may lie in duplicated n-grams, by n (published rules for web text).
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share that the most frequent n-gram may cover if seen three times or more, by n.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of the characters of words on lines that repeat an earlier line.
LINE_SHARE = 0.20
LEAST_WORDS = 10

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


@dataclass
class Repetition:
    """Figures of one text; shares are of the characters of its words."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    dup_line_share: float = 0.0
    dup_share: dict[int, float] | None = None
    top_share: dict[int, float] | None = None


def _classes(words: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of their class, and where in that order a new class begins."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    begins = np.ones(len(order), bool)
    begins[1:] = ranked[1:] != ranked[:-1]
    same = np.flatnonzero(~begins)
    differ = np.zeros(len(same), bool)
    for j in range(n):
        differ |= words[order[same] + j] != words[order[same - 1] + j]
    if differ.any():  # two windows share a hash by chance: order by the words themselves
        windows = np.lib.stride_tricks.sliding_window_view(words, n)
        order = np.lexsort(windows.T[::-1])
        begins[1:] = (windows[order[1:]] != windows[order[:-1]]).any(axis=1)
    return order, begins


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` words at one of the starts."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)[: size + 1]
    return np.cumsum(edge[:size]) > 0


def measure(text: str) -> Repetition:
    """All figures of one text."""
    body = text.encode()
    words = body.split()
    found = Repetition(
        n_words=len(words), word_chars=len(text) - sum(map(text.count, SPACES)), n_symbols=sum(map(text.count, SYMBOLS)),
        dup_share=dict.fromkeys(DUPLICATED, 0.0), top_share=dict.fromkeys(TOP, 0.0))
    if not words:
        return found
    seen: set[bytes] = set()
    repeated_line_chars = 0
    plain = body.isascii()
    for line in body.split(b"\n"):
        held = line.split()
        if held:
            if line in seen:
                found.n_dup_lines += 1
                repeated_line_chars += sum(map(len, held)) if plain else sum(len(word.decode()) for word in held)
            else:
                seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lengths = np.fromiter((len(w if plain else w.decode()) for w in numbers), np.int64, len(numbers))[ids]
    total = int(lengths.sum())
    found.dup_line_share = repeated_line_chars / total
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    through = np.concatenate([[0], np.cumsum(lengths)])
    rolling = mixed.copy()
    for n in range(2, max([*DUPLICATED, *TOP, WINDOW]) + 1):
        if len(ids) < n:
            break
        rolling = rolling[:-1] * _BASE + mixed[n - 1:]
        if n not in DUPLICATED and n not in TOP and n != WINDOW:
            continue
        order, begins = _classes(ids, rolling, n)
        first = np.flatnonzero(begins)
        counts = np.diff(np.append(first, len(order)))
        if counts.max() < 2:
            if n == WINDOW or n in DUPLICATED:
                break  # longer windows repeat even less
            continue
        if n in TOP:
            spans = (through[n:] - through[:-n])[order[first]]
            often = np.where(counts > 2, counts * spans, 0)  # seen twice may be chance in a short text
            at = int(np.argmax(often))
            if often[at]:
                mine = order[first[at]: first[at] + counts[at]]
                found.top_share[n] = float(lengths[_covered(mine, n, len(ids))].sum()) / total
        if n == WINDOW:
            found.n_repeat_words = int(_covered(order[np.repeat(counts > 1, counts)], n, len(ids)).sum())
        if n in DUPLICATED:
            found.dup_share[n] = float(lengths[_covered(order[~begins], n, len(ids))].sum()) / total
    return found


def verdict(found: Repetition) -> tuple[bool, bool]:
    """(fails the base rule, is kept)."""
    failed = found.n_words < LEAST_WORDS or 100 * found.n_repeat_words > 20 * found.n_words
    repeats = (found.dup_line_share > LINE_SHARE
               or any(found.dup_share[n] > most for n, most in DUPLICATED.items())
               or any(found.top_share[n] > most for n, most in TOP.items()))
    return failed, not (failed or repeats)


FIGURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
    "dup_line_share": pa.float64(), "top_gram_share": pa.float64(), "dup_gram_share": pa.float64(),
}
_SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus the figures and the verdict of each row; one pass, no shuffle.

    ``top_gram_share`` and ``dup_gram_share`` are the largest over the n-gram
    lengths. Edge cases: a null or empty text has no words, zero figures, and
    fails the base rule. Repeated rows are judged alike; no rows give no rows.
    Figures get a trailing ``_`` where names clash.
    """
    carry = docs.columns if carry is None else carry
    names = fresh(carry, *FIGURES)
    [body] = fresh([*carry, *names], "body")
    source = docs.select(*[quoted(name) for name in carry], quoted(text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                found = measure(value.as_py() or "")
                rows.append((found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words,
                             *verdict(found), found.dup_line_share, max(found.top_share.values()), max(found.dup_share.values())))
            columns = list(zip(*rows)) if rows else [[] for _ in FIGURES]
            made = [pa.array(c, kind) for c, kind in zip(columns, FIGURES.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*carry, *names])

    kinds = {field.name: field.dataType.simpleString() for field in source.schema.fields[:-1]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"`{c}` {_SQL[k]}" for c, k in zip(names, FIGURES.values()))])
    return source.mapInArrow(run, schema)

"""Align the tokens of two tokenizers by merge-path partitioning of their ends.

Both token sequences of a text cover the same bytes. Merging their sorted ends
shows what overlaps: before an end is consumed, the current tokens of both
sides share bytes. The merge is a path through the grid of both sequences, and
a binary search along a diagonal of the grid finds the place where the path
crosses it. Diagonals at equal distances so cut the merge into pieces of equal
work that need nothing of each other. All pieces advance in step, one end each,
as vectors. A piece emits its overlaps and counts the groups that close in it;
the counts of the pieces before it, added up, number the groups across borders.
Texts are put one behind the other first: a text ends for both sides at once,
so many short texts and one very long one give the same even pieces.

How often a pair of ids is linked is counted in documents over the whole corpus:

1. one pass writes each text's figures and its distinct linked pairs, packed;
2. each task counts the pairs of its texts, and the counts are added up by pair.
   There are at most as many as the two vocabularies allow, however large the
   corpus is;
3. the counts go to the texts in slices of bounded size, sorted, and every
   slice is looked up from the packed pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm import bpe, pieces
from vectide.llm.common import fresh, quoted
from vectide.session import materialize

#: Ends that a piece merges.
PIECE = 256
#: Bytes of text that are aligned at a time; a longer text is aligned by itself.
AT_ONCE = 1 << 18
#: Pairs whose counts a task holds before it sends them.
HELD_PAIRS = 2_000_000
#: Pairs in a slice of the counts that is sent to the tasks: 16 bytes each.
SLICE_PAIRS = 4_000_000
_NONE = np.zeros(0, "<u4")


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first ``diagonals`` ends of the merge, by binary search along each diagonal; ``a`` first at ties."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        first = a[middle] <= b[diagonals[open_] - 1 - middle]
        low[open_] = np.where(first, middle + 1, low[open_])
        high[open_] = np.where(first, high[open_], middle)
    return low


class Alignment:
    """Links and groups of two sequences of ends that close together."""

    def __init__(self, a: np.ndarray, b: np.ndarray, piece: int = PIECE):
        total = len(a) + len(b)
        cuts = np.append(np.arange(0, total, piece), total)
        at_a = crossings(a, b, cuts)
        i, j = at_a[:-1].copy(), cuts[:-1] - at_a[:-1]
        steps = np.diff(cuts)
        #: whether the end that a piece consumes in each step is one of ``a``
        from_a = np.zeros((piece, len(i)), bool)
        far = np.iinfo(np.int64).max
        ends_a, ends_b = np.append(a, far), np.append(b, far)
        for step in range(int(steps.max(initial=0))):
            live = slice(0, len(i) if step < steps[-1] else len(i) - 1)  # only the last piece may be shorter
            taken = ends_a[i[live]] <= ends_b[j[live]]
            from_a[step, live] = taken
            i[live] += taken
            j[live] += ~taken
        # Stitching: what a piece consumed and closed is counted on from the pieces before it.
        taken = from_a.T.ravel()[:total]
        of_a = np.cumsum(taken) - taken
        of_b = np.arange(total) - of_a
        closes = ~taken
        closes[closes] = ends_a[of_a[closes] - 1] == ends_b[of_b[closes]]
        closes &= of_a > 0
        group = np.cumsum(closes) - closes
        self.group_a, self.group_b = group[taken], group[~taken]
        self.groups = int(closes.sum())
        self.link_a, self.link_b = of_a[~closes], of_b[~closes]


def _spelled(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits of every number up to ``most``, left-aligned with room for a separator; how many digits)."""
    width = len(str(most)) + 1
    table = np.array([str(i).ljust(width) for i in range(most + 1)], f"S{width}")
    return table.view(np.uint8).reshape(most + 1, width).copy(), np.array([len(str(i)) for i in range(most + 1)], np.int64)


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, a: str, b: str):
        self.a = bpe.vocabulary(a if "/" in a else bpe.installed(a))
        self.b = pieces.pieces(b)
        self.ids_b = len(self.b.pieces)
        self.digits, self.digit_counts = _spelled(max(len(self.a.lengths), self.ids_b))

    def _tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; none where their bytes are not those of the text behind a space."""
        both = [(self.a.encode(" " + text, plain=True), self.b.encode(text)) if text else (_NONE, _NONE) for text in texts]
        bodies = [b" " + text.encode() if text else b"" for text in texts]
        if not all(self._give(k, both, bodies) for k in (0, 1)):  # some text fails: look for it
            both = [ids if all(self._give(k, [ids], [body]) for k in (0, 1)) else (_NONE, _NONE) for ids, body in zip(both, bodies)]
        return both

    def _give(self, side: int, both: list[tuple[np.ndarray, np.ndarray]], bodies: list[bytes]) -> bool:
        """Whether the tokens of a side stand for just these bytes, text by text."""
        own, ids = (self.a, self.b)[side], np.concatenate([pair[side] for pair in both]).astype(np.int64)
        through = np.concatenate([[0], np.cumsum(own.lengths[ids])])
        ends = through[np.cumsum([len(pair[side]) for pair in both])]
        return np.array_equal(ends, np.cumsum(list(map(len, bodies)))) and own.token_bytes(ids) == b"".join(bodies)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """Of each text: n_a, n_b, n_groups, n_links, groups, distinct linked pairs (``a * ids of b + b``), and how often each is linked."""
        both = self._tokens(texts)
        n_a, n_b = (np.array([len(ids[k]) for ids in both], np.int64) for k in (0, 1))
        a, b = (np.concatenate([ids[k] for ids in both]).astype(np.int64) for k in (0, 1))
        found = Alignment(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(doc_a, np.append(found.group_a[1:] != found.group_a[:-1], True) if len(a) else None, len(texts)).astype(np.int64)
        doc = doc_a[found.link_a]
        n_links = np.bincount(doc, minlength=len(texts))
        span = len(self.a.lengths) * self.ids_b
        keys, times = np.unique(doc * span + a[found.link_a] * self.ids_b + b[found.link_b], return_counts=True)
        ends = np.searchsorted(keys, np.arange(1, len(texts) + 1) * span)
        shown, cuts = self._shown(a, b, found, n_a + n_b)
        rows = []
        for d, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            rows.append((int(n_a[d]), int(n_b[d]), int(n_groups[d]), int(n_links[d]), shown[cuts[d]:max(cuts[d], cuts[d + 1] - 1)],
                         keys[start:end] - d * span, times[start:end]))
        return rows

    def _shown(self, a: np.ndarray, b: np.ndarray, found: Alignment, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all texts, and where each text begins."""
        per_a, per_b = np.bincount(found.group_a, minlength=found.groups), np.bincount(found.group_b, minlength=found.groups)
        place_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[found.group_a]
        place_b = np.arange(len(b)) + np.cumsum(per_a)[found.group_b]
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        after[place_a[np.cumsum(per_a) - 1]] = ord("|")
        after[place_b[np.cumsum(per_b) - 1]] = ord(";")
        rows, sizes = self.digits[ids], self.digit_counts[ids]
        rows[np.arange(len(ids)), sizes] = after
        flat = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
        through = np.concatenate([[0], np.cumsum(sizes + 1)])
        return flat, through[np.concatenate([[0], np.cumsum(tokens)])]


def _delta(keys: np.ndarray) -> bytes:
    return np.diff(keys, prepend=0).astype("<u4" if not len(keys) or keys[-1] < 1 << 32 else "<u8").tobytes()


def _keys(packed: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<u4" if len(packed) == 4 * count else "<u8").astype(np.int64))


def _packed_times(times: np.ndarray) -> bytes:
    """Places and values of the counts above one."""
    several = np.flatnonzero(times > 1)
    return np.stack([several, times[several]]).astype("<u4").tobytes()


def _times(packed: bytes, count: int) -> np.ndarray:
    times = np.ones(count, np.int64)
    place, value = np.frombuffer(packed, "<u4").reshape(2, -1)
    times[place] = value
    return times


_FIGURES = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}


def _aligned(docs: DataFrame, a: str, b: str, text: str, carry: list[str], names: list[str], packed: list[str], groups: bool) -> DataFrame:
    """``carry``, the figures, the groups if asked for, and the packed pairs of each text."""
    [body] = fresh([*carry, *names, *packed], "body")
    given = docs.select(*[quoted(c) for c in carry], quoted(text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(a, b)
        for batch in batches:
            texts, start = batch.column(batch.num_columns - 1).to_pylist(), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or "") <= AT_ONCE):
                    size += len(texts[end] or "")
                    end += 1
                rows = []
                for n_a, n_b, n_groups, n_links, shown, keys, times in own.align(texts[start:end]):
                    digest = hashlib.sha256(shown).hexdigest() if n_a else ""
                    rows.append((n_a, n_b, n_groups, n_links, digest, *([shown.decode()] if groups else []), len(keys), _delta(keys), _packed_times(times)))
                kinds = [*_FIGURES.values(), *([pa.string()] if groups else []), pa.int64(), pa.binary(), pa.binary()]
                made = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns[:-1], *made], names=[*carry, *names, *packed])
                start = end

    kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields[:-1]}
    made = ["long"] * 4 + ["string"] * (2 if groups else 1)
    schema = [*(f"`{c}` {kinds[c]}" for c in carry), *(f"`{c}` {k}" for c, k in zip(names, made)),
              f"`{packed[0]}` long, `{packed[1]}` binary, `{packed[2]}` binary"]
    return given.mapInArrow(run, ", ".join(schema))


def _pair_counts(rows: DataFrame, packed: list[str]) -> DataFrame:
    """``key, documents`` of every linked pair; tasks add up what they have before they send it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def added(parts):
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def sent(part):
            return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], names=["key", "documents"])

        for batch in batches:
            for count, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
                if count:
                    held.append((_keys(keys.as_py(), count), np.ones(count, np.int64)))
                    waiting += count
                if waiting > HELD_PAIRS:
                    held = [added(held)]
                    waiting = 0
                    if len(held[0][0]) > HELD_PAIRS:
                        yield sent(held.pop())
        if held:
            yield sent(added(held))

    return rows.select(packed[0], packed[1]).mapInArrow(run, "key long, documents long").groupBy("key").agg(F.sum("documents").alias("documents"))


def _slices(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of keys that hold about ``most`` pairs at most, together all of them."""
    total = counts.count()
    wanted = -(-total // most)
    if wanted < 2:
        return [(0, 1 << 62)]
    places = ", ".join(str(k / wanted) for k in range(1, wanted))
    cuts = counts.select(F.expr(f"approx_percentile(key, array({places}), 100000)")).first()[0]
    return list(zip([0, *cuts], [*cuts, 1 << 62]))


def align(docs: DataFrame, a: str, b: str, text: str = "text", carry: list[str] | None = None, with_groups: bool = False,
          slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """``carry`` (all columns unless given) plus n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum, and ``groups`` if asked for.

    ``a`` is the file of a byte-level BPE vocabulary, ``b`` of a byte-fallback
    piece model, as paths on every executor or names of the installed package.
    A reads the text behind a space, B adds it itself; strings of special
    tokens are plain text. Links are all pairs of token occurrences that share
    bytes, groups end where tokens of both end. A pair of ids counts the rows
    that hold it linked; ``n_best`` are links whose count no other pair of
    their A id exceeds, ``count_sum`` adds up the counts over links.

    Edge cases: null and empty texts, and texts whose bytes either side does
    not give back, have no tokens: zeros, and an empty digest. Texts of any
    length are aligned whole; repeated rows alike, and each counts as a row.
    Null ids and an empty table are no special case. New columns get a
    trailing ``_`` where names clash.
    """
    carry = docs.columns if carry is None else carry
    wanted = [*_FIGURES, *(["groups"] if with_groups else [])]
    names = fresh(carry, *wanted, "n_best", "count_sum")
    names, sums = names[:len(wanted)], names[len(wanted):]
    packed = fresh([*carry, *names, *sums], "pairs", "keys", "times")
    [row] = fresh([*carry, *names, *sums, *packed], "row")
    rows = materialize(_aligned(docs, a, b, text, carry, names, packed, with_groups).withColumn(row, F.monotonically_increasing_id()), "aligned")
    spark = docs.sparkSession
    a_path = a if "/" in a else bpe.installed(a)
    ids_b = len(pieces.pieces(b).pieces)
    own = F.expr(f"key div {ids_b}")
    # At most as many rows of one id as the other vocabulary has ids.
    best = F.max("documents").over(Window.partitionBy(own))
    counts = materialize(_pair_counts(rows, packed).withColumn("best", F.col("documents") == best), "pair-counts")

    def looked_up(low: int, high: int, keep: list[str]) -> DataFrame:
        """``keep`` of each row, with the sums over its pairs in a range of keys."""
        part = counts if high - low == 1 << 62 else counts.filter((F.col("key") >= low) & (F.col("key") < high))
        part = part.select("key", (F.col("documents") * 2 + F.col("best").cast("long")).alias("value")).toArrow()
        order = np.argsort(key := part.column(0).to_numpy())
        sent = spark.sparkContext.broadcast((key[order], part.column(1).to_numpy()[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, values = sent.value
            for batch in batches:
                n_best, total = [], []
                for count, keys, times in zip(*(c.to_pylist() for c in batch.columns[-3:])):
                    keys, times = _keys(keys, count), _times(times, count)
                    inside = (keys >= low) & (keys < high)
                    found = values[np.searchsorted(known, keys[inside])]
                    n_best.append(int((times[inside] * (found & 1)).sum()))
                    total.append(int((times[inside] * (found >> 1)).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=[*keep, *sums])

        given = rows.select(*[quoted(c) for c in [*keep, *packed]])
        kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields}
        return given.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` long" for c in sums)]))

    ranges = _slices(counts, slice_pairs)
    if len(ranges) == 1:
        return looked_up(*ranges[0], [*carry, *names])
    parts = reduce(DataFrame.unionByName, [looked_up(*r, [row]) for r in ranges])
    added = parts.groupBy(row).agg(*[F.sum(c).alias(c) for c in sums])
    return rows.join(added, row).select(*[quoted(c) for c in [*carry, *names, *sums]])

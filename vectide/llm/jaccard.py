"""Exact Jaccard self-join of shingle sets by PartEnum signatures, and the groups its links form.

Sets are banded by size. Within a band the domain of shingles is cut into
``n1`` parts of ``n2`` pieces each. Two sets that differ in few elements differ
in at most ``k2`` pieces of some part, so a signature of the elements in all
but ``k2`` pieces of that part is common to both: every linked pair shares a
signature. Pairs that share one are compared on their whole sets.

How the work is spread:

- Rows with the same set form one class and only one of them goes on.
- Signatures travel packed, cut into blocks by their remainder, 11 bytes
  each. What is joined are these blocks, not a row for each signature.
- Under one signature a class is linked to the first one (a star), not to all.
  Classes that the comparison finds equal enough are then one component, and
  only pairs of different components are looked at again, so that a group of
  thousands of near copies costs as many comparisons as it has members.
- Those pairs are ruled out by parity sketches inside tasks; only the few that
  pass become rows, and their whole sets are read. A class is sent once for
  each leader it has, not for each signature, and what is under one leader is
  cut into pieces of bounded size. The time for texts that are like each other
  but not linked still grows with the square of their number under a leader.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import fresh, key_filter, may_hold, quoted, tidy, tidy_groups
from vectide.session import drop_scratch, materialize

#: Words of a shingle; link when ``100 * intersection >= PERCENT * union``.
SHINGLE, PERCENT = 5, 80
#: Pieces of a part. One piece is left out of a signature, so one may differ.
PIECES = 3
#: Classes whose signatures a task packs into one row for each block.
PACKED = 20_000
#: Bytes of a signature on its way, besides its block. Two that agree in them by chance cost a comparison.
SIGNATURE = 5
#: Signatures that a byte of text gives, about, and bytes of them in a block; sizes the blocks, changes no result.
PER_BYTE, BLOCK_BYTES = 0.14, 32 << 20

#: Classes, and bytes of their sketches, on a side of the pieces in which the members of a leader are compared.
SIDE, SIDE_BYTES = 1_024, 32 << 20
#: Bytes of the sets in a part when pairs are verified, and the least number of parts.
PART_BYTES, LEAST_PARTS = 8 << 20, 4
#: Most rows of keys and numbers that are sent to the tasks, so that the sets or texts they are joined to stay where they are.
BROADCAST_ROWS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors of the words of a shingle by their place.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(SHINGLE + 1)], np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text, sorted. ``known`` remembers the hashes of words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    try:
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    rolled = np.full(len(words) - n + 1, _FACTORS[n])
    for j in range(n):
        rolled += hashes[j:len(words) - n + 1 + j] * _FACTORS[j]
    rolled = _mixed(rolled)
    rolled.sort()
    return rolled[np.append(True, rolled[1:] != rolled[:-1])]


def sketch(elements: np.ndarray) -> bytes:
    """Parities of the number of the set's elements in each of one to two times as many cells.

    Each element in which two sets differ flips one bit, so they differ in at
    least as many elements as bits. Pairs with too many are out before their
    sets are moved, and hardly any pair below the limit gets by.
    """
    cells = max(8, 2 << max(0, int(len(elements)).bit_length() - 1))
    counts = np.bincount((elements >> np.uint64(7)).astype(np.int64) & (cells - 1), minlength=cells)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with ``size`` bytes, at most as many as it has."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def may_link(n_a: int, n_b: int, a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """False only for pairs that can't be linked, by their sizes and sketches."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
    return (100 + percent) * differ <= (100 - percent) * (n_a + n_b)


def possible_pairs(left: tuple, right: tuple, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in left and right of the pairs of different roots that may be linked. Each side: roots, sizes, sketches.

    All sketches are folded to the shortest one and compared in slices of
    bounded size; only pairs that may be linked come out.
    """
    size = min(map(len, [*left[2], *right[2]]))
    wide = [np.zeros((len(side[2]), -(-size // 8) * 8), np.uint8) for side in (left, right)]
    for rows, side in zip(wide, (left, right)):
        for i, bits in enumerate(side[2]):
            rows[i, :size] = _folded(bits, size)
    x, y = (rows.view(np.uint64) for rows in wide)
    step = max(1, 500_000 // (len(y) * y.shape[1]))
    for at in range(0, len(x), step):
        roots, sizes = left[0][at:at + step, None], left[1][at:at + step, None]
        differ = np.bitwise_count(x[at:at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
        ok = (100 + percent) * differ <= (100 - percent) * (sizes + right[1])
        ok &= (roots != right[0]) & (100 * np.minimum(sizes, right[1]) >= percent * np.maximum(sizes, right[1]))
        i, j = np.nonzero(ok)
        yield i + at, j


class Bands:
    """Bands of set sizes, and the parts of the domain in each."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.last = [0]

    def _reach(self, size: int) -> int:
        """Largest size that a set linked to one of ``size`` elements may have."""
        return size * 100 // self.percent

    def of(self, size: int) -> int:
        """Number of the band of a size, from 1."""
        while self.last[-1] < size:
            self.last.append(self._reach(self.last[-1] + 1))
        return int(np.searchsorted(self.last, size))

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, parts that may have two differences or more) of pairs whose larger set is in the band."""
        while len(self.last) <= band:
            self.last.append(self._reach(self.last[-1] + 1))
        bad = floor(2 * self.last[band] * (100 - self.percent) / (100 + self.percent)) // 2
        return bad + 1 + bad // 16 + 2 * (bad > 0), bad

    def asked(self, size: int) -> list[int]:
        """Bands whose pairs may hold a set of this size: its own, and the one that a larger partner may be in."""
        own = self.of(size)
        return [own] if self.of(self._reach(size)) == own else [own, own + 1]


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set: for each part of each band, for each piece left out.

    A signature of no element at all says nothing. A linked pair spoils at most
    ``bad`` parts, so where more than ``bad`` parts of a set have no empty
    signature, one of those is shared, and the empty ones are left away. The
    few sets for which that does not hold keep them.
    """
    made = []
    value = _mixed(elements ^ _ODD)
    for band in bands.asked(len(elements)):
        parts, bad = bands.parts(band)
        drawn = (elements * _FACTORS[band % SHINGLE]) >> np.uint64(32)
        cell = ((drawn * np.uint64(parts * PIECES)) >> np.uint64(32)).astype(np.uint16 if parts * PIECES < 1 << 16 else np.int64)
        order = np.argsort(cell, kind="stable")
        through = np.concatenate([[np.uint64(0)], np.cumsum(value[order], dtype=np.uint64)])
        ends = np.cumsum(np.bincount(cell, minlength=parts * PIECES))
        sums = np.diff(through[np.concatenate([[0], ends])]).reshape(parts, PIECES)
        full = np.diff(np.concatenate([[0], ends])).reshape(parts, PIECES) > 0
        rest = full.sum(axis=1)[:, None] - full
        keep = np.ones((parts, PIECES), bool)
        if (rest.min(axis=1) > 0).sum() > bad:
            keep = rest > 0
        kept = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        label = np.arange(parts * PIECES, dtype=np.uint64).reshape(parts, PIECES) + np.uint64(band << 40)
        made.append(_mixed(_mixed(kept) + _mixed(label))[keep])
    return np.concatenate(made)


def _class_key(elements: np.ndarray) -> int:
    """64 bits of a digest of a whole set."""
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def _with_class(docs: DataFrame, text: str, carry: list[str], key: str, n: str, drawn: str) -> DataFrame:
    """``carry`` plus the class of the row's set, its size and its sketch."""
    given = docs.select(*[quoted(c) for c in carry], quoted(text).alias(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for value in batch.column(batch.num_columns - 1):
                found = shingles(value.as_py(), known)
                keys.append(_class_key(found))
                sizes.append(len(found))
                sketches.append(sketch(found))
            made = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*carry, key, n, drawn])

    kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields[:-1]}
    return given.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), f"`{key}` long, `{n}` long, `{drawn}` binary"]))


def _blocks(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """``block, signatures, owners, classes``: packed signatures; ``owners`` are places in ``classes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        bands, done = Bands(), set()
        held: list[np.ndarray] = []
        keys: list[int] = []

        def packed() -> pa.RecordBatch:
            sigs = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            block = (sigs % np.uint64(blocks)).astype(np.uint16 if blocks < 1 << 16 else np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
            sigs, owner, rows = sigs[order], owner[order], []
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                short = np.ascontiguousarray((sigs[part] // np.uint64(blocks)).view(np.uint8).reshape(-1, 8)[:, :SIGNATURE])
                used, place = np.unique(owner[part], return_inverse=True)
                rows.append((int(b), short.tobytes(), place.astype(np.uint16).tobytes(), np.array(keys, np.int64)[used].tobytes()))
            held.clear(), keys.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["block", "signatures", "owners", "classes"])

        entries = 0
        for batch in batches:
            for value in batch.column(0):
                found = shingles(value.as_py(), known)
                if not len(found) or (key := _class_key(found)) in done:
                    continue  # a task sends each class once
                if len(done) > 1_000_000:
                    done.clear()
                done.add(key)
                held.append(signatures(found, bands))
                keys.append(key)
                entries += len(held[-1])
                if len(held) >= PACKED or entries > 2_000_000:
                    yield packed()
                    entries = 0
        if held:
            yield packed()

    return docs.select(quoted(text)).mapInArrow(tidy(run), "block int, signatures binary, owners binary, classes binary")


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block: ``leader, members`` for each signature of two classes or more; equal lists once."""
    sigs, classes = [], []
    for short, owners, own in zip(rows["signatures"], rows["owners"], rows["classes"]):
        wide = np.zeros((len(short) // SIGNATURE, 8), np.uint8)
        wide[:, :SIGNATURE] = np.frombuffer(short, np.uint8).reshape(-1, SIGNATURE)
        sigs.append(wide.view(np.uint64).ravel())
        classes.append(np.frombuffer(own, np.int64)[np.frombuffer(owners, np.uint16)])
    sig, of = np.concatenate(sigs), np.concatenate(classes)
    order = np.lexsort((of, sig))
    sig, of = sig[order], of[order]
    fresh_ = np.append(True, (sig[1:] != sig[:-1]) | (of[1:] != of[:-1]))  # a class may come from several tasks
    sig, of = sig[fresh_], of[fresh_]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    counts = np.diff(np.append(first, len(sig)))
    lists = {of[f:f + c].tobytes() for f, c in zip(first[counts > 1], counts[counts > 1])}
    return pd.DataFrame({"leader": [int(np.frombuffer(x[:8], np.int64)[0]) for x in lists],
                         "members": pd.Series([np.frombuffer(x[8:], np.int64) for x in lists], dtype=object)})


def _elements(docs: DataFrame, text: str, doc_id: str, wanted: DataFrame) -> DataFrame:
    """``class, elements`` of the classes in ``wanted`` (class, id): read from one document each.

    The ids go to the tasks as a table of bits, sized from their number;
    documents that are in it by chance find no pair in the joins that follow.
    """
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64("id").alias("id")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        done: set[int] = set()
        for batch in batches:
            hits = np.flatnonzero(may_hold(sent.value, batch.column(0).to_numpy()))
            keys, sets = [], []
            for i in hits:
                found = shingles(batch.column(1)[int(i)].as_py(), known)
                key = _class_key(found)
                if len(found) and key not in done:
                    done.add(key) if len(done) < 1_000_000 else None
                    keys.append(key)
                    sets.append(found.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["class", "elements"])

    given = docs.select(F.xxhash64(quoted(doc_id)), quoted(text))
    found = given.mapInArrow(tidy(run), "class long, elements binary")
    # A chosen id may come with other texts as well, and copies of one id with the same one.
    # Either is harmless to the joins that follow: links are only ever counted as there or not.
    return found


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that sizes and sketches don't rule out."""
    own = classes.select("class", "n", "sketch")
    both = pairs.join(own.withColumnsRenamed({"class": "b", "n": "nb", "sketch": "sb"}), "b").join(
        own.withColumnsRenamed({"class": "a", "n": "na", "sketch": "sa"}), "a")
    both = both.filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_link(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def _possible_under_leaders(stars: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes of different roots that have a leader in common and may be linked. A scratch table is behind them.

    ``stars`` are (leader, member) of all signatures. The members of a leader
    go to a task with their sketches, many of them in square pieces of bounded
    size. No row is made for a pair before its sketches let it pass.
    """
    members = stars.select(F.col("a").alias("leader"), F.col("b").alias("class")).join(roots, "class", "left")
    members = members.join(classes.select("class", "n"), "class").select("leader", "class", F.coalesce("root", "class").alias("root"), "n")
    members = materialize(members, "members")  # dropped by the caller
    sides = members.groupBy("leader").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("length"), F.sum("n").alias("bytes"))
    sides = sides.filter("least <> most").select(
        "leader", F.ceil(F.greatest(F.col("length") / SIDE, F.col("bytes") / SIDE_BYTES)).cast("int").alias("sides"))
    own = F.pmod(F.xxhash64("class"), F.col("sides")).cast("int")
    placed = members.join(sides, "leader").join(classes.select("class", "sketch"), "class")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, sides - 1)")))
    placed = placed.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "root", "n", "sketch")
    placed = placed.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        i, j, own = (rows.column(k).to_numpy() for k in (1, 2, 3))
        keys, roots, sizes = (rows.column(k).to_numpy() for k in (4, 5, 6))
        bits = rows.column(7).to_pylist()
        sides = [np.flatnonzero(own == which) for which in (i[0], j[0])]
        left, right = ((roots[s], sizes[s], [bits[r] for r in s]) for s in sides)
        found = list(possible_pairs(left, right)) if len(sides[0]) and len(sides[1]) else []
        a, b = (keys[s[np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)])]] for k, s in enumerate(sides))
        ordered = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
        ordered = np.unique(ordered, axis=0) if i[0] == j[0] else ordered
        return pa.RecordBatch.from_arrays([pa.array(ordered[:, 0]), pa.array(ordered[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the piece that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(3)):
                yield pairs(pa.Table.from_batches(held))
                held = []
            for start, end in zip(cuts, cuts[1:]):
                held.append(batch.slice(start, end - start))
                if end < len(place):
                    yield pairs(pa.Table.from_batches(held))
                    held = []
        if held:
            yield pairs(pa.Table.from_batches(held))

    found = placed.mapInArrow(tidy(run), "a long, b long").distinct()
    found.scratch = members.scratch  # for drop_scratch
    return found


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked. A scratch table is behind them.

    A pair is at home with the least class that is next to one of its two, so
    the pairs of like texts have one home, and a set is sent once for each home
    of its pairs, mostly once. Small homes share parts of bounded size; a large
    one is cut into parts on both sides, and the pairs of two parts go to one task.
    """
    sizes = sets.groupBy("class").agg(F.max(F.octet_length("elements")).alias("bytes"))
    size = sets.agg(F.sum(F.octet_length("elements"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    ends = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("class", "other")
    least = ends.groupBy("class").agg(F.least("class", F.min("other")).alias("least"))
    homed = pairs.join(least.toDF("a", "by_a"), "a").join(least.toDF("b", "by_b"), "b").select("a", "b", F.least("by_a", "by_b").alias("home"))
    homed = materialize(homed, "homed")  # dropped by the caller
    held = homed.select("home", F.explode(F.array("a", "b")).alias("class")).distinct().join(sizes, "class")
    large = held.groupBy("home").agg(F.ceil(F.sum("bytes") / PART_BYTES).alias("sides")).filter("sides > 1")
    i, j = (F.coalesce(F.pmod(F.xxhash64(side), F.col("sides")), F.lit(0)).alias(name) for side, name in (("a", "i"), ("b", "j")))
    part = F.when(F.col("sides").isNull(), F.pmod(F.xxhash64("home"), F.lit(parts))).otherwise(F.col("home")).alias("part")
    place = ["cut", "part", "i", "j"]
    placed = homed.join(large, "home", "left").select(F.col("sides").isNotNull().alias("cut"), part, i, j, "a", "b")
    asked = placed.select(*place, F.explode(F.array("a", "b")).alias("class")).distinct()
    if 2 * homed.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)  # else both sides are shuffled by class
    moved = asked.join(sets, "class").select(*[F.col(c).alias(f"to_{c}") for c in place], "class", "elements")

    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        elements = {key: np.frombuffer(own, np.uint64) for key, own in zip(sets["class"], sets["elements"])}
        ok = [a in elements and b in elements and _linked(elements[a], elements[b]) for a, b in zip(pairs["a"], pairs["b"])]
        return pairs.loc[np.array(ok, bool), ["a", "b"]]

    found = placed.groupBy(*place).cogroup(moved.groupBy(*[f"to_{c}" for c in place])).applyInPandas(run, "a long, b long")
    found.scratch = homed.scratch  # for drop_scratch
    return found


def _compared(docs: DataFrame, text: str, doc_id: str, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The linked ones of the pairs, by the whole sets of the classes in them."""
    ids = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = materialize(ids.join(classes, "class").select("class", F.col("row.id").alias("id")), "wanted")
    sets = materialize(_elements(docs, text, doc_id, wanted), "sets")
    verified = _verified(pairs, sets)
    linked = materialize(verified, "linked")
    drop_scratch(wanted, sets, verified)
    return linked


def components(links: DataFrame) -> DataFrame:
    """``class, root`` of every class in ``links`` (a, b): least labels spread over links and jump along themselves."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("class")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["class"]).groupBy("a").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("class").alias("via"), F.col("root").alias("far"))
        after = labels.join(near, labels["class"] == near["a"]).join(jump, labels["root"] == jump["via"]).select(
            labels["class"], F.col("root").alias("was"), F.least("root", "near", "far").alias("root"))
        after = materialize(after, "labels")
        drop_scratch(labels)
        if after.filter("was <> root").isEmpty():
            drop_scratch(edges)
            return after
        labels = after


def _linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def join_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus n_shingles, component_id and stays.

    ``component_id`` is the least id that links reach, ``stays`` marks one row
    of each component. Links are exact: no candidate is capped or skipped.

    Edge cases: a null or empty text, or one of white space, has no shingles
    and is linked with nothing, so it stays under its own id. With fewer words
    than a shingle the whole sequence is one. Repeated rows are one class, of
    which one row stays. A null id counts as larger than all others. New
    columns get a trailing ``_`` where names clash.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    n_name, id_name, stays = fresh(carry, "n_shingles", "component_id", "stays")
    key, id_, at, drawn = fresh([*carry, n_name, id_name, stays], "class", "id", "at", "sketch")
    # The signatures come first, so that their shuffle, the largest, has gone before any table of rows is written.
    size = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    # No more than the cores or the bytes need: each block that a class is in carries its key.
    blocks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), 8, int(size * PER_BYTE * (SIGNATURE + 6) / BLOCK_BYTES))
    shared = _blocks(docs, text, blocks).groupBy("block").applyInPandas(
        tidy_groups(lambda pdf: _shared(pdf)), "leader long, members array<long>")
    shared = materialize(shared, "shared")
    led = shared.select(F.col("leader").alias("a"), F.explode("members").alias("b")).distinct()
    led = materialize(led, "led")
    drop_scratch(shared)

    rows = _with_class(docs.withColumn(id_, quoted(doc_id)), text, [*carry, id_], key, n_name, drawn)
    rows = materialize(rows.withColumn(at, F.monotonically_increasing_id()), "classes")
    row = F.struct(F.col(id_).isNull().alias("unknown"), F.col(id_).alias("id"), F.col(at).alias("at"))
    classes = rows.filter(F.col(n_name) > 0).groupBy(F.col(key).alias("class")).agg(
        F.min(row).alias("row"), F.max(n_name).alias("n"), F.max(drawn).alias("sketch"), F.count("*").alias("copies"))
    classes = materialize(classes, "reps")
    stars = materialize(_possible(led, classes), "stars")
    links = _compared(docs, text, doc_id, stars, classes)
    roots = components(links)

    # Classes under one leader that are not yet of one component are compared with each other.
    under = _possible_under_leaders(led, roots, classes)
    rest = materialize(under.join(stars, ["a", "b"], "left_anti"), "rest")
    drop_scratch(under, led, stars)
    if not rest.isEmpty():
        more = _compared(docs, text, doc_id, rest, classes)
        if not more.isEmpty():
            drop_scratch(roots)
            roots = components(links.unionByName(more))
        drop_scratch(more)
    drop_scratch(rest, links)

    best = classes.join(roots, "class").groupBy("root").agg(F.min("row").alias("best"))
    found = roots.join(best, "root").select("class", "best")
    found = classes.join(found, "class", "left").filter(F.col("best").isNotNull() | (F.col("copies") > 1)).select(
        F.col("class").alias(f"{key}_of"), F.coalesce("best", "row").alias(f"{key}_best"))
    found = materialize(found, "found")
    drop_scratch(classes, roots)
    few = found.count() <= BROADCAST_ROWS  # else the rows are shuffled

    # Rows whose set no other row has and that have no link are not moved.
    sent = spark.sparkContext.broadcast(key_filter(found.select(f"{key}_of")))
    shown = rows.select(*[quoted(c) for c in [*carry, n_name, key, id_, at]])

    def touched(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = may_hold(sent.value, batch.column(batch.num_columns - 3).to_numpy())
                yield batch.filter(pa.array(hit == wanted))

        return shown.mapInArrow(tidy(run), shown.schema)

    kept = [quoted(c) for c in [*carry, n_name]]
    own = F.struct(F.col(id_).isNull().alias("unknown"), F.col(id_).alias("id"), F.col(at).alias("at"))
    first = F.when(F.col(n_name) > 0, F.coalesce(F.col(f"{key}_best"), own)).otherwise(own)
    joined = touched(True).join(F.broadcast(found) if few else found, F.col(key) == F.col(f"{key}_of"), "left")
    joined = joined.select(*kept, first["id"].alias(id_name), (first["at"] == F.col(at)).alias(stays))
    return joined.unionByName(touched(False).select(*kept, F.col(id_).alias(id_name), F.lit(True).alias(stays)))


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    found = join_similar(docs, text, doc_id)
    return found.filter(quoted(found.columns[-1])).select(*[quoted(c) for c in docs.columns])

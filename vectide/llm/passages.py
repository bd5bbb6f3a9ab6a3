"""Remove repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Not every suffix has to be sorted for that: every
such string holds an *anchor*, a place whose gram of ``GRAM`` bytes has the
least hash around it, and equal strings have it at the same place. So

1. of identical texts only the least document takes part; the others go whole;
2. anchors' hashes are exchanged, 4 bytes each, to learn which grams occur in
   two documents or more; the answer is a table of bits, sized from their
   count, in as many rounds as its bound asks for;
3. the suffixes at those anchors are sorted in each task and exchanged as
   front-coded runs, cut at the same splitters everywhere. Where a run has the
   same bytes around an anchor several times, only the least document's is
   sent: for the others the answer is known;
4. the runs of a range are merged by a loser tree. A contender keeps the length
   of the prefix it shares with the last winner; only where these lengths tie
   are bytes read, and only those behind the known prefix;
5. the common prefixes that come out of the merge, with the bytes before each
   anchor, say for every string around an anchor which document has it first;
6. each document's removed places are brought to it; documents without any are
   not moved.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import fresh, key_filter, may_hold, quoted, tidy, tidy_groups, whole_text
from vectide.session import drop_scratch, materialize

LENGTH, GRAM = 50, 25
#: Places from which a string that holds an anchor may start before it.
BEFORE = LENGTH - GRAM
#: Bits of a table of repeated grams that is sent to the tasks: 64 MB. There are eight for each gram, so more grams take more rounds.
FILTER_BITS = 29
#: Rounds that are expected at most; beyond that all anchors are exchanged, which no longer costs more.
ROUNDS = 32
#: Share of the places of a text that are anchors, about; sizes the ranges and blocks, changes no result.
ANCHORS = 0.08
#: Bytes of a block of hashes, and of the suffixes of a range.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: Sampled grams for each range from which the splitters are drawn, and most of them in all.
SAMPLE, MOST_SAMPLED = 64, 1 << 20
#: Anchors that a task sorts at a time.
RUN = 400_000
#: Groups of identical texts that are sent to every task at most; beyond that they are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000
NO_ID = np.iinfo(np.int64).max


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """64-bit hashes of all grams, built by doubling."""
    base = 0x9E3779B97F4A7C15
    powers = {1: body.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= GRAM:
        h = powers[n]
        powers[2 * n] = h[:-n] * np.uint64(pow(base, n, 1 << 64)) + h[n:]
        n *= 2
    made, done = None, 0
    for n in sorted(powers, reverse=True):
        while done + n <= GRAM and (GRAM - done) & n:
            part = powers[n][done:]
            made = part if made is None else made[: len(part)] * np.uint64(pow(base, n, 1 << 64)) + part[: len(made)]
            done += n
    made = made[: len(body) - GRAM + 1]
    made = (made ^ (made >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return made ^ (made >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    n, now = 1, values
    while 2 * n <= width:
        now = pick(now[:-n], now[n:])
        n *= 2
    return pick(now[: len(values) - width + 1], now[width - n:]) if n < width else now


def anchors(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram has the least hash in some string of ``LENGTH`` bytes, and a hash of the gram.

    The least hashes begin with zeros. An odd factor, which keeps different
    ones apart, spreads them over all leading bits, so that blocks are even.
    """
    if len(body) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(body)
    least = _sliding(hashes, BEFORE + 1, np.minimum)
    padded = np.concatenate([np.zeros(BEFORE, np.uint64), least, np.zeros(BEFORE, np.uint64)])
    reach = _sliding(padded, BEFORE + 1, np.maximum)  # the greatest of the least hashes around each place
    at = np.flatnonzero(reach == hashes)
    return at, hashes[at] * np.uint64(0x9E3779B97F4A7C15)


def _power_of_two(least: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, least)))))


def _grams(docs: DataFrame, text: str, blocks: int) -> DataFrame:
    """``block, hashes, several``: hashes of the grams at anchors of each task, in blocks by their leading bits; negative blocks hold sampled grams."""
    top = blocks.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        drawn: dict[int, bytes] = {}

        def packed() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block, short = _place(values, top)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(block))])
            rows = [(int(b), short[cuts[b]:cuts[b + 1]].tobytes(), np.packbits(counts[cuts[b]:cuts[b + 1]] > 1).tobytes())
                    for b in np.flatnonzero(np.diff(cuts))]
            rows += [(-1 - (k & 0x7FFF), k.to_bytes(8, "big"), gram) for k, gram in drawn.items()]
            drawn.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                              names=["block", "hashes", "several"])

        size = 0
        for batch in batches:
            for value in batch.column(0):
                body = np.frombuffer((value.as_py() or "").encode(), np.uint8)
                at, hashes = anchors(body)
                if len(at):
                    held.append(np.unique(hashes))
                    size += len(at)
                    for k in np.flatnonzero(hashes % np.uint64(1021) == 0):
                        drawn[int(hashes[k])] = body[at[k]:at[k] + GRAM].tobytes()
                if size > 20 * RUN:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    return materialize(docs.select(quoted(text)).mapInArrow(tidy(run), "block int, hashes binary, several binary"), "grams")


def _place(hashes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, by its ``top`` leading bits, and the 32 bits behind them."""
    block = (hashes >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(hashes), np.int64)
    return block, ((hashes >> np.uint64(32 - top)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _repeated(packs: DataFrame) -> DataFrame:
    """``block, hashes``: what occurs in two documents or more."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(h, np.uint32) for h in rows["hashes"]])
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8))[: len(h) // 4] for h, s in zip(rows["hashes"], rows["several"])])
        found, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        hit = (counts > 1) | (np.bincount(inverse, several) > 0)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "hashes": [found[hit].tobytes()]})

    return materialize(packs.filter("block >= 0").groupBy("block").applyInPandas(merge, "block int, hashes binary"), "repeated")


def _rounds(repeated: DataFrame, blocks: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first block, one more than the last, bits of a block, table) of each round; eight bits or more for a repeated gram."""
    count = repeated.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    bits = min(32, max(3, _power_of_two(8 * count / 4 / blocks).bit_length() - 1))
    step = max(1, (1 << FILTER_BITS) >> bits)
    for first in range(0, blocks, step):
        last = min(first + step, blocks)
        table = np.zeros((last - first) << (bits - 3), np.uint8)
        for row in repeated.filter((F.col("block") >= first) & (F.col("block") < last)).toLocalIterator():
            cell = np.frombuffer(row["hashes"], np.uint32) >> np.uint32(32 - bits)
            cells = np.zeros(1 << bits, bool)
            cells[cell] = True
            start = (row["block"] - first) << (bits - 3)
            table[start:start + (1 << (bits - 3))] = np.packbits(cells, bitorder="little")
        yield first, last, bits, table


def _splitters(packs: DataFrame, ranges: int) -> list[bytes]:
    """Grams that cut the sampled ones into ranges of equal numbers."""
    most = min(SAMPLE * ranges, MOST_SAMPLED)
    sample = packs.filter("block < 0").orderBy(F.xxhash64("hashes")).limit(most).toPandas()["several"].tolist()
    sample = sorted({bytes(gram) for gram in sample})
    return sample[len(sample) // ranges:: max(1, len(sample) // ranges)]


def front_code(suffixes: np.ndarray) -> tuple[bytes, bytes]:
    """(length of the prefix shared with the one before, the bytes behind it) of sorted rows of bytes."""
    same = np.zeros(suffixes.shape, bool)
    same[1:] = suffixes[1:] == suffixes[:-1]
    shared = np.where(same.all(axis=1), LENGTH, np.argmin(same, axis=1))
    return shared.astype(np.uint8).tobytes(), suffixes[np.arange(LENGTH) >= shared[:, None]].tobytes()


def _bundle(parts: list[bytes]) -> bytes:
    body = b"".join(parts)
    return np.array([len(body), *map(len, parts)], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unbundle(bundle: bytes) -> list[bytes]:
    size, *lengths = np.frombuffer(bundle[:8 * (_FIELDS + 1)], "<i8").tolist()
    body = pa.decompress(bundle[8 * (_FIELDS + 1):], decompressed_size=size, codec="zstd", asbytes=True)
    ends = np.cumsum(lengths).tolist()
    return [body[end - n:end] for end, n in zip(ends, lengths)]


#: Of a run: shared, tails, bytes before, keys and ids of its documents, document, place and room of each anchor, and answers found on the way.
_FIELDS = 9


def _usable(at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bit o tells that the document has the whole string from ``at - o``."""
    o = np.arange(BEFORE + 1)
    return (((at[:, None] >= o) & (room[:, None] >= LENGTH - o)) << o).sum(axis=1)


def _runs(docs: DataFrame, text: str, key: str, order: str, splitters: list[bytes], top: int, round_: tuple[int, int, int, np.ndarray] | None) -> DataFrame:
    """``part, run``: sorted front-coded runs of the suffixes at repeated anchors, by range; at all anchors without a table."""
    sent = docs.sparkSession.sparkContext.broadcast((round_, splitters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cuts = sent.value
        edges = np.array(cuts, f"S{GRAM}") if cuts else np.zeros(0, f"S{GRAM}")
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[int] = []
        ids: list[int] = []

        def packed() -> pa.RecordBatch:
            around, owner, at, room = (np.concatenate(c) for c in zip(*held))
            key_, doc_ = np.array(keys, np.int64), np.array(ids, np.int64)
            held.clear(), keys.clear(), ids.clear()
            order_ = np.argsort(around.view(f"S{LENGTH + BEFORE}").ravel(), kind="stable")
            around, owner, at, room = (c[order_] for c in (around, owner, at, room))
            part = np.searchsorted(edges, np.ascontiguousarray(around[:, :GRAM]).view(f"S{GRAM}").ravel(), side="right")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(edges) + 1))])
            # Of equal bytes around an anchor the least document's is sent.
            before, doc = np.minimum(at, BEFORE), doc_[owner]
            new = np.append(True, (around[1:] != around[:-1]).any(axis=1) | (room[1:] != room[:-1]) | (before[1:] != before[:-1]))
            later = doc > np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
            rows = []
            for p in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[p], bounds[p + 1])
                used, place = np.unique(owner[own], return_inverse=True)
                place, gone = place.astype("<u4"), later[own]
                left = ~gone
                answers = np.stack([place[gone], at[own][gone], _usable(at[own][gone], room[own][gone])]).astype("<u4")
                rows.append((int(p), _bundle([
                    *front_code(around[own][left][:, :LENGTH]), around[own][left][:, LENGTH:].tobytes(), key_[used].tobytes(), doc_[used].tobytes(),
                    place[left].tobytes(), at[own][left].astype("<u4").tobytes(), room[own][left].tobytes(), answers.tobytes()])))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["part", "run"])

        size = 0
        for batch in batches:
            for k, o, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = np.frombuffer((value.as_py() or "").encode(), np.uint8)
                at, hashes = anchors(body)
                if known is not None:
                    first, last, bits, table = known
                    block, short = _place(hashes, top)
                    inside = (block >= first) & (block < last)
                    cell = np.where(inside, (block - first) << bits, 0) | (short >> np.uint32(32 - bits)).astype(np.int64)
                    at = at[inside & ((table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0)]
                if not len(at):
                    continue
                padded = np.concatenate([np.zeros(BEFORE, np.uint8), body, np.zeros(LENGTH, np.uint8)])
                reach = np.concatenate([np.arange(LENGTH), -1 - np.arange(BEFORE)])
                room = np.minimum(len(body) - at, LENGTH).astype(np.uint8)
                held.append((padded[(at + BEFORE)[:, None] + reach], np.full(len(at), len(keys), np.int64), at, room))
                keys.append(k)
                ids.append(NO_ID if o is None else o)
                size += len(at)
                if size > RUN:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    return docs.select(key, order, quoted(text)).mapInArrow(tidy(run), "part int, run binary")


def unfold(shared: np.ndarray, tails: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    made, last, at = [], b"", 0
    for n in shared.tolist():
        last = last[:n] + tails[at:at + LENGTH - n]
        at += LENGTH - n
        made.append(last)
    return made


def merge_runs(runs: list[tuple[list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs with a loser tree: (places in the runs put one behind the other, prefix shared with the one before).

    ``know[r]`` is what the contender of run r shares with the last winner. Of
    two contenders the one that shares more is the lesser, and no byte is read.
    """
    offsets = np.concatenate([[0], np.cumsum([len(run) for run, _ in runs])]).tolist()
    words = [run for run, _ in runs]
    # A byte for each length: as lists they would take eight times that, and many more for the places.
    within = [shared.astype(np.uint8).tobytes() for _, shared in runs]
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    know = [0 if r < len(runs) and words[r] else -1 for r in range(k)]
    lost = [0] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        p, q = know[a], know[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p < 0:
            return a, b
        x, y = words[a][at[a]][p:], words[b][at[b]][p:]
        if x == y:
            know[b] = LENGTH
            return a, b
        bits = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()
        here = p + len(x) - (bits + 7) // 8
        if x < y:
            know[b] = here
            return a, b
        know[a] = here
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, lost[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    order, prefix = array("q"), array("B")
    for _ in range(offsets[len(runs)]):
        order.append(offsets[winner] + at[winner])
        prefix.append(know[winner])
        at[winner] += 1
        know[winner] = within[winner][at[winner]] if at[winner] < len(words[winner]) else -1
        node = (winner + k) // 2
        while node:
            other = lost[node]
            if know[winner] < know[other]:
                lost[node], winner = winner, other
            elif know[winner] == know[other]:
                winner, lost[node] = play(winner, other)
            node >>= 1
    return np.array(order, np.int64), np.array(prefix, np.int64)


def _masks(rows: pd.DataFrame) -> pd.DataFrame:
    """``key, doc, at, starts`` of one range, a row for each document: bit o of ``starts`` tells that the string from ``at - o`` is in an earlier one."""
    parts = [_unbundle(bundle) for bundle in rows["run"]]
    runs = []
    for part in parts:
        shared = np.frombuffer(part[0], np.uint8)
        runs.append((unfold(shared, part[1]), shared))
        part[1] = b""  # the suffixes are unfolded, one run at a time
    order, prefix = merge_runs(runs)
    del runs  # nor are they needed behind the merge
    own = [[np.frombuffer(part[k], np.int64)[np.frombuffer(part[5], "<u4")] for part in parts] for k in (3, 4)]
    key, doc = (np.concatenate(c)[order] for c in own)
    at = np.concatenate([np.frombuffer(part[6], "<u4") for part in parts])[order].astype(np.int64)
    left = np.concatenate([np.frombuffer(part[2], np.uint8).reshape(-1, BEFORE) for part in parts])[order]
    room = np.concatenate([np.frombuffer(part[7], np.uint8) for part in parts])[order]
    room = np.stack([np.minimum(at, BEFORE), room], 1)
    starts, before = np.zeros(len(order), np.int64), np.zeros(len(order), np.uint64)
    for o in range(BEFORE + 1):
        if o:
            before = before * np.uint64(0x9E3779B97F4A7C15) + left[:, o - 1].astype(np.uint64) + np.uint64(1)
        usable = np.flatnonzero((room[:, 0] >= o) & (room[:, 1] >= LENGTH - o))
        if not len(usable):
            continue
        group = np.cumsum(prefix < LENGTH - o)[usable].astype(np.uint64)
        # One number for what stands behind and before the anchor; of equal ones the least document is the first.
        both = (group + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ before[usable]
        both = (both ^ (both >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        ranked = np.argsort(both)
        both, docs = both[ranked], doc[usable][ranked]
        first = np.append(True, both[1:] != both[:-1])
        least = np.minimum.reduceat(docs, np.flatnonzero(first))[np.cumsum(first) - 1]
        later = ranked[docs > least]
        starts[usable[later]] |= 1 << o
    hit = starts > 0
    found = [(key[hit], doc[hit], at[hit], starts[hit])]
    for part in parts:
        place, at_, mask = np.frombuffer(part[8], "<u4").reshape(3, -1).astype(np.int64)
        found.append((np.frombuffer(part[3], np.int64)[place], np.frombuffer(part[4], np.int64)[place], at_, mask))
    key, doc, at, starts = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((doc, key))
    key, doc, at, starts = (c[order] for c in (key, doc, at, starts))
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[:len(key)])
    return pd.DataFrame({"key": key[first], "doc": doc[first], "at": _cut(at, first), "starts": _cut(starts, first)})


def _cut(values: np.ndarray, first: np.ndarray) -> pd.Series:
    return pd.Series(np.split(values, first[1:]) if len(first) else [], dtype=object)


def removed_bytes(size: int, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes of a document go."""
    edge = np.zeros(size + 1, np.int64)
    for o in range(BEFORE + 1):
        begin = np.unique(at[(starts >> o) & 1 > 0] - o)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + LENGTH, -1)
    return np.cumsum(edge[:size]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus n_bytes, n_removed, n_spans and kept_bytes (what remains).

    Strings are judged on the input, overlaps count, and matches never cross
    documents. Edge cases: a null text is empty; texts below ``LENGTH`` bytes
    stay. A null id is greater than all others. Rows of one id remove nothing
    from each other; repeated rows fare alike. Ids must be whole numbers, or
    texts that spell them. An empty table gives an empty one. New columns get a
    trailing ``_`` where names clash.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    names = fresh(carry, "n_bytes", "n_removed", "n_spans", "kept_bytes")
    key, order, body, copy, digest, least = fresh([*docs.columns, *names], "key", "order", "body", "copy", "digest", "least")
    given = docs.withColumns({key: F.xxhash64(whole_text(text)), order: F.coalesce(quoted(doc_id).cast("long"), F.lit(NO_ID)), body: quoted(text),
                              digest: F.unhex(F.md5(whole_text(text)))})
    # Of identical texts only the least document takes part.
    least_of = given.groupBy(digest).agg(F.min(order).alias(least), F.count(F.lit(1)).alias("n")).filter("n > 1")
    least_of = materialize(least_of.select(F.col(digest).alias(f"{digest}_of"), least), "least")
    few = least_of.count() <= BROADCAST_TEXTS
    keyed = given.join(F.broadcast(least_of) if few else least_of, F.col(digest) == F.col(f"{digest}_of"), "left")
    keyed = keyed.withColumn(copy, F.coalesce(F.col(order) > F.col(least), F.lit(False)))
    first = keyed.filter(~F.col(copy))

    size = docs.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(partitions, int(size * ANCHORS * (LENGTH + BEFORE) / RANGE_BYTES))
    blocks = _power_of_two(max(8, partitions / 2, size * ANCHORS * 4 / BLOCK_BYTES))
    top = blocks.bit_length() - 1
    packs = _grams(first, body, blocks)
    splitters = _splitters(packs, ranges)
    if 8 * ANCHORS * size / 2 > ROUNDS << FILTER_BITS:
        runs = _runs(first, body, key, order, splitters, top, None)
    else:
        repeated = _repeated(packs)
        rounds = _rounds(repeated, blocks)
        runs = reduce(DataFrame.unionByName, [_runs(first, body, key, order, splitters, top, r) for r in rounds])
        drop_scratch(repeated)
    drop_scratch(packs)  # the runs know of them by the table and the splitters alone
    masks = materialize(runs.groupBy("part").applyInPandas(tidy_groups(_masks), "key long, doc long, at array<long>, starts array<long>"), "masks")
    found = masks.groupBy(F.col("key").alias(f"{key}_of"), F.col("doc").alias(f"{order}_of")).agg(
        F.collect_list(F.struct("at", "starts")).alias(f"{key}_cut"))

    # Only documents that may lose something are moved to what they lose.
    sent = spark.sparkContext.broadcast(key_filter(masks.select("key").distinct()))
    shown = keyed.select(*[quoted(c) for c in carry], key, order, copy, body)

    def touched(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = may_hold(sent.value, batch.column(batch.num_columns - 4).to_numpy())
                yield batch.filter(pa.array(hit == wanted))

        return shown.mapInArrow(tidy(run), shown.schema)

    joined = touched(True).join(found, (F.col(key) == F.col(f"{key}_of")) & (F.col(order) == F.col(f"{order}_of")), "left").select(
        *[quoted(c) for c in carry], F.flatten(F.col(f"{key}_cut")["at"]).alias(f"{key}_at"), F.flatten(F.col(f"{key}_cut")["starts"]).alias(f"{key}_starts"), copy, body)
    rest = touched(False).select(*[quoted(c) for c in carry], *[F.lit(None).cast("array<bigint>").alias(f"{key}_{c}") for c in ("at", "starts")], copy, body)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            at, starts, copies, texts = batch.columns[-4:]
            for i in range(batch.num_rows):
                data = np.frombuffer((texts[i].as_py() or "").encode(), np.uint8)
                gone = np.zeros(len(data), bool)
                if copies[i].as_py():
                    gone[:] = len(data) >= LENGTH
                elif at[i].is_valid:
                    gone = removed_bytes(len(data), at[i].values.to_numpy(), starts[i].values.to_numpy())
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), spans, data[~gone].tobytes()))
            made = [pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *made], names=[*carry, *names])

    kinds = {field.name: field.dataType.simpleString() for field in joined.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"`{c}` long" for c in names[:3]), f"`{names[3]}` binary"])
    return joined.unionByName(rest).mapInArrow(tidy(cut), schema)

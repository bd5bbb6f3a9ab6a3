"""Repair the structure of conversations: the cheapest edits by dynamic programming over a persistent audit.

Rows of a conversation come in order of their turns. For each row and each
state of the grammar ``(s?(ua)+)?`` over role initials the cheapest edits so
far are kept, as one letter each: K(eep), R(erole), D(elete), I(nsert). Of
equally cheap ones the string that sorts first counts.

The strings are never copied. An edit is a node that points to the node before
it, so that all states share what they have in common. A node also knows its
ancestors at distances of powers of two and a rolling hash of its whole
string. Two strings are compared by searching the longest common prefix: both
jump back as long as the hashes there differ. Equal hashes are not believed;
the prefixes are then followed back until they are the same nodes, and if that
shows a collision, the strings themselves are compared.

Once all states share an edit, it and everything before it is final: its rows
are sent on and its nodes are let go. States that can't be part of a cheapest
result are given up at once, so that this happens every few rows, and a
conversation of any length passes through a task in bounded memory. One digest
over a conversation's repaired text has to read it in order, so that a single
conversation is not spread over tasks; its repeated rows are found before, by
grouping on the digests of single rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import SPACES, WORD, fresh, quoted

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of edits; a truncated row that stays costs one more.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an initial leads from each state.
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an inserted or changed row gets in each state.
NEXT_ROLE = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}
#: Rows that wait before it is looked whether their edits are final.
WAITING = 256
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Edit:
    """The last edit of a string of edits."""

    __slots__ = ("letter", "depth", "hash", "ups")

    def __init__(self, before: "Edit | None", letter: str):
        self.letter = letter
        self.depth = before.depth + 1 if before else 0
        self.hash = (before.hash * _BASE + ord(letter)) % _PRIME if before else 0
        #: ancestors at distance 1, 2, 4, ... as far as they are kept
        self.ups: list[Edit] = []
        k = 0
        while before is not None:
            self.ups.append(before)
            before = before.ups[k] if k < len(before.ups) else None
            k += 1

    def at(self, depth: int) -> "Edit":
        """The ancestor of a depth."""
        node = self
        while (far := node.depth - depth) > 0:
            node = node.ups[min(far.bit_length(), len(node.ups)) - 1]
        return node

    def letters(self) -> str:
        """The edits back to the oldest that is kept, which itself is left out."""
        made, node = [], self
        while node.ups:
            made.append(node.letter)
            node = node.ups[0]
        return "".join(reversed(made))


def _same(x: Edit, y: Edit) -> bool:
    """Whether two strings of one length and one hash are equal, letter by letter until they share their nodes."""
    while x is not y:
        if x.letter != y.letter or not (x.ups and y.ups):
            return False
        x, y = x.ups[0], y.ups[0]
    return True


def before(a: Edit, b: Edit) -> bool:
    """Whether the string of ``a`` sorts before that of ``b``. Both go back to the same oldest edit."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x.hash == y.hash:
        if _same(x, y):
            return a.depth < b.depth
        return a.letters() < b.letters()
    for k in reversed(range(max(len(x.ups), len(y.ups)))):
        if k < len(x.ups) and k < len(y.ups) and x.ups[k].hash != y.ups[k].hash:
            x, y = x.ups[k], y.ups[k]
    if not _same(x.ups[0], y.ups[0]):
        return a.letters() < b.letters()
    return x.letter < y.letter


def common(a: Edit, b: Edit) -> Edit:
    """The last node that both share."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x is y:
        return x
    for k in reversed(range(max(len(x.ups), len(y.ups)))):
        if k < len(x.ups) and k < len(y.ups) and x.ups[k] is not y.ups[k]:
            x, y = x.ups[k], y.ups[k]
    return x.ups[0]


class Conversation:
    """Rows of one conversation in order, repaired as they come."""

    def __init__(self):
        self.oldest = Edit(None, "")
        #: state -> (cost, last edit)
        self.best: dict[int, tuple[int, Edit]] = {}
        self._offer(self.best, START, 0, self.oldest)
        self._insert(self.best)
        self.rows: list[tuple[str, str]] = []
        self.state = START
        self.audit: list[str] = []
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self._turns: list[int] = []  # least, greatest, number of different ones
        self._last: tuple | None = None

    @staticmethod
    def _offer(best: dict[int, tuple[int, Edit]], state: int, cost: int, last: Edit) -> None:
        known = best.get(state)
        if known is None or cost < known[0] or (cost == known[0] and before(last, known[1])):
            best[state] = cost, last

    def _insert(self, best: dict[int, tuple[int, Edit]]) -> None:
        """Insertions behind a row, and states given up that a cheaper one can stand in for."""
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for state in sources:
                if state in best and (to not in best or best[state][0] + INSERT_COST <= best[to][0]):
                    self._offer(best, to, best[state][0] + INSERT_COST, Edit(best[state][1], INSERT))
        done = best[ASSISTANT][0]
        # Whatever follows a system row can follow an assistant's; whatever follows nothing can at the cost of deleting a system row.
        for state, least in ((SYSTEM, done), (START, done + DELETE_COST)):
            if state in best and best[state][0] > least:
                del best[state]

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, repeated: bool) -> Iterator[tuple[str, str, str]]:
        """Take the next row; yields what is final so far, as (edit, role, text). ``repeated``: an earlier turn has this row."""
        last = self._last
        repeated = repeated or (last is not None and last == (turn, role, text))
        if last is not None and last[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and (not self._turns or turn != self._turns[1]):
            self._turns = [self._turns[0] if self._turns else turn, turn, (self._turns[2] if self._turns else 0) + 1]
        self._last = turn, role, text
        gone = blank or repeated
        truncated = truncated and not gone
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += truncated
        after: dict[int, tuple[int, Edit]] = {}
        for state, (cost, edit) in self.best.items():
            self._offer(after, state, cost + DELETE_COST, Edit(edit, DELETE))
            if not gone:
                stays = cost + truncated * TRUNCATED_COST
                if (to := STEP[state].get(role[:1])) is not None:
                    self._offer(after, to, stays, Edit(edit, KEEP))
                self._offer(after, STEP[state][NEXT_ROLE[state][0]], stays + REROLE_COST, Edit(edit, REROLE))
        self._insert(after)
        self.best = after
        self.rows.append((role, text))
        if len(self.rows) >= WAITING:
            yield from self._settle()

    def _settle(self) -> Iterator[tuple[str, str, str]]:
        """Send on what all states share and let go of its nodes."""
        edits = [edit for _, edit in self.best.values()]
        shared = edits[0]
        for edit in edits[1:]:
            shared = common(shared, edit)
        if shared is self.oldest:
            return
        yield from self._final(shared.letters())
        for edit in edits:
            while edit is not shared and len(edit.ups) and edit.ups[-1].depth < shared.depth:
                edit.ups = [up for up in edit.ups if up.depth >= shared.depth]
                edit = edit.ups[0]
        shared.ups = []
        self.oldest = shared

    def _final(self, letters: str) -> Iterator[tuple[str, str, str]]:
        self.audit.append(letters)
        used = 0
        for letter in letters:
            role, text = NEXT_ROLE[self.state], ""
            if letter != INSERT:
                own, text = self.rows[used]
                used += 1
                role = role if letter == REROLE else own
            if letter != DELETE:
                self.state = STEP[self.state][role[0]]
            yield letter, role, text
        del self.rows[:used]

    def finish(self) -> Iterator[tuple[str, str, str]]:
        """The rest of the edits; ``cost``, ``audit`` and the counts are then whole."""
        ends = [self.best[state] for state in (START, ASSISTANT) if state in self.best]
        self.cost, last = ends[0]
        if len(ends) > 1 and (ends[1][0] < self.cost or (ends[1][0] == self.cost and before(ends[1][1], last))):
            self.cost, last = ends[1]
        yield from self._final(last.letters())
        if self._turns:
            self.gaps = self._turns[1] - self._turns[0] + 1 - self._turns[2]


def _null_as_space(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns with faults drawn from conversation and turn, and ``lost``: rows that are only left to name their conversation.

    Of 20 draws 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it,
    3 repeats it, 4 makes it a user's; the others leave it. Null roles and
    texts, and null conversations and turns in the draw, read as one space.
    """
    [drawn, lost] = fresh([conv, turn, role, text], "drawn", "lost")
    given = rows.select(quoted(conv), quoted(turn).cast("long").alias(turn), _null_as_space(role).alias(role), _null_as_space(text).alias(text),
                        (F.crc32(F.concat_ws(":", _null_as_space(conv), _null_as_space(turn)).cast("binary")) % 20).alias(drawn))
    hit = quoted(drawn)
    body = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(quoted(text), "[.!?]", "")).otherwise(quoted(text))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    made = given.select(quoted(conv), quoted(turn), F.when(hit == 4, "user").otherwise(quoted(role)).alias(role), body.alias(text), (hit == 0).alias(lost), copies)
    return made.drop("col")


def _judged(rows: DataFrame, conv: str, turn: str, role: str, text: str, lost: str | None) -> DataFrame:
    """conv, turn, role, text, lost, blank, truncated and repeated, each conversation in order within one partition."""
    gone = F.coalesce(quoted(lost), F.lit(False)) if lost else F.lit(False)
    given = rows.select(quoted(conv).alias("conv"), quoted(turn).cast("long").alias("turn"), _null_as_space(role).alias("role"),
                        _null_as_space(text).alias("text"), gone.alias("lost"))
    ended = F.rtrim("text", F.lit(SPACES))
    given = given.withColumns({
        "blank": ~F.col("text").rlike(WORD), "truncated": ~F.substring(ended, -1, 1).isin(".", "!", "?"),
        "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)})
    # Only rows that are there more than once go into the join. Turns are ordered with null first.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = given.filter("not lost and not blank").groupBy(F.col("conv").alias("of"), F.col("digest").alias("same")).agg(
        F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    found = given.join(firsts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    repeated = F.coalesce((place > F.col("first")) & ~F.col("lost"), F.lit(False)).alias("repeated")
    found = found.select("conv", "turn", "role", "text", "lost", "blank", "truncated", repeated)
    return found.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, None or an edit): each edit as it is final, then the whole."""
    now, key = None, None
    for batch in batches:
        for conv, turn, role, text, lost, blank, truncated, repeated in zip(*(column.to_pylist() for column in batch.columns)):
            if now is None or conv != key:
                if now is not None:
                    yield from (((key, now, edit)) for edit in now.finish())
                    yield key, now, None
                now, key = Conversation(), conv
            if not lost:
                yield from ((key, now, edit) for edit in now.add(turn, role, text, blank, truncated, repeated))
    if now is not None:
        yield from ((key, now, edit) for edit in now.finish())
        yield key, now, None


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: str | None = None) -> DataFrame:
    """One row of each conversation: ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, null first, then by role and text. A row's first fault
    counts: blank, duplicate (an earlier one has its role and text), truncated.
    ``cost`` and ``audit`` are of the cheapest edits, ``repaired_sha256`` of
    ``role:text`` of the repaired rows, joined by newlines. Rows marked in
    ``lost`` only name their conversation.

    Edge cases: null roles and texts read as one space; a null conversation is
    one of its own. A role whose initial is none of s, u and a can't be kept.
    Without rows all numbers are 0, the audit is empty and the digest that of
    the empty string. Texts of any length, repeated rows and ties are no
    special case; an empty table gives an empty one. Other columns are left away.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, digest, any_row = [], hashlib.sha256(), False

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
            made.clear()
            return out

        for key, now, edit in _conversations(batches):
            if edit is None:
                made.append((key, now.gaps, now.blank, now.duplicate, now.truncated, now.illegal, now.cost, "".join(now.audit), digest.hexdigest()))
                digest, any_row = hashlib.sha256(), False
                if len(made) >= 1_000:
                    yield sent()
            elif edit[0] != DELETE:
                digest.update(f"{chr(10) if any_row else ''}{edit[1]}:{edit[2]}".encode())
                any_row = True
        if made:
            yield sent()

    judged = _judged(rows, conv, turn, role, text, lost)
    kind = judged.schema["conv"].dataType
    names = [conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
    counts = ", ".join(f"{c} long" for c in names[1:7])
    return judged.mapInArrow(run, f"`{conv}` {kind.simpleString()}, {counts}, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: str | None = None) -> DataFrame:
    """The repaired conversations as ``conv, place, role, text, edit``; see :func:`repair` for the order and odd rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, place = [], 0
        for key, _, edit in _conversations(batches):
            if edit is None:
                place = 0
            elif edit[0] != DELETE:
                made.append((key, place, edit[1], edit[2], edit[0]))
                place += 1
            if len(made) >= 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
                made.clear()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    judged = _judged(rows, conv, turn, role, text, lost)
    kind = judged.schema["conv"].dataType
    names = [conv, "place", "role", "text", "edit"]
    kinds = [_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]
    return judged.mapInArrow(run, f"`{conv}` {kind.simpleString()}, place long, role string, text string, edit string")


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

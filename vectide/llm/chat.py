"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The machine walks through the turns of a conversation in order, checks that
each role may follow the one before, and emits text segments with a loss flag
each. Control strings of the template can't occur in what texts are turned
into, so the turns can be read back from the output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import quoted

SEGMENT = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Turn:
    """How a role's turns are marked, and whether their texts count for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role and the transitions of the machine.

    Every mark in ``control`` starts with one of the characters that
    :func:`escape` treats, and no mark has the escape sign behind it.
    ``follows`` gives the roles that may come after a state; the first state is
    ``start``. A conversation may end in any state of ``ends``. Roles without
    marks of their own are written with ``other``, which spells the role out.
    """

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", "</s>", loss=True),
    })
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("assistant",)
    begin: str = "<s>"
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    control: str = "[<"
    sign: str = "\\"


LLAMA = Template()


def escape(text: Column, template: Template = LLAMA) -> Column:
    """Put the escape sign behind every character that can begin a control string, and behind itself."""
    first = "".join(re.escape(c) for c in template.control + template.sign)
    return F.regexp_replace(text, f"([{first}])", "$1" + re.escape(template.sign))


def unescape(text: Column, template: Template = LLAMA) -> Column:
    first = "".join(re.escape(c) for c in template.control + template.sign)
    return F.regexp_replace(text, f"([{first}]){re.escape(template.sign)}", "$1")


def _segments(role: Column, text: Column, template: Template) -> Column:
    """The segments of one turn."""
    def array(*parts: tuple[Column, bool]) -> Column:
        return F.array(*[F.struct(part.alias("text"), F.lit(loss).alias("loss")) for part, loss in parts])

    body = escape(text, template)
    head, middle, tail = (F.lit(part) for part in template.other)
    made = array((F.concat(head, escape(role, template), middle), False), (body, False), (tail, False))
    for name, turn in template.turns.items():
        marked = array((F.lit(turn.before), False), (body, turn.loss), (F.lit(turn.after), False))
        made = F.when(role == name, marked).otherwise(made)
    return made


def _next_state(state: Column, role: Column, template: Template) -> Column:
    """The role if it may follow the state, else ``error``, which is never left."""
    allowed = F.lit(False)
    for before, after in template.follows.items():
        allowed = F.when(state == before, role.isin(*after)).otherwise(allowed)
    return F.when(allowed, role).otherwise(F.lit("error"))


def format_chats(turns: DataFrame, template: Template = LLAMA, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted, n_turns, valid, first_bad_turn.

    Rows are ordered by turn; ``first_bad_turn`` is the position, from 0, of
    the first turn that may not stand where it does (null if none). A
    conversation that breaks the order, or ends where it may not, is formatted
    all the same and has ``valid`` false.

    A conversation is one sample and one row of the output, so its rows meet;
    nothing else is gathered. Edge cases: a null text is empty, a null role is
    the role of no name, null turns come first, rows of one turn are ordered by
    role and text, and rows without ``conv_id`` form one conversation. Other
    columns are ignored. No rows give no conversations.
    """
    ordered = F.array_sort(F.collect_list(F.struct(
        quoted(turn).isNotNull().alias("numbered"), F.coalesce(quoted(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"))))
    chats = turns.groupBy(quoted(conv_id).alias("conv_id")).agg(ordered.alias("turns"))
    states = F.aggregate("turns", F.array(F.lit("start")), lambda seen, t: F.concat(
        seen, F.array(_next_state(F.element_at(seen, -1), t["role"], template))))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(begin, F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template))))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.cast(SEGMENT).alias("segments"),
                         states.alias("states"))
    bad = F.array_position("states", "error")
    return chats.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "n_turns",
        F.element_at("states", -1).isin(*template.ends).alias("valid"),
        F.when(bad > 0, bad - 2).alias("first_bad_turn"))


def read_turns(formatted: Column, template: Template = LLAMA) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    marks = [(turn.before, turn.after) for turn in template.turns.values()]
    head, middle, tail = template.other
    pattern = "|".join(rf"\Q{before}\E.*?\Q{after}\E" for before, after in [*marks, (head, tail)])
    whole = F.regexp_extract_all(F.substr(formatted, F.lit(len(template.begin) + 1)), F.lit(f"(?s){pattern}"), F.lit(0))

    def inside(written: Column, before: str, after: str) -> Column:
        return F.substr(written, F.lit(len(before) + 1), F.char_length(written) - (len(before) + len(after)))

    def read(written: Column) -> Column:
        spelled = inside(written, head, tail)
        cut = F.locate(middle, spelled)
        found = F.struct(unescape(F.substr(spelled, F.lit(1), cut - 1), template).alias("role"),
                         unescape(F.substr(spelled, cut + len(middle)), template).alias("text"))
        for name, turn in template.turns.items():
            own = F.struct(F.lit(name).alias("role"), unescape(inside(written, turn.before, turn.after), template).alias("text"))
            found = F.when(F.startswith(written, F.lit(turn.before)), own).otherwise(found)
        return found

    return F.transform(whole, read)


def loss_text(segments: Column, template: Template = LLAMA) -> Column:
    """All text under the loss mask, in order, unescaped."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"], template)), "")

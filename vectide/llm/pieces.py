"""SentencePiece BPE by a table of prefixes: the last token of each prefix, then the ids backwards.

Merging by score gives every prefix of a text exactly one encoding, so exactly
one *last token*. Of the pieces that an automaton finds to end at a place, it
is the one that is compatible with the last token of the prefix before it:
the two strings together encode to just these two tokens. Any chain of
compatible pairs is the encoding of its text, because a merge across a border
of the chain would have happened between its two neighbours alone as well. So
one pass fills the table, and following it from the end gives the ids.

A pair is tested by taking its merges back. What stood at the border at any
time must not have been merged; the token made later is taken apart first.
That needs tokens whose own merges come in the order of their ranks. The few
others (runs of spaces, which share one score) are merged again from their
characters.

A text is cut where no piece of the vocabulary holds the two neighbouring
characters: no merge crosses such a place. That follows from the vocabulary
and changes no result. Characters of no piece become byte tokens.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectide.llm.bpe import joined
from vectide.llm.common import fresh, quoted

#: The character that stands for a space in pieces.
MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """A model's pieces and the tables for encoding and decoding."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self._refuse_others(path, model)
        self.prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        self.unknown_text = model.trainer_spec.unk_surface
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces], np.int8)
        self.token_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = sorted({model.pieces[i].score for i in self.token_of.values()}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        #: rank of what a merge makes: the least goes first, the leftmost of equal ones
        self.rank = {piece: place[model.pieces[i].score] for piece, i in self.token_of.items()}
        self.byte_token = {int(self.pieces[i][1:-1], 16): int(i) for i in np.flatnonzero(self.kinds == BYTE)}
        self._learn_merges()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.token_of.items():
            if self.made_of[i] is not None or len(piece) == 1:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._learn_neighbours()
        #: by ``left * number of pieces + right``; numbers take less than pairs
        self._fits: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._prepare_decoding()

    @staticmethod
    def _refuse_others(path: str, model) -> None:
        """Settings that this encoder does not follow are refused, not passed over."""
        trainer, normalizer = model.trainer_spec, model.normalizer_spec
        wrong = [
            text for text, bad in (
                ("no BPE model", trainer.model_type != trainer.ModelType.Value("BPE")),
                ("no byte fallback", not trainer.byte_fallback),
                ("white space as suffix", trainer.treat_whitespace_as_suffix),
                ("a normalizer of its own", bool(normalizer.precompiled_charsmap) or normalizer.remove_extra_whitespaces
                 or not normalizer.escape_whitespaces),
                ("pieces of other kinds", any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces)),
            ) if bad]
        chars = {p.piece for p in model.pieces if p.type == NORMAL and len(p.piece) == 1}
        if any(not chars.issuperset(p.piece) for p in model.pieces if p.type == NORMAL):
            wrong.append("pieces of characters that are no pieces")
        if wrong:
            raise ValueError(f"{path}: {', '.join(wrong)}")

    def merged(self, text: str) -> tuple[list[str], list[int], tuple[str, str] | None]:
        """(tokens, ranks of the merges in the order they happen, what the last merge joined) by merging, step by step."""
        symbols, ranks, joined, rank = list(text), [], None, self.rank
        while True:
            best, at = None, 0
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return symbols, ranks, joined
            joined = symbols[at], symbols[at + 1]
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            ranks.append(best)

    def _learn_merges(self) -> None:
        """Parts of each token, when it is made, and whether its merges come in the order of their ranks."""
        size = len(self.pieces)
        self.made_of: list[tuple[int, int] | None] = [None] * size
        self.made_at = [-1] * size
        self.ordered = [True] * size
        for piece, i in self.token_of.items():
            if len(piece) > 1:
                symbols, ranks, joined = self.merged(piece)
                if symbols == [piece]:  # a piece that merging never gives is never a token
                    self.made_of[i] = self.token_of[joined[0]], self.token_of[joined[1]]
                    self.made_at[i] = ranks[-1]
                    self.ordered[i] = all(a < b for a, b in zip(ranks, ranks[1:]))

    def _learn_neighbours(self) -> None:
        """Which characters stand side by side in some piece; by class, and class 0 is in no piece."""
        chars = sorted({c for piece in self.token_of for c in piece})
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for piece in self.token_of:
            classes = self.class_of[[ord(c) for c in piece]]
            self.beside[classes[:-1], classes[1:]] = True

    def _prepare_decoding(self) -> None:
        shown = []
        for piece, kind in zip(self.pieces, self.kinds):
            if kind == BYTE:
                shown.append(bytes([int(piece[1:-1], 16)]))
            elif kind == CONTROL:
                shown.append(b"")
            else:
                shown.append((self.unknown_text if kind == UNKNOWN else piece.replace(MARK, " ")).encode())
        #: what each id stands for: all of them one behind the other, and where each begins
        self.shown = shown
        self.lengths = np.array([len(s) for s in shown], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(shown), np.uint8)

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives just these two."""
        key = left * len(self.pieces) + right
        known = self._fits.get(key)
        if known is None:
            if self.ordered[left] and self.ordered[right]:
                known = self._stays_apart(left, right)
            else:
                a, b = self.pieces[left], self.pieces[right]
                known = self.merged(a + b)[0] == [a, b]
            self._fits[key] = known
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        pieces, rank, made_at, made_of = self.pieces, self.rank, self.made_at, self.made_of
        until = len(pieces)
        while True:
            joined = rank.get(pieces[a] + pieces[b])
            if joined is not None and joined < until:
                return False
            made_a, made_b = made_at[a], made_at[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # at equal rank the merge further left comes first
                until, a = made_a, made_of[a][1]
            else:
                until, b = made_b + 1, made_of[b][0]

    def encode_run(self, run: str) -> list[int]:
        """Token ids of a string whose characters are all in pieces."""
        last = [-1] * (len(run) + 1)
        width = [0] * (len(run) + 1)
        known, fits, ids = self._fits, self.pair_fits, len(self.pieces)
        for end, (length, token) in self.automaton.iter(run):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if end == length:
                ok = True
            else:
                ok = known.get(before * ids + token)
                if ok is None:
                    ok = fits(before, token)
            if ok:
                last[end], width[end] = token, length
        ids, at = [], len(run)
        while at:
            ids.append(last[at])
            at -= width[at]
        ids.reverse()
        return ids

    def _packed(self, run: str) -> bytes:
        if len(run) == 1 and not self.class_of[ord(run)]:
            return array("I", [self.byte_token[b] for b in run.encode()]).tobytes()
        return array("I", self.encode_run(run)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        if not text:
            return np.zeros(0, "<u4")
        text = (self.prefix + text).replace(" ", MARK)
        classes = self.class_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = (np.flatnonzero(~self.beside[classes[:-1], classes[1:]]) + 1).tolist()
        runs = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
        return np.frombuffer(joined(runs, self._known, self._packed), "<u4")

    def token_bytes(self, ids: np.ndarray) -> bytes:
        """What the ids stand for, one behind the other, the dummy prefix included."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[np.arange(len(shift)) + shift].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: the dummy prefix goes, bytes that are no UTF-8 become a replacement character each."""
        body = self.token_bytes(ids)
        if self.prefix:
            shown = np.flatnonzero(self.kinds[ids] != CONTROL)
            if len(shown) and self.kinds[first := int(ids[shown[0]])] == NORMAL and self.pieces[first].startswith(MARK):
                body = body[1:]
        try:
            return body.decode()
        except UnicodeDecodeError:
            return self._patched(body)

    @staticmethod
    def _patched(body: bytes) -> str:
        made, at = [], 0
        while at < len(body):
            try:
                made.append(body[at:].decode())
                break
            except UnicodeDecodeError as wrong:
                made.append(body[at:at + wrong.start].decode() + "�")
                at += wrong.start + 1
        return "".join(made)


_OPEN: dict[str, Pieces] = {}


def installed(name: str) -> str:
    """Path of a file of the installed tokenizer package, looked up where it is called."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(model: str) -> Pieces:
    """The pieces of a model file, read once per process. ``model``: a path, or a bare name of the installed package."""
    path = model if "/" in model else installed(model)
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def _mapped(docs: DataFrame, model: str, source: str, carry: list[str] | None, outputs: dict[str, tuple[str, pa.DataType]], make) -> DataFrame:
    carry = docs.columns if carry is None else carry
    names = fresh(carry, *outputs)
    [body] = fresh([*carry, *names], "body")
    given = docs.select(*[quoted(name) for name in carry], quoted(source).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            rows = [make(own, value) for value in batch.column(batch.num_columns - 1)]
            columns = list(zip(*rows)) if rows else [[] for _ in outputs]
            made = [pa.array(c, kind) for c, (_, kind) in zip(columns, outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*carry, *names])

    kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields[:-1]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"`{c}` {sql}" for c, (sql, _) in zip(names, outputs.values()))])
    return given.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus ``token_ids``; one pass, no shuffle.

    ``model`` is the path of a model file on every executor, or a bare name of
    the installed package's files; only byte-fallback BPE without a normalizer
    is taken, others are refused. Edge cases: a null text gives no ids, as the
    empty one does. Texts of any length are encoded whole, repeated rows alike.
    An empty table gives an empty one. New columns get a trailing ``_`` where
    names clash.
    """
    return _mapped(docs, model, text, carry, {"token_ids": ("array<int>", pa.list_(pa.int32()))},
                   lambda own, value: (own.encode(value.as_py() or "").astype(np.int32),))


def decode(docs: DataFrame, model: str, ids: str = "token_ids", carry: list[str] | None = None) -> DataFrame:
    """``carry`` plus ``decoded``; null ids give the empty text. See :func:`encode` for the rest."""
    return _mapped(docs, model, ids, carry, {"decoded": ("string", pa.string())},
                   lambda own, value: (own.decode(np.array(value.as_py() or [], np.int64)),))


def round_trip(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` plus n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256: both directions in one pass."""
    def make(own: Pieces, value) -> tuple:
        ids = own.encode(value.as_py() or "")
        shown = ",".join(map(str, ids.tolist()))
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    outputs = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _mapped(docs, model, text, carry, outputs, make)

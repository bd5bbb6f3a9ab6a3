"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by an offset table.

A text is cut into pieces by the tokenizer's pattern. Within a piece the
longest vocabulary entries that start at each byte come from an Aho-Corasick
automaton. The encoder takes the longest one that is *compatible* with the
token before it (the two bytes strings together encode to just these two
tokens), tries shorter prefixes where it is not, and steps back where none is
left. A byte position that was given up once is never entered again, so the
work is linear. Any sequence of pairwise compatible tokens is the one that
merging by rank gives.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectide.llm.common import fresh, quoted, tidy

#: Pieces up to so many characters, and so many of them, are remembered by a task. Bounds memory, changes no result.
REMEMBERED_CHARS, REMEMBERED = 64, 400_000
#: Bytes of a piece up to which the automaton may be started several times.
SHORT = 256
#: White space of the tokenizer's pattern engine (the Unicode property).
SPACE = r"\p{White_Space}"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|"
           + SPACE + r"+(?![^" + SPACE + r"])|" + SPACE + r"+")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 up."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(path: str, content: dict) -> None:
    """Settings of a tokenizer file that this encoder does not follow are refused, not passed over."""
    model, split, decoder = content["model"], content.get("pre_tokenizer") or {}, content.get("decoder") or {}
    wrong = [
        name for name, bad in (
            ("model", model.get("type", "BPE") != "BPE"),
            ("normalizer", content.get("normalizer") is not None),
            ("pre_tokenizer", split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True)),
            ("decoder", decoder.get("type") != "ByteLevel"),
            *((key, bool(model.get(key))) for key in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            ("added_tokens", any(token.get(flag) for token in content["added_tokens"] for flag in ("single_word", "lstrip", "rstrip"))),
        ) if bad]
    if wrong:
        raise ValueError(f"{path}: not plain byte-level BPE by its {', '.join(wrong)}")


class Vocabulary:
    """Tokens, merges and the tables derived from them, read from a tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        refuse_others(path, content)
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        model = content["model"]
        self.added = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.token_of = {spell(token): i for token, i in model["vocab"].items() if token not in self.added}
        spelled = {i: token for token, i in self.token_of.items()} | {i: text.encode() for text, i in self.added.items()}
        #: rank of a merge by its pair; parts of a merged token
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(spell, pair if isinstance(pair, list) else pair.split(" "))
            key = (self.token_of[left], self.token_of[right])
            token = self.token_of[left + right]
            self.rank[key] = rank
            if token not in self.parts:
                self.parts[token] = key
                self.made_at[token] = rank
        automaton = ahocorasick.Automaton()
        self.bytes_of = spelled
        for token, i in self.token_of.items():
            automaton.add_word(token.decode("latin-1"), (len(token) - 1, i))
        automaton.make_automaton()
        self.automaton = automaton
        #: next shorter token that a token begins with
        self.shorter: dict[int, int | None] = {}
        for token, i in self.token_of.items():
            self.shorter[i] = next((j for n in range(len(token) - 1, 0, -1) if (j := self.token_of.get(token[:n])) is not None), None)
        size = max(spelled) + 1
        #: by ``left * size + right``; numbers take less than pairs
        self.compatible: dict[int, bool] = {}
        self.size = size
        lengths = np.array([len(spelled.get(i, b"")) for i in range(size)], np.int64)
        #: decoding: all tokens one behind the other, and where each begins
        self.lengths = lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(size)), np.uint8)
        self.sizes = lengths.tolist()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN)
        self._known: dict[str, bytes] = {}

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether merging by rank never joins bytes across the border of the two tokens.

        Read backwards from the finished pair: what stood at the border at any
        time must not have been merged. The token made later is taken apart
        again and again, and its part at the border stood there until then. A
        merge further left comes first at equal rank: the pair at the border
        comes before a merge inside the right token, and after one inside the
        left token.
        """
        key = left * self.size + right
        known = self.compatible.get(key)
        if known is not None:
            return known
        a, b, until = left, right, len(self.rank)
        while (rank := self.rank.get((a, b))) is None or rank >= until:
            made_a, made_b = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if made_a < 0 and made_b < 0:
                fits = True
                break
            if made_a > made_b:
                until, a = made_a, self.parts[a][1]
            else:
                until, b = made_b + 1, self.parts[b][0]
        else:
            fits = False
        self.compatible[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        return self._encode_short(piece) if len(piece) <= SHORT else self._encode_long(piece)

    def _encode_short(self, piece: bytes) -> list[int]:
        """The longest tokens one behind the other as the automaton gives them, which starts anew behind each that does not fit.

        Every start copies the piece, so it is for short ones only.
        """
        size, text = len(piece), piece.decode("latin-1")
        shorter, sizes, fits, compatible, ids = self.shorter, self.sizes, self.pair_fits, self.compatible, self.size
        tokens: list[int] = []
        closed: set[int] = set()
        at, before = 0, None
        while True:
            for end, (_, token) in self.automaton.iter_long(text, at):
                if before is not None:
                    known = compatible.get(before * ids + token)
                    if not (fits(before, token) if known is None else known):
                        break
                if end + 1 in closed:
                    break
                tokens.append(token)
                at, before = end + 1, token
            else:
                return tokens
            token = shorter[token]
            while token is None or at + sizes[token] in closed or before is not None and not fits(before, token):
                if token is None:  # nothing fits here: never come back, and shorten the token before
                    closed.add(at)
                    token = tokens.pop()
                    at -= sizes[token]
                    before = tokens[-1] if tokens else None
                token = shorter[token]
            tokens.append(token)
            at, before = at + sizes[token], token
            if at == size:
                return tokens

    def _encode_long(self, piece: bytes) -> list[int]:
        """The same from a table of the longest token at each byte."""
        size = len(piece)
        longest: list[int | None] = [None] * size
        for end, (back, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = token  # the ends ascend, so the longest comes last
        shorter, sizes, fits, compatible, ids = self.shorter, self.sizes, self.pair_fits, self.compatible, self.size
        tokens: list[int] = []
        open_at = bytearray(b"\x01") * (size + 1)
        at, token, before = 0, longest[0], None
        while True:
            while token is not None:
                end = at + sizes[token]
                if open_at[end]:
                    if before is None:
                        break
                    known = compatible.get(before * ids + token)
                    if known or known is None and fits(before, token):
                        break
                token = shorter[token]
            if token is None:  # nothing fits here: never come back, and shorten the token before
                open_at[at] = 0
                token = shorter[tokens.pop()]
                at -= sizes[before]
                before = tokens[-1] if tokens else None
            else:
                tokens.append(token)
                at, before = end, token
                if at == size:
                    return tokens
                token = longest[at]

    def _packed(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode())).tobytes()

    def encode(self, text: str, plain: bool = False) -> np.ndarray:
        """Token ids of a whole text; added tokens are matched before anything else, unless their strings are ``plain`` text."""
        parts = self.split_added.split(text) if self.split_added is not None and not plain else [text]
        made = []
        for k, part in enumerate(parts):
            if k % 2:
                made.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                made.append(joined(self.pieces.findall(part), self._known, self._packed))
        return np.frombuffer(b"".join(made), "<u4")

    def token_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one behind the other."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.blob[np.arange(len(shift)) + shift].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return self.token_bytes(ids).decode("utf-8", "replace")


def joined(strings: list[str], known: dict[str, bytes], pack: Callable[[str], bytes]) -> bytes:
    """What ``pack`` gives for each string, one behind the other; it is called once for each that ``known`` does not hold."""
    missing = set(strings).difference(known)
    if missing:
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = set(strings)
        known.update(zip(missing, map(pack, missing)))
    made = b"".join(map(known.__getitem__, strings))
    for string in missing:
        if len(string) > REMEMBERED_CHARS:
            del known[string]
    if len(known) > REMEMBERED:  # one text had more
        known.clear()
    return made


_OPEN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per process."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def installed(name: str) -> str:
    """Path of a file of the installed tokenizer package, looked up where it is called."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _mapped(docs: DataFrame, tokenizer: str, source: str, carry: list[str] | None, outputs: dict[str, tuple[str, pa.DataType]], make) -> DataFrame:
    carry = docs.columns if carry is None else carry
    names = fresh(carry, *outputs)
    [body] = fresh([*carry, *names], "body")
    given = docs.select(*[quoted(name) for name in carry], quoted(source).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(tokenizer if "/" in tokenizer else installed(tokenizer))
        for batch in batches:
            rows = [make(own, value) for value in batch.column(batch.num_columns - 1)]
            columns = list(zip(*rows)) if rows else [[] for _ in outputs]
            made = [pa.array(c, kind) for c, (_, kind) in zip(columns, outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*carry, *names])

    kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields[:-1]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"`{c}` {sql}" for c, (sql, _) in zip(names, outputs.values()))])
    return given.mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus ``token_ids``; one pass, no shuffle.

    ``tokenizer`` is the path of a vocabulary file on every executor, or a bare
    name of the installed package's files. Edge cases: a null text gives no
    ids, as the empty one does. Texts of any length are encoded whole, and
    repeated rows alike. ``token_ids`` gets a trailing ``_`` where names clash.
    """
    return _mapped(docs, tokenizer, text, carry, {"token_ids": ("array<long>", pa.list_(pa.int64()))},
                   lambda own, value: (own.encode(value.as_py() or "").astype(np.int64),))


def decode(docs: DataFrame, tokenizer: str, ids: str = "token_ids", carry: list[str] | None = None) -> DataFrame:
    """``carry`` plus ``decoded``; null ids give the empty text. See :func:`encode` for the rest."""
    return _mapped(docs, tokenizer, ids, carry, {"decoded": ("string", pa.string())},
                   lambda own, value: (own.decode(np.array(value.as_py() or [], np.int64)),))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", carry: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``carry`` plus n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids: both directions in one pass."""
    def make(own: Vocabulary, value) -> tuple:
        ids = own.encode(value.as_py() or "")
        digests = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()
        return (len(ids), *digests, ids.astype(np.int32)) if with_ids else (len(ids), *digests)

    outputs = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if with_ids:
        outputs["token_ids"] = ("array<int>", pa.list_(pa.int32()))
    return _mapped(docs, tokenizer, text, carry, outputs, make)

"""Language identification with error-correcting output codes.

Every language has a codeword. For each of its bits there is a binary
classifier that tells the languages with a 1 from those with a 0 by hashed
character n-grams. Decoding adds up, for each language, the loss of all bits
under its codeword; the least loss wins, so some wrong bits do no harm, and a
text whose two best codewords are close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import fresh, quoted, tidy

BUCKETS, LONGEST = 1 << 15, 3
#: Bound of the training sample: expected rows of each language. All other rows are only scored.
TRAIN_ROWS = 3000
#: Added to every count, so that unseen n-grams weigh little.
SMOOTHING = 0.5
#: Loss by which the best codeword must lead; below it a text is ambiguous.
LEAD = 0.25
#: Up to so many languages every split of them is a bit; beyond, bits are drawn.
ALL_SPLITS, DRAWS = 6, 200
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of the lower-case letters, other characters as one space; none without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))].astype(np.uint32)
    found, rolling = [], np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        rolling = rolling[: len(codes) - n + 1] * np.uint32(0x01000193) + (codes[n - 1:] + np.uint32(n))
        mixed = rolling * np.uint32(0x9E3779B1)
        found.append(mixed >> np.uint32(17))
    return np.concatenate(found).astype(np.int64)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A matrix of +1 and -1, languages by bits, with far apart rows and both signs in each column."""
    if n < 2:
        return np.ones((n, 1))
    if n <= ALL_SPLITS:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, float).T
    random, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, best_gap = None, -1
    for _ in range(DRAWS):
        drawn = np.where(random.random((n, bits)) < 0.5, -1.0, 1.0)
        drawn = drawn[:, np.abs(drawn.sum(axis=0)) < n]
        gap = ((drawn.shape[1] - drawn @ drawn.T) / 2 + np.eye(n) * bits).min()
        if gap > best_gap:
            best, best_gap = drawn, gap
    return best


@dataclass
class Model:
    """``weights[bucket, bit]`` are log ratios; ``codes[language, bit]`` the codewords."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        found = grams(text) if text else np.zeros(0, np.int64)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, True
        margins = self.weights[found].mean(axis=0, dtype=np.float64) * 12.0 * min(1.0, len(found) / 24.0)
        losses = np.logaddexp(0.0, -self.codes * margins).sum(axis=1)
        order = np.argsort(losses, kind="stable")
        share = np.exp(losses[order[0]] - losses)
        lead = losses[order[1]] - losses[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1.0 / share.sum()), bool(lead < LEAD)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Learn from ``docs``: n-grams are counted by Spark over a sample of about ``rows`` rows of each language.

    The sample is drawn by a hash of ``key``, whole texts only. What reaches
    the driver is one row per language and bucket.
    """
    known = docs.filter(quoted(lang).isNotNull() & quoted(text).isNotNull())
    sizes = {row["lang"]: row["n"] for row in known.groupBy(quoted(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32))
    limit = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, rows / sizes[name]))])
    draw = F.pmod(F.xxhash64(quoted(key), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.filter(draw < limit[quoted(lang)]).select(quoted(lang).alias("lang"), quoted(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name not in counts:
                    counts[name] = np.zeros(BUCKETS, np.int64)
                counts[name] += np.bincount(grams(value.as_py()), minlength=BUCKETS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])],
                                             names=["lang", "bucket", "n"])

    sums = drawn.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    rates = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {name: i for i, name in enumerate(languages)}
    rates[sums["lang"].map(place).to_numpy(np.int64), sums["bucket"].to_numpy(np.int64)] += sums["n"].to_numpy(float)
    rates /= rates.sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for bit in range(codes.shape[1]):
        ones, others = codes[:, bit] > 0, codes[:, bit] < 0
        if ones.any() and others.any():
            weights[:, bit] = np.log(rates[ones].mean(axis=0)) - np.log(rates[others].mean(axis=0))
    return Model(languages, codes, weights)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus lang_pred, score and ambiguous; one pass, no shuffle.

    Edge cases: a text that is null, empty or without a letter is ``und`` with
    score 0. With one learned language that one is certain; with none all are
    ``und``. Texts of any length are read whole, repeated rows alike. New
    columns get a trailing ``_`` where names clash.
    """
    carry = docs.columns if carry is None else carry
    names = fresh(carry, "lang_pred", "score", "ambiguous")
    [body] = fresh([*carry, *names], "body")
    given = docs.select(*[quoted(name) for name in carry], quoted(text).alias(body))
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.codes, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            rows = [own.predict(value.as_py()) for value in batch.column(batch.num_columns - 1)]
            columns = list(zip(*rows)) if rows else [[], [], []]
            made = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*carry, *names])

    kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields[:-1]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"])
    return given.mapInArrow(tidy(run), schema)

"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, a
passage the mean of its words, and a linear softmax scores the passage. A
document is as toxic as its most toxic passage; training sends the gradient of
a document through that passage into the softmax and the vectors at once. As
everything below the softmax is a mean, a word adds a fixed amount to the
logit of its passage, which a task works out once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import fresh, quoted, remainder, whole_text

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 16, 8, 3, 5
#: Words of a passage; passages overlap by half.
PASSAGE = 16
#: Bound of the training sample: rows of each label, and bytes of the whole texts of a label. All other rows are only scored.
TRAIN_ROWS, TRAIN_BYTES = 3000, 64 << 20
EPOCHS, BATCH, RATE = 12, 64, 0.3
#: Small samples are gone through more often, until so many batches are done.
LEAST_BATCHES = 600
#: Words a task remembers. Bounds memory, changes no result.
REMEMBERED = 500_000
#: Rows whose words are looked up together.
TOGETHER = 500
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, the edges of the word marked: one behind the other, and how many each has."""
    spelled = [f"<{word.decode('utf-8', 'replace')}>" for word in words]
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    chars = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    begins = np.cumsum(sizes) - sizes
    power = np.cumprod(np.full(int(sizes.max(initial=1)), _FACTOR, np.uint64))
    whole = np.add.reduceat(chars * power[np.arange(len(chars)) - begins[owner]], begins) if len(words) else np.zeros(0, np.uint64)
    hashes, owners, rolled = [_scattered(whole)], [np.arange(len(words))], chars
    for n in range(2, LONGEST + 1):
        rolled = rolled[:-1] * _FACTOR + chars[n - 1:]
        if n >= SHORTEST:
            inside = owner[: len(rolled)] == owner[n - 1:]
            hashes.append(_scattered(rolled[inside] + np.uint64(n)))
            owners.append(owner[: len(rolled)][inside])
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (hashes[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owners, minlength=len(words))


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(16)


def words_of(text: str) -> list[bytes]:
    """Lower-case words without punctuation at their ends; a word said many times in a row counts once."""
    words, last = [], b""
    for raw in text.lower().encode().split():
        word = raw.strip(b".,;:!?\"'()[]{}*-")
        if word and word != last:
            words.append(word)
            last = word
    return words


def passages(size: int) -> np.ndarray:
    """Starts of the passages of ``size`` words; the last one reaches the end."""
    if size <= PASSAGE:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, size - PASSAGE, PASSAGE // 2), size - PASSAGE)


def passage_means(amounts: np.ndarray) -> np.ndarray:
    """Mean amount of each passage."""
    starts = passages(len(amounts))
    through = np.concatenate([[0.0], np.cumsum(amounts)])
    ends = np.minimum(starts + PASSAGE, len(amounts))
    return (through[ends] - through[starts]) / np.maximum(ends - starts, 1)


@dataclass
class Model:
    """Vectors of the buckets, and the softmax as the difference of its two rows."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: float

    def amounts(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the logit of a passage, times the passage's words."""
        return mean_of_subwords(self.vectors @ self.weights, words)


def mean_of_subwords(projected: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Mean over the subwords of each word of what their buckets add: vectors and softmax are linear, so one number a bucket does."""
    if not words:
        return np.zeros(0)
    cells, sizes = subwords(words, len(projected))
    return np.add.reduceat(projected[cells], np.cumsum(sizes) - sizes) / sizes


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit vectors and softmax together by AdaGrad; reruns on the same rows agree."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM))
    weights, bias = random.uniform(-1.0, 1.0, DIM), 0.0
    seen_v, seen_w, seen_b = np.full(BUCKETS, 1e-6), np.full(DIM, 1e-6), 1e-6
    numbers: dict[bytes, int] = {}
    docs = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(text)), np.int64) for text in texts]
    grams, sizes = subwords(list(numbers))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    bias = float(np.log((share[1] + 1e-3) / (share[0] + 1e-3)))
    if not len(grams) or min(share) == 0:
        return Model(vectors, np.zeros(DIM), bias)

    def flat(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of the words one behind the other, and the word each belongs to."""
        n = sizes[words]
        owner = np.repeat(np.arange(len(words)), n)
        ends = np.cumsum(n)
        return grams[np.arange(len(owner)) + np.repeat(begins[words] - (ends - n), n)], owner

    for epoch in range(max(EPOCHS, -(-LEAST_BATCHES * BATCH // len(docs)))):
        # The amounts of all words as they are at the start of the epoch choose the passages.
        projected = vectors @ weights
        amounts = np.add.reduceat(projected[grams], begins[:-1]) / sizes
        chosen = []
        for doc in docs:
            if epoch == 0 or len(doc) <= PASSAGE:
                chosen.append(doc)  # the first epoch averages whole documents
            else:
                at = passages(len(doc))[int(np.argmax(passage_means(amounts[doc])))]
                chosen.append(doc[at:at + PASSAGE])
        order = random.permutation(len(docs))
        for first in range(0, len(order), BATCH):
            own = [i for i in order[first:first + BATCH] if len(chosen[i])]
            if not own:
                continue
            bags = [chosen[i] for i in own]
            lengths = np.fromiter(map(len, bags), np.int64, len(bags))
            words, inverse = np.unique(np.concatenate(bags), return_inverse=True)
            cells, owner = flat(words)
            made = np.stack([np.bincount(owner, vectors[cells, j], len(words)) for j in range(DIM)], 1) / sizes[words][:, None]
            doc_of = np.repeat(np.arange(len(bags)), lengths)
            hidden = np.stack([np.bincount(doc_of, made[inverse, j], len(bags)) for j in range(DIM)], 1) / lengths[:, None]
            error = 1.0 / (1.0 + np.exp(-(hidden @ weights + bias))) - labels[own]
            grad_w, grad_b = hidden.T @ error / len(own), float(error.mean())
            per_word = np.bincount(inverse, (error / lengths)[doc_of], len(words)) / sizes[words]
            used, at = np.unique(cells, return_inverse=True)
            grad_v = np.bincount(at, per_word[owner], len(used))[:, None] * weights / len(own)
            seen_v[used] += (grad_v ** 2).mean(axis=1)
            vectors[used] -= RATE * grad_v / np.sqrt(seen_v[used])[:, None]
            seen_w += grad_w ** 2
            weights -= RATE * grad_w / np.sqrt(seen_w)
            seen_b += grad_b ** 2
            bias -= RATE * grad_b / np.sqrt(seen_b)
    return Model(vectors, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, text: str = "text",
           doc_id: str = "doc_id", label: str = "toxic", held: int = 5) -> DataFrame:
    """``id, text, label``: of each label the ``rows`` rows with the least hash of their id, with their whole texts.

    Rows whose crc32 of the id is divisible by ``held`` are left out, as are
    null ids and labels. In that order, rows are taken until their texts pass
    ``most_bytes`` a label; the first one is taken whatever its length.
    """
    marked = labels.filter(quoted(label).isin(0, 1) & (remainder(doc_id, held) != 0))
    marked = marked.groupBy(quoted(doc_id).alias("id")).agg(F.max(quoted(label)).cast("int").alias("label"))
    given = docs.filter(remainder(doc_id, held) != 0).select(quoted(doc_id).alias("id"), whole_text(text).alias("text"))
    ranked = None
    for value in (0, 1):
        chosen = marked.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(rows)
        ranked = chosen if ranked is None else ranked.unionByName(chosen)
    # At most ``2 * rows`` ids and labels go to the texts' side, and as many lengths into the window.
    lengths = given.select("id", F.octet_length("text").alias("bytes")).join(F.broadcast(ranked), "id")
    lengths = lengths.groupBy("id", "label").agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    through = F.coalesce(before, F.lit(0))
    taken = lengths.withColumn("through", through).filter((F.col("through") == 0) | (F.col("through") + F.col("bytes") <= most_bytes))
    return given.join(F.broadcast(taken.select("id", "label")), "id").select("id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Train on the bounded sample of :func:`sample`, in order of ids, so that reruns agree."""
    found = sample(docs, labels, **options).toPandas().sort_values(["id", "text"])
    return train(found["text"].tolist(), found["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus ``score`` (0 to 1); one pass, no shuffle.

    Edge cases: a null text, or one without words, scores the prior of the
    training rows. Texts of any length are scored whole; repeated rows alike.
    ``score`` gets a trailing ``_`` where names clash.
    """
    carry = docs.columns if carry is None else carry
    name, body = fresh(carry, "score", "body")
    given = docs.select(*[quoted(c) for c in carry], quoted(text).alias(body))
    sent = docs.sparkSession.sparkContext.broadcast((model.vectors @ model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projected, bias = sent.value
        known: dict[bytes, float] = {}
        for batch in batches:
            scores: list[float] = []
            texts = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, TOGETHER):
                held = [words_of(value.as_py() or "") for value in texts[start:start + TOGETHER]]
                new = list({word for words in held for word in words if word not in known})
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list({word for words in held for word in words})
                known.update(zip(new, mean_of_subwords(projected, new).tolist()))
                for words in held:
                    amounts = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                    logit = bias + (float(passage_means(amounts).max()) if words else 0.0)
                    scores.append(1.0 / (1.0 + float(np.exp(-logit))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*carry, name])

    kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields[:-1]}
    return given.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), f"`{name}` double"]))

"""Quality by hierarchical empirical Bayes: document evidence, shrunk through path and host to the whole.

A document classifier gives each document a probability of being good. It is
trained here: byte n-grams of one half of the labelled sample give log ratios,
and a logistic regression on the other half weighs their mean beside lengths
and shares, so that it does not trust ratios on the rows they were counted on.

Per path and per host the probabilities are summed; a host's posterior mean is
drawn towards the global mean and a path's towards its host, the more the fewer
documents it has. How strongly is estimated by the method of moments: from the
spread of hosts around the whole, and of paths around their own host.
The path's posterior then takes the place of the global prior in the
document's odds. Groups are summed where their rows are and only sums move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import SPACES, WORD, fresh, quoted, remainder, whole_text
from vectide.session import materialize

#: Bound of the training sample: rows of each label.
TRAIN_ROWS = 5000
#: Bounds of the pseudo-counts of a prior.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: Share of the site's evidence in the document's odds, and the least quality that is kept.
SITE_WEIGHT, LEAST_QUALITY = 0.5, 0.2
STEPS, RATE, RIDGE = 400, 0.5, 1e-3
#: N-grams of 1 to so many bytes, in so many buckets, and the count that each bucket starts with.
LONGEST, BUCKETS, SMOOTHING = 4, 1 << 16, 0.5
#: Bytes of a text that are hashed at once. Bounds memory, changes no result.
SLICE = 1 << 18


def evidence(text: str = "text") -> list[Column]:
    """What the document classifier sees, as columns: lengths and shares, all computed in the JVM."""
    body = whole_text(text)
    chars = F.greatest(F.char_length(body), F.lit(1)).cast("double")
    words = F.split(F.regexp_replace(body, f"[{SPACES}]+", " "), " ")
    n = F.greatest(F.regexp_count(body, F.lit(WORD)), F.lit(1)).cast("double")
    return [
        F.log1p(n), F.log1p(chars / n),
        F.size(F.array_distinct(words)) / n,
        F.regexp_count(body, F.lit(r"\p{Lu}")) / chars,
        F.regexp_count(body, F.lit(r"[#*$%&|<>!]")) / chars,
        F.regexp_count(body, F.lit(r"[.,;:?]")) / chars,
        F.regexp_count(body, F.lit(r"\p{N}")) / chars,
        F.regexp_count(body, F.lit("\n")) / n,
    ]


def grams(body: bytes) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``LONGEST`` bytes, some at a time; each run once."""
    whole = np.frombuffer(body, np.uint8)
    for start in range(0, len(whole), SLICE):
        own = whole[start:start + SLICE + LONGEST - 1].astype(np.uint32)
        begins = min(SLICE, len(whole) - start)
        packed = np.zeros(begins, np.uint32)
        for n in range(1, LONGEST + 1):
            tail = own[n - 1:n - 1 + begins]
            packed = packed[:len(tail)] | (tail << np.uint32(8 * (n - 1)))
            mixed = (packed ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            yield ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def log_ratios(sample: DataFrame) -> np.ndarray:
    """Of each bucket the log of its share among good texts over that among bad ones; ``sample`` has ``text, label``.

    Counted in the tasks; two rows a bucket reach the driver at most. Zeros
    unless both labels are there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                for found in grams((text.as_py() or "").encode()):
                    counts[label] += np.bincount(found, minlength=BUCKETS)
        at, of = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(of, pa.int32()), pa.array(counts[at, of])],
                                         names=["label", "bucket", "n"])

    sums = sample.select("text", "label").mapInArrow(count, "label int, bucket int, n long")
    sums = sums.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if sums["label"].nunique() < 2:
        return np.zeros(BUCKETS)
    rates = np.full((2, BUCKETS), SMOOTHING)
    rates[sums["label"].to_numpy(int), sums["bucket"].to_numpy(int)] += sums["n"].to_numpy(float)
    rates /= rates.sum(axis=1, keepdims=True)
    return np.log(rates[1]) - np.log(rates[0])


def mean_ratio(ratios: np.ndarray, text: str | None) -> float:
    """Mean log ratio of all n-grams of the text; 0 without any."""
    total, n = 0.0, 0
    for found in grams((text or "").encode()):
        total += float(ratios[found].sum())
        n += len(found)
    return total / n if n else 0.0


def with_ratio(docs: DataFrame, ratios: np.ndarray, text: str, name: str) -> DataFrame:
    """All columns but ``text``, and the mean log ratio of the text as ``name``; one pass, no shuffle."""
    others = [c for c in docs.columns if c != text]
    given = docs.select(*[quoted(c) for c in others], quoted(text))
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [mean_ratio(sent.value, value.as_py()) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(means, pa.float64())], names=[*others, name])

    kinds = {field.name: field.dataType.simpleString() for field in given.schema.fields}
    return given.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{name}` double"]))


def fit_classifier(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps on standardised columns, classes weighed alike; (weights, bias)."""
    if not len(rows) or labels.min() == labels.max():
        return np.zeros(rows.shape[1]), 0.0
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = (rows - mean) / spread
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(x @ w + b))) - labels) * weight
        w -= RATE * (x.T @ error + RIDGE * w)
        b -= RATE * error.sum()
    return w / spread, float(b - (w * mean / spread).sum())


def strength(groups: DataFrame, n_centres: int) -> float:
    """Pseudo-counts of the Beta prior of group means: their spread beyond what chance explains.

    ``groups`` has ``n``, ``good``, the mean ``centre`` that the group belongs
    to and that one's rows ``centre_n``, of which there are ``n_centres``. One
    row reaches the driver.
    """
    n, centre = F.col("n"), F.col("centre")
    row = groups.agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(n * F.pow(F.col("good") / n - centre, 2)).alias("spread"), F.sum(n * centre * (1 - centre)).alias("chance"),
        F.sum(n * n / F.col("centre_n")).alias("squares")).first()
    free = row["groups"] - n_centres
    if free <= 0 or row["n"] - row["squares"] <= 0:
        return MOST_STRENGTH
    chance = row["chance"] / row["n"]
    between = (row["spread"] - free * chance) / (row["n"] - row["squares"])
    return float(np.clip(chance / between - 1, LEAST_STRENGTH, MOST_STRENGTH)) if between > 0 else MOST_STRENGTH


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", doc_id: str = "doc_id",
          label: str = "quality", held: int = 5, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns unless given) plus doc_score, host_score, path_score, quality and kept.

    The classifier learns from at most ``TRAIN_ROWS`` labelled rows of each
    label, those of least id hash, whose crc32 of the id is not divisible by
    ``held``; sums cover all rows. A null host or path is a group like others;
    a null text is empty. Repeated rows count as often as they stand there.
    Without labels every score is the even one. New columns get a trailing
    ``_`` where names clash.
    """
    carry = docs.columns if carry is None else carry
    names = fresh(carry, "doc_score", "host_score", "path_score", "quality", "kept")
    h, p, e, i, body, ratio = fresh([*carry, *names], "host", "path", "evidence", "id", "body", "ratio")
    marked = labels.filter(quoted(label).isin(0, 1) & (remainder(doc_id, held) != 0)).groupBy(
        quoted(doc_id).alias(i)).agg(F.max(quoted(label)).cast("int").alias("label"))
    marked = marked.join(docs.select(quoted(doc_id).alias(i)).distinct(), i)
    chosen = None
    for value in (0, 1):
        part = marked.filter(F.col("label") == value).orderBy(F.xxhash64(i), i).limit(TRAIN_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most ``2 * TRAIN_ROWS`` ids and labels; one half counts n-grams, the other weighs them.
    chosen = materialize(chosen.withColumn("half", F.pmod(F.xxhash64(i, F.lit("half")), F.lit(2))), "labelled")
    counted = F.broadcast(chosen.filter("half = 0").select(i, "label"))
    ratios = log_ratios(docs.select(quoted(doc_id).alias(i), whole_text(text).alias("text")).join(counted, i))

    seen = docs.select(*[quoted(c) for c in carry], host.cast("string").alias(h), path.cast("string").alias(p),
                       F.array(*evidence(text)).alias(e), quoted(doc_id).alias(i), quoted(text).alias(body))
    seen = with_ratio(seen, ratios, body, ratio)
    seen = materialize(seen.withColumn(e, F.concat(F.col(e), F.array(ratio))).drop(ratio), "evidence")
    weighed = F.broadcast(chosen.filter("half = 1").select(i, "label"))
    found = seen.select(i, F.col(e).alias("evidence")).join(weighed, i).toPandas()
    width = len(evidence(text)) + 1
    x = np.array(found["evidence"].tolist(), float).reshape(-1, width)
    # Rows in an order of their own, so that sums of reruns agree.
    order = np.lexsort(x.T)
    w, b = fit_classifier(x[order], found["label"].to_numpy(int)[order])
    logit = sum((F.col(e)[k] * float(w[k]) for k in range(width)), F.lit(b))
    scored = seen.withColumn(names[0], 1 / (1 + F.exp(-logit)))

    paths = scored.groupBy(F.col(h).alias("h"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(names[0]).alias("good"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("hosts")).first()
    mean = float(np.clip((total["good"] or 0.0) / total["n"], 1e-3, 1 - 1e-3)) if total["n"] else 0.5
    host_k = strength(hosts.withColumns({"centre": F.lit(mean), "centre_n": F.lit(total["n"] or 1)}), 1)
    hosts = hosts.select(
        F.col("h").alias("hh"), F.col("n").alias("centre_n"), (F.col("good") / F.col("n")).alias("centre"),
        ((F.col("good") + mean * host_k) / (F.col("n") + host_k)).alias("host_score"))
    within = materialize(paths.join(hosts, paths["h"].eqNullSafe(hosts["hh"])), "within")
    path_k = strength(within, total["hosts"])
    sites = within.select(
        F.col("h").alias(f"{h}_of"), F.col("p").alias(f"{p}_of"), F.col("host_score").alias(names[1]),
        ((F.col("good") + F.col("host_score") * path_k) / (F.col("n") + path_k)).alias(names[2]))
    # Written down, so that the join splits a host that holds much of the rows.
    sites = materialize(sites, "sites")
    joined = scored.join(sites, F.col(h).eqNullSafe(F.col(f"{h}_of")) & F.col(p).eqNullSafe(F.col(f"{p}_of")))
    odds = _odds(F.col(names[0])) + SITE_WEIGHT * (_odds(F.col(names[2])) - _odds(F.lit(mean)))
    judged = joined.withColumn(names[3], 1 / (1 + F.exp(-odds)))
    return judged.select(*[quoted(c) for c in carry], *names[:4], (F.col(names[3]) >= LEAST_QUALITY).alias(names[4]))

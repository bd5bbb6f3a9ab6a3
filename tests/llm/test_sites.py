"""Posteriors of hosts and paths against plain Python, and the document classifier on held-out rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import registry, site_quality
from vectide.llm.common import remainder


def strength_by_hand(groups):
    """``groups``: (n, good, centre, rows of the centre, centre's name)."""
    n = sum(g[0] for g in groups)
    free = len(groups) - len({g[4] for g in groups})
    room = n - sum(g[0] ** 2 / g[3] for g in groups)
    if free <= 0 or room <= 0:
        return site_quality.MOST_STRENGTH
    chance = sum(k * c * (1 - c) for k, _, c, _, _ in groups) / n
    between = (sum(k * (good / k - c) ** 2 for k, good, c, _, _ in groups) - free * chance) / room
    return min(max(chance / between - 1, site_quality.LEAST_STRENGTH), site_quality.MOST_STRENGTH) if between > 0 else site_quality.MOST_STRENGTH


def posteriors_by_hand(rows):
    """(host, path, doc_score) rows to their (host_score, path_score, quality)."""
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for host, path, score in rows:
        for group in (paths[host, path], hosts[host]):
            group[0] += 1
            group[1] += score
    n, good = len(rows), sum(r[2] for r in rows)
    mean = min(max(good / n, 1e-3), 1 - 1e-3)
    host_k = strength_by_hand([(k, g, mean, n, None) for k, g in hosts.values()])
    path_k = strength_by_hand([(k, g, hosts[h][1] / hosts[h][0], hosts[h][0], h) for (h, _), (k, g) in paths.items()])

    def odds(p):
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    made = []
    for host, path, score in rows:
        of_host = (hosts[host][1] + mean * host_k) / (hosts[host][0] + host_k)
        of_path = (paths[host, path][1] + of_host * path_k) / (paths[host, path][0] + path_k)
        both = odds(score) + site_quality.SITE_WEIGHT * (odds(of_path) - odds(mean))
        made.append((of_host, of_path, 1 / (1 + math.exp(-both))))
    return made


def check_posteriors(judged):
    expected = np.array(posteriors_by_hand(judged[["host", "path", "doc_score"]].astype(object).where(lambda v: v.notna(), None).values.tolist()))
    assert np.allclose(judged[["host_score", "path_score", "quality"]].to_numpy(), expected, rtol=1e-9)
    assert ((judged["quality"] >= site_quality.LEAST_QUALITY) == judged["kept"]).all()


def test_posteriors_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    check_posteriors(site_quality.judge(docs, labels, F.col("host"), F.col("path"), carry=["host", "path"]).toPandas())


def invented(spark, n=600):
    """Bad texts have words of their own; a host's share of them goes with its number, its paths alike; one host holds a third."""
    random.seed(3)
    good = [a + b for a in ("ta", "re", "lo", "mi") for b in ("na", "ter", "lin", "do")]
    bad = [a + b for a in ("vu", "xo", "zi") for b in ("qua", "pif", "gro")]
    rows = []
    for i in range(n):
        host = 0 if i % 3 == 0 else random.randrange(1, 9)
        is_good = random.random() > host / 9
        rows.append((i, " ".join(random.choices(good if is_good else good + bad, k=30)), None if host == 8 else f"h{host}", f"p{i % 4}", int(is_good)))
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int")


def test_words_not_lengths_tell_the_quality(spark):
    docs = invented(spark)
    judged = site_quality.judge(docs.drop("quality"), docs.select("doc_id", "quality"), F.col("host"), F.col("path")).toPandas()
    check_posteriors(judged)
    found = judged.merge(docs.withColumn("out", remainder("doc_id", 5) == 0).select("doc_id", "quality", "out").toPandas(), on="doc_id", suffixes=("", "_given"))
    out = found[found["out"]]
    ranks = out["doc_score"].rank()
    n_good, n_bad = (out["quality_given"] == 1).sum(), (out["quality_given"] == 0).sum()
    auc = (ranks[out["quality_given"] == 1].sum() - n_good * (n_good + 1) / 2) / (n_good * n_bad)
    assert auc > 0.95


def test_strength_looks_within_hosts(spark):
    """Hosts that differ, with paths that do not, leave the paths close to their hosts."""
    rows = [(50, 50 * share, share, 200, host) for host, share in ((0, 0.1), (1, 0.9)) for _ in range(4)]
    groups = spark.createDataFrame([r[:4] for r in rows], "n long, good double, centre double, centre_n long")
    assert site_quality.strength(groups, 2) == strength_by_hand(rows) == site_quality.MOST_STRENGTH
    around = groups.withColumns({"centre": F.lit(0.5), "centre_n": F.lit(400)})
    assert site_quality.strength(around, 1) < 1.5


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9, 100])
def test_grams_across_slices(monkeypatch, size):
    body = bytes(random.Random(size).choices(range(256), k=size))
    whole = np.concatenate([np.zeros(0, np.uint32), *site_quality.grams(body)])
    monkeypatch.setattr(site_quality, "SLICE", 3)
    assert sorted(np.concatenate([np.zeros(0, np.uint32), *site_quality.grams(body)])) == sorted(whole)
    assert len(whole) == sum(max(size - n + 1, 0) for n in range(1, site_quality.LONGEST + 1))


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("given"))
    judged = registry.QUERIES["op6_site_quality"](spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert (judged["kept"] == (judged["given"] == 1)).mean() > 0.9

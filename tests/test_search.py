"""Search against brute force, including skew, ties and every way of distribution."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.operators import embedding, search, topk
from vectide.operators.embedding import HashEncoder, embed, embed_hash, hash_encoder_factory, list_encoder
from vectide.operators.hits import hydrate_hits, recall, result_agreement
from vectide.operators.topk import SearchBounds, dealt_tiles, top_k
from vectide.sources.index import build_index, open_index
from vectide.session import scratch_path

DIM = 8
WAYS = {
    "ship queries": {},
    "ship vectors": {"bounds": SearchBounds(many_queries=1)},
    "ship vectors, many queries": {"bounds": SearchBounds(broadcast_bytes=8 * DIM * 350, state_rows=100)},
    "blocks": {"blocks": True, "bounds": SearchBounds(block_vectors=40, block_queries=7)},
    "blocks, nothing fits": {"bounds": SearchBounds(broadcast_bytes=8 * DIM, block_vectors=100, block_queries=30)},
}


def brute(vectors, queries, k, metric):
    """Hits by sorting all scores; vectors and queries are lists of (id, vector[, cell])."""
    found = []
    for q, a, *asked in queries:
        scored = []
        for i, b, *cell in vectors:
            if cell != asked:
                continue
            a64, b64 = np.float64(np.float32(a)), np.float64(np.float32(b))
            score = float(a64 @ b64)
            if metric == "cosine":
                norms = np.sqrt(a64 @ a64) * np.sqrt(b64 @ b64)
                if norms == 0:
                    continue
                score /= norms
            scored.append((-round(score, 6), i))
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def frames(spark, vectors, queries, id_type="bigint", cell=""):
    vectors = spark.createDataFrame(vectors, f"id {id_type}, values array<float>{cell}").repartition(5)
    queries = spark.createDataFrame(queries, f"query_id bigint, vector array<float>{cell}").repartition(3)
    return vectors, queries


def rows(hits):
    return sorted((r[0], r[1], r[2], pytest.approx(r[3], abs=1e-9)) for r in hits.collect())


def grid(rng, n):
    """Few distinct values, so that equal scores are common."""
    return [[float(x) for x in row] for row in rng.integers(-2, 3, (n, DIM))]


@pytest.mark.parametrize("metric", ["ip", "cosine"])
@pytest.mark.parametrize("way", WAYS)
def test_exact(spark, way, metric):
    rng = np.random.default_rng(1)
    vectors = list(enumerate(grid(rng, 300)))
    queries = [(1000 + i, v) for i, v in enumerate(grid(rng, 40))]
    v, q = frames(spark, vectors, queries)
    assert rows(top_k(v, q, 6, metric, DIM, **WAYS[way])) == brute(vectors, queries, 6, metric)


@pytest.mark.parametrize("way", WAYS)
def test_text_ids_and_cells(spark, way):
    rng = np.random.default_rng(2)
    # One cell holds a third of everything.
    cells = ["hot" if i % 3 == 0 else f"c{i % 5}" for i in range(240)]
    vectors = [(f"id{i}", v, c) for i, (v, c) in enumerate(zip(grid(rng, 240), cells))]
    queries = [(i, v, c) for i, (v, c) in enumerate(zip(grid(rng, 30), cells))]
    v, q = frames(spark, vectors, queries, "string", ", cell string")
    assert rows(top_k(v, q, 4, "ip", DIM, cell="cell", **WAYS[way])) == brute(vectors, queries, 4, "ip")


@pytest.mark.parametrize("way", WAYS)
def test_copies_of_one_row(spark, way):
    """A third of the table is one row with one id; every copy is a hit of its own."""
    rng = np.random.default_rng(3)
    same = grid(rng, 1)[0]
    vectors = [(7, same)] * 100 + [(100 + i, v) for i, v in enumerate(grid(rng, 200))]
    queries = list(enumerate([same, *grid(rng, 20)]))
    v, q = frames(spark, vectors, queries)
    assert rows(top_k(v, q, 5, "ip", DIM, **WAYS[way])) == brute(vectors, queries, 5, "ip")


@pytest.mark.parametrize("way", WAYS)
def test_fewer_vectors_than_k_zero_and_malformed(spark, way):
    vectors = [(1, [1.0] * DIM), (2, [0.0] * DIM), (3, [-1.0] * DIM)]
    queries = [(1, [1.0] * DIM), (2, [0.0] * DIM)]
    v, q = frames(spark, [*vectors, (4, [1.0]), (5, None)], [*queries, (3, [2.0])])
    assert rows(top_k(v, q, 5, "cosine", DIM, **WAYS[way])) == [(1, 1, 1, 1.0), (1, 2, 3, -1.0)]


def test_more_hits_than_the_window_group_limit(spark):
    rng = np.random.default_rng(4)
    vectors = list(enumerate(grid(rng, 1500)))
    v, q = frames(spark, vectors, [(0, vectors[0][1])])
    assert rows(top_k(v, q, 1200, "ip", DIM)) == brute(vectors, [(0, vectors[0][1])], 1200, "ip")


def test_parameters_are_checked(spark):
    v, q = frames(spark, [(1, [1.0] * DIM)], [(1, [1.0] * DIM)])
    with pytest.raises(ValueError):
        top_k(v, q, 0, "ip", DIM)
    with pytest.raises(ValueError):
        top_k(v, q, 1, "euclid", DIM)
    with pytest.raises(ValueError):
        search.knn(v, q, method="magic")


def test_empty_tables(spark):
    v, q = frames(spark, [(1, [1.0] * DIM)], [(1, [1.0] * DIM)])
    assert search.knn(v.where("id > 9"), q).count() == 0
    assert search.knn(v, q.where("query_id > 9")).count() == 0
    assert search.knn(v.where("id > 9"), q, method="block").count() == 0


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return (
        table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")),
        table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
    )


def test_scores_never_rise(spark, stored):
    hits = search.knn(*stored, k=5).toPandas().sort_values(["query_id", "rank"])
    assert (hits.groupby("query_id")["score"].diff().dropna() <= 0).all()
    assert (hits.groupby("query_id")["rank"].apply(list).map(lambda r: r == [1, 2, 3, 4, 5])).all()


def test_int8_recall(spark, stored):
    exact = search.knn(*stored, k=5)
    assert recall(search.knn(*stored, k=5, method="int8", oversample=4), exact) >= 0.95


def test_cells_recall_grows_to_exact(spark, stored):
    vectors, queries = stored
    path = scratch_path(spark, "index")
    build_index(vectors, path, cells=8)
    index = open_index(spark, path)
    exact = search.knn(vectors, queries, 5)
    found = [recall(index.search(queries, 5, probes=n), exact) for n in (1, 4, 8)]
    assert found[0] < found[1] < found[2] == 1.0
    assert index.search(queries, 5, probes=8).exceptAll(exact).count() == 0
    assert index.rows.select("id").exceptAll(vectors.select("id")).count() == 0
    assert index.rows.count() == vectors.count()


def test_agreement(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 5)], "query_id int, rank int, id int")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (3, 1, 9)], "query_id int, rank int, id int")
    agreed = {r["query_id"]: (r["n_a"], r["n_b"], r["n_both"], r["overlap"]) for r in result_agreement(a, b, 2).collect()}
    assert agreed == {1: (2, 2, 1, 0.5), 2: (1, 0, 0, 0.0), 3: (0, 1, 0, 0.0)}


def test_hydrate_keeps_hits_and_copies_once(spark):
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 7)], "query_id int, rank int, id int")
    table = spark.createDataFrame([(7, "a"), (7, "a"), (9, "b")], "id int, text string")
    found = hydrate_hits(hits, table, ["text"]).collect()
    assert sorted(map(tuple, found), key=str) == [(1, 1, 7, "a"), (1, 2, 8, None), (2, 1, 7, "a")]


TEXTS = ["", "one two two three", "ÄÖ_ü 42 ²", "...", "a" * 5000, "x y z " * 3000]


def test_both_forms_of_the_hash_encoder_agree(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "i int, text string")
    by_column = dict(embed_hash(rows.na.fill(""), dim=32).select("i", "values").collect())
    by_batch = dict(embed(rows, "text", hash_encoder_factory(32), 32).select("i", "values").collect())
    assert by_column == by_batch
    assert by_column[0] == [0.0] * 32 and len(by_column[5]) == 32


def test_hash_encoder_forgets_when_full():
    import pyarrow as pa

    texts = pa.array([f"word{i} word{i + 1}" for i in range(50)])
    small, large = HashEncoder(16, remembered_tokens=3), HashEncoder(16)
    assert np.array_equal(small(texts), large(texts))
    assert len(small._codes) <= 3


def test_list_encoders_and_wrong_dimensions(spark):
    rows = spark.createDataFrame([("ab",), ("abc",)], "text string")
    encoder = list_encoder(lambda texts: [[len(t), 1.0] for t in texts])
    assert sorted(r[0] for r in embed(rows, "text", lambda: encoder, 2, num_partitions=2).select("values").collect()) == [
        [2.0, 1.0], [3.0, 1.0]]
    with pytest.raises(Exception, match="encoder returned"):
        embed(rows, "text", lambda: encoder, 3).collect()


def test_quantized_queries_saturate(spark):
    codes = spark.range(1).select(
        search.quantize_int8(F.array(F.lit(0.5), F.lit(-9.0), F.lit(0.0), F.lit(1.0)), 1.0).alias("c"),
        search.quantize_int8(F.array(F.lit(0.0)), 0.0).alias("z"),
    ).first()
    assert codes["c"] == [64, -127, 0, 127] and codes["z"] == [0]


def test_cells_in_blocks_are_sent_by_tiles_not_by_blocks(spark):
    """A query names several cells; blocks of 5 would send every vector of a cell 60 times."""
    stored = spark.range(2_400).selectExpr("id", "array(cast(id % 7 as float)) as values", "cast(id % 4 as int) as cell")
    asked = spark.range(300).selectExpr("id as query_id", "array(cast(id % 5 as float)) as vector", "array(0, 1, 2, 3) as cell")
    small = SearchBounds(block_vectors=5, block_queries=5)
    left, right, tile = dealt_tiles(stored, asked, 1, "cell", small)
    assert left.select("id", "cell").distinct().count() == 2_400 and right.select("query_id", "cell").distinct().count() == 1_200
    assert left.count() + right.count() < 12 * (2_400 + 1_200)
    # Each vector meets each query of its cell in exactly one tile.
    met = left.select("id", *tile).join(right.select("query_id", *tile), tile).groupBy("id", "query_id").count()
    assert met.count() == 2_400 * 300 and met.where("count > 1").count() == 0


def test_single_precision_rules_out_no_hit(spark):
    """Scores that differ by less than single precision, and vectors whose product is beyond its range."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(DIM) * 300
    near = [(i, [float(x) for x in np.float32(base * (1 + i * 1e-7))]) for i in range(400)]
    queries = [(i, [float(x) for x in np.float32(rng.standard_normal(DIM) + base)]) for i in range(3)]
    for metric in ("ip", "cosine"):
        v, q = frames(spark, near, queries)
        assert [r[:3] for r in rows(top_k(v, q, 5, metric, DIM))] == [r[:3] for r in brute(near, queries, 5, metric)]
    v, q = frames(spark, [(i, [float(i)] + [3e37] * (DIM - 1)) for i in range(9)], [(0, [1.0] + [2e37] * (DIM - 1))])
    assert len(rows(top_k(v, q, 5, "ip", DIM))) == 5


def test_blocks_of_one_table_are_sent_by_tiles(spark):
    """All vectors against all queries: with blocks of 20 and 15 every row would be sent 100 and more times."""
    stored = spark.range(2_000).selectExpr("id", "array(cast(id % 7 as float)) as values")
    asked = spark.range(2_000).selectExpr("id as query_id", "array(cast(id % 5 as float)) as vector")
    left, right, tile = dealt_tiles(stored, asked, 1, None, SearchBounds(block_vectors=20, block_queries=15))
    assert left.count() + right.count() <= 16 * 4_000
    # What a task may hold decides where that asks for more tiles.
    tight = dealt_tiles(stored, asked, 1, None, SearchBounds(block_vectors=20, block_queries=15, tile_bytes=8 * 100))
    assert tight[0].groupBy(*tile).count().where("count > 200").count() == 0


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    rng = np.random.default_rng(9)

    def side(n):
        values = pa.array(list(rng.standard_normal((n, DIM)).astype(np.float32)), pa.list_(pa.float32()))
        return topk.Side.of(pa.table([pa.array(range(n)), values], names=["id", "values"]), "ip", False)

    scored, pairs = [], topk.Rows.pairs
    monkeypatch.setattr(topk.Rows, "pairs", lambda self, rows, *other: scored.append(len(rows)) or pairs(self, rows, *other))
    queries, vectors = side(2_000), side(5_000)
    best = topk.BestHits(2_000, 5)
    best.offer(np.arange(2_000), vectors.rows, vectors.keys, queries.rows)
    best.merge()
    exact = np.round(queries.rows.matrix.astype(float) @ vectors.rows.matrix.T.astype(float), 6)
    assert np.array_equal(np.sort(best.score.reshape(-1, 5)), np.sort(exact)[:, -5:])
    assert sum(scored) < 2_000 * 5_000 / 100


def test_encoder_is_given_bounded_pieces(spark):
    """Long texts and many short ones in one batch: no call gets more than the limit, no row is lost or moved."""
    texts = ["ab " * (1 + 400_000 * (i % 10 == 3)) for i in range(60)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    pieces = list(embedding.in_pieces(batch, "text"))
    assert pa.Table.from_batches(pieces).to_pylist() == batch.to_pylist()
    assert len(pieces) > 1 and max(sum(len(t or "") for t in p["text"].to_pylist()) for p in pieces) <= embedding.ENCODED_BYTES

    def factory():
        def encode(given):
            assert sum(len(t) for t in given.to_pylist()) <= 4 << 20, "too much text at once"
            return np.ones((len(given), DIM))
        return encode

    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)
    assert embed(df, "text", factory, DIM).where(F.size("values") == DIM).count() == len(texts)


def test_long_tokens_are_not_remembered():
    encoder = HashEncoder(16)
    encoder(pa.array(["short " + "x" * 1_000]))
    assert "short" in encoder._codes and len(encoder._codes) == 2


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_a_side_stays_in_single_precision(metric):
    values = pa.array([[1.0] * DIM] * 100, pa.list_(pa.float32()))
    keys, parts, _ = topk.Side.of(pa.table([pa.array(range(100)), values], names=["id", "values"]), metric, False).values()
    assert len(keys) == 100 and parts[0].nbytes == 4 * DIM * 100

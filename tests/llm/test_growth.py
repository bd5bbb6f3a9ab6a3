"""What must not change or drop out as the data grows: refinement, training rows, rounds and ranges, shares in characters."""

import os
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectide.llm import bpe, common, exact_dedup, jaccard, passages, registry, repetition, toxicity
from vectide.session import materialize


def test_only_rows_that_share_length_and_prefix_are_hashed(spark, monkeypatch):
    rows = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(" of one length")).alias("text"))
    rows = rows.union(rows.filter("doc_id % 1000 = 0").selectExpr("doc_id + 1000000", "text"))
    rows = rows.union(spark.createDataFrame([(-1, "x" * 70 + "a"), (-2, "x" * 70 + "b")], "doc_id long, text string"))
    hashed, write = [], exact_dedup.materialize

    def counted(frame, label):
        table = write(frame, label)
        if label == "hashed":
            hashed.append(table.count())
        return table

    monkeypatch.setattr(exact_dedup, "materialize", counted)
    for most in (exact_dedup.BROADCAST_PAIRS, 10):
        monkeypatch.setattr(exact_dedup, "BROADCAST_PAIRS", most)
        groups = exact_dedup.mark_copies(rows, carry={"doc_id": F.col("doc_id")}).groupBy("group_size", "kept").count().collect()
        assert {tuple(r) for r in groups} == {(1, True, 299_702), (2, True, 300), (2, False, 300)}
    assert hashed == [602, 602]


def test_shares_are_of_characters():
    """Ten cyrillic words on a line that comes twice, and ten plain ones: by bytes the share would be larger."""
    line, other = " ".join(f"слово{i}" for i in range(10)), " ".join(f"words{i}" for i in range(10))
    found = repetition.measure(f"{line}\n{line}\n{other}")
    assert found.dup_line_share == pytest.approx(1 / 3) and found.dup_share[5] == pytest.approx(1 / 3) and found.word_chars == 180
    assert found.top_share[2] == 0 and repetition.verdict(found) == (True, False)


def test_toxicity_on_held_out_rows(spark):
    folder = os.environ.get("VECTIDE_LARGER_DATA", "/root/testdata/sf0.1")
    found = registry.QUERIES["op10_toxicity"](spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = found[found["held_out"]]
    ranks, toxic = held["score"].rank(), held["toxic"] == 1
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area >= 0.9 and (held["predicted"] == held["toxic"]).mean() > 0.93


def test_long_texts_are_learnt_from(spark):
    random = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in ("ta", "re", "lo", "mi", "su") for b in ("na", "ter", "lin", "do", "ker")]
    rows = [(i, " ".join([*random.choice(plain, 5_000), *(["grumpfung", "grumpfen"] * 100 if i % 2 else []), *random.choice(plain, 100)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, carry=["doc_id"]).toPandas()
    assert ((scored["score"] >= 0.5) == (scored["doc_id"] % 2 == 1)).mean() > 0.9
    bounded = toxicity.sample(docs, labels, most_bytes=100_000).toPandas()
    assert set(bounded["label"]) == {0, 1} and bounded["text"].str.len().groupby(bounded["label"]).sum().max() <= 100_000
    assert len(toxicity.sample(docs, labels, most_bytes=1).toPandas()) == 2


def test_subwords_are_those_of_the_word():
    words = [b"ab", "größe".encode(), b"x" * 300, b"ab"]
    cells, sizes = toxicity.subwords(words)
    assert sizes.tolist() == [1 + sum(max(0, len(w.decode()) + 2 - n + 1) for n in (3, 4, 5)) for w in words]
    ends = np.cumsum(sizes)
    assert cells[:sizes[0]].tolist() == cells[ends[2]:].tolist()
    alone, _ = toxicity.subwords([words[1]])
    assert cells[ends[0]:ends[1]].tolist() == alone.tolist()


@pytest.fixture(scope="module")
def passages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first, rows = {}, sorted(docs.collect())
    for i, text in rows:
        body = (text or "").encode()
        for k in range(len(body) - 49):
            first.setdefault(body[k:k + 50], i)
    found = {}
    for i, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - 49):
            if first[body[k:k + 50]] < i:
                gone[k:k + 50] = True
        found[i] = np.frombuffer(body, np.uint8)[~gone].tobytes()
    return docs, found


@pytest.mark.parametrize("settings", [{"FILTER_BITS": 14, "RANGE_BYTES": 1 << 20, "RUN": 5_000}, {"ROUNDS": 0, "BROADCAST_TEXTS": 0, "RUN": 20_000}])
def test_passages_in_rounds_and_without_a_table(monkeypatch, passages_by_hand, settings):
    for name, value in settings.items():
        monkeypatch.setattr(passages, name, value)
    docs, by_hand = passages_by_hand
    found = {r["doc_id"]: bytes(r["kept_bytes"]) for r in passages.remove_repeats(docs, carry=["doc_id"]).collect()}
    assert found == by_hand


def test_key_filter_misses_none(spark):
    keys = spark.range(50_000).select(F.xxhash64("id").alias("key"))
    others = spark.range(50_000, 100_000).select(F.xxhash64("id").alias("key")).toPandas()["key"].to_numpy()
    table = common.key_filter(keys)
    assert common.may_hold(table, keys.toPandas()["key"].to_numpy()).all() and common.may_hold(table, others).mean() < 0.1
    small = common.key_filter(keys, most_bytes=1)
    assert common.may_hold(small, keys.toPandas()["key"].to_numpy()).all()
    assert not common.may_hold(common.key_filter(keys.filter("false")), others).any()


def test_components_of_links(spark):
    links = pd.DataFrame({"a": [5, 4, 3, 10, 11], "b": [4, 3, 2, 11, 12]})
    found = jaccard.components(spark.createDataFrame(links)).select("class", "root").toPandas().set_index("class")["root"].to_dict()
    assert found == {2: 2, 3: 2, 4: 2, 5: 2, 10: 10, 11: 10, 12: 10}


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


def test_shuffles_go_when_the_table_is_written(spark):
    before = _shuffle_files(spark)
    rows = spark.range(1_000).repartition(5, "id")
    written = materialize(rows, "written")
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert written.count() == 1_000 and materialize(rows, "again").count() == 1_000


def test_signatures_go_before_rows_are_written(spark, monkeypatch):
    labels, write = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda frame, label: labels.append(label) or write(frame, label))
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(9)], "doc_id long, text string")
    found = {tuple(r) for r in jaccard.join_similar(docs, carry=["doc_id"]).select("doc_id", "component_id").collect()}
    assert found == {(i, i % 3) for i in range(9)}
    assert labels.index("led") < labels.index("classes")


def test_copies_are_not_shuffled_to_few_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    expected = {(i, max(range(i % 40, 100, 40)), len(range(i % 40, 100, 40))) for i in range(100)}
    for most, joined in ((exact_dedup.BROADCAST_GROUPS, False), (10, True)):
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            marked = exact_dedup.mark_copies(docs, carry={"doc_id": F.col("doc_id")})
            assert {tuple(r)[:3] for r in marked.collect()} == expected
            assert ("SortMergeJoin" in marked._jdf.queryExecution().executedPlan().toString()) is joined
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_merge_takes_few_bytes_a_suffix():
    rng = np.random.default_rng(3)
    runs = []
    for _ in range(4):
        table = np.unique(rng.integers(97, 123, (5_000, passages.LENGTH)).astype(np.uint8), axis=0)
        shared, tails = passages.front_code(table)
        shared = np.frombuffer(shared, np.uint8)
        runs.append((passages.unfold(shared, tails), shared))
    tracemalloc.start()
    order, _ = passages.merge_runs(runs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(order) == 20_000 and most < 40 * len(order)


def test_blocks_of_anchors_are_even():
    """Anchors have the least hash around them; their blocks must not all be the first ones."""
    body = np.random.default_rng(4).integers(97, 123, 400_000).astype(np.uint8)
    at, hashes = passages.anchors(body)
    assert len(np.unique(hashes)) == len({body[p:p + passages.GRAM].tobytes() for p in at.tolist()})
    sizes = np.bincount(passages._place(hashes, 6)[0], minlength=64)
    assert sizes.max() < 1.5 * len(at) / 64


def test_short_and_long_pieces_are_encoded_alike():
    ours = bpe.Vocabulary(bpe.installed("byte_bpe_50k.json"))
    random = np.random.default_rng(6)
    made = ["".join(random.choice(list("theranoi söé"), random.integers(1, 60))).encode() for _ in range(3_000)]
    for piece in [*made, *(bytes(random.integers(0, 256, 20, np.uint8)) for _ in range(500)), *ours.token_of]:
        assert ours._encode_short(piece) == ours._encode_long(piece)


def test_each_string_is_packed_once():
    """Of a text with one new string, the others must not be asked for again one by one."""
    asked, known = [], {"a": b"1", "b": b"2"}
    pack = lambda string: asked.append(string) or string.encode()
    long = "x" * (bpe.REMEMBERED_CHARS + 1)
    assert bpe.joined(["a", "c", "b", "c", long, long], known, pack) == b"1c2c" + 2 * long.encode()
    assert sorted(asked) == ["c", long] and set(known) == {"a", "b", "c"}


def test_a_task_gives_its_memory_back():
    kept = []

    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    def run(batches):
        for batch in batches:
            held = [b"%5d" % i * 12_000 for i in range(3_000)]
            kept.append(b"%5d" % batch * 12_000)  # lies behind all that is freed
            yield len(held)

    before = resident()
    assert list(common.tidy(run)(iter([1]))) == [3_000] and resident() - before < 60
    assert common.tidy_groups(lambda rows: len([b"%5d" % i * 12_000 for i in range(rows)]))(3_000) == 3_000 and resident() - before < 60


@pytest.mark.parametrize("part_bytes", [8 << 20, 200_000])
def test_a_set_is_not_sent_for_each_pair(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(jaccard, "PART_BYTES", part_bytes)
    base = np.random.default_rng(8).integers(0, 1 << 63, 10_000).astype(np.uint64)
    made = [base[np.random.default_rng(k).random(10_000) < (0.95 if k % 2 else 0.85)] for k in range(40)]
    made = [np.sort(own) for own in made]
    sets = spark.createDataFrame([(k, own.tobytes()) for k, own in enumerate(made)] + [(3, made[3].tobytes())], "class long, elements binary")
    wanted = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    linked = {(a, b) for a, b in wanted if jaccard._linked(made[a], made[b])}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffle_bytes(spark)
        found = jaccard._verified(spark.createDataFrame(wanted, "a long, b long"), sets).collect()
        sent = _shuffle_bytes(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert linked and linked < set(wanted) and {tuple(r) for r in found} == linked
    if part_bytes == 8 << 20:
        assert sent < 0.6 * len(wanted) * min(map(len, made)) * 8


@pytest.mark.parametrize("rows", [1_000_000, 10])
def test_sets_of_small_groups_are_sent_once(spark, monkeypatch, rows):
    """However many parts there are; with many rows each set is shuffled once more, to meet its homes."""
    monkeypatch.setattr(jaccard, "PART_BYTES", 200_000)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", rows)
    rng, made = np.random.default_rng(9), []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, 4_000).astype(np.uint64)
        made += [np.sort(base[rng.random(4_000) < share]) for share in (0.97, 0.96, 0.95, 0.85)]
    sets = spark.createDataFrame([(k, own.tobytes()) for k, own in enumerate(made)], "class long, elements binary")
    wanted = [(a, b) for k in range(0, 160, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)]
    linked = {(a, b) for a, b in wanted if jaccard._linked(made[a], made[b])}
    before = _shuffle_bytes(spark)
    found = {tuple(r) for r in jaccard._verified(spark.createDataFrame(wanted, "a long, b long"), sets).collect()}
    sent = _shuffle_bytes(spark) - before
    assert found == linked and linked
    assert sent < (1.3 if rows > 10 else 2.3) * 8 * sum(map(len, made))


def _shuffle_bytes(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(os.path.join(at, name)) for folder in folders for at, _, names in os.walk(folder) for name in names if name.startswith("shuffle_"))

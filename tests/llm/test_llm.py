"""The training-data operators against plain Python, SQL and odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from compare import difference, sql_rows

from vectide.llm import bpe, chat, exact_dedup, jaccard, language, mixing, passages, registry, repetition, site_quality, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    sql = sql_rows(registry.SQL[name], sf_dir)
    assert difference(registry.QUERIES[name](spark, sf_dir).select(*sql.columns).toPandas(), sql) is None


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.installed("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark, sf_dir):
    theirs = tokenizer()
    found = {r["doc_id"]: r for r in registry.QUERIES["op2_bpe_round_trip"](spark, sf_dir).collect()}
    for i, text in rows_of(spark, sf_dir)[["doc_id", "text"]].itertuples(index=False):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_strings():
    theirs, ours = tokenizer(), bpe.vocabulary(bpe.installed("byte_bpe_50k.json"))
    assert all(ours.encode_piece(token) == [i] for token, i in ours.token_of.items())
    random.seed(1)
    parts = ["a", "aa", " ", "  ", "\n", "'s", "'ll", "the", "ing", "ß", "日本", "1", "23", "!", "<|endoftext|>", "<|", "🙂", "\x1c", "\x85", "tion"]
    for text in ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(3000)] + ["a" * 30_000, "ab" * 10_000]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == ids and ours.decode(np.array(ids, int)) == text


def links_by_hand(texts):
    sets = {}
    for i, text in texts:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = min(5, len(words))
        sets[i] = {tuple(words[j:j + n]) for j in range(len(words) - n + 1)} if words else set()
    least = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {i: (len(sets[i]), least[i]) for i in sets}


def test_jaccard_join_equals_all_pairs(spark, sf_dir):
    found = {r[0]: (r[1], r[2]) for r in registry.QUERIES["op3_jaccard_join"](spark, sf_dir).collect()}
    assert found == links_by_hand(rows_of(spark, sf_dir)[["doc_id", "text"]].itertuples(index=False))


def test_jaccard_signatures_lose_no_link():
    random.seed(3)
    bands = jaccard.Bands()
    for _ in range(1500):
        size = random.randint(1, 400)
        a = np.array(sorted({random.getrandbits(64) for _ in range(size)}), np.uint64)
        drop = random.randint(0, size // 9)
        b = np.array(sorted({*a[drop:].tolist(), *(random.getrandbits(64) for _ in range(random.randint(0, size // 9)))}), np.uint64)
        if len(b) and jaccard._linked(a, b):
            assert set(jaccard.signatures(a, bands)) & set(jaccard.signatures(b, bands))
            assert jaccard.may_link(len(a), len(b), jaccard.sketch(a), jaccard.sketch(b))


def test_members_of_a_leader_are_compared_in_pieces(spark, monkeypatch):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(120)]
    sets = [np.array(sorted({*random.sample(base, random.randint(80, 120)), *(random.getrandbits(64) for _ in range(random.randint(0, 9)))}), np.uint64)
            for _ in range(60)]
    classes = spark.createDataFrame([(i, len(s), jaccard.sketch(s)) for i, s in enumerate(sets)], "class long, n long, sketch binary")
    stars = spark.createDataFrame([(-1, i) for i in range(60)], "a long, b long")
    roots = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "class long, root long")
    linked = {(a, b) for a in range(60) for b in range(a + 1, 60) if jaccard._linked(sets[a], sets[b])} - {(0, 1), (2, 3)}
    found = []
    for side in (1_024, 7):
        monkeypatch.setattr(jaccard, "SIDE", side)
        found.append({tuple(r) for r in jaccard._possible_under_leaders(stars, roots, classes).collect()})
    assert found[0] == found[1] and linked and linked <= found[0]
    assert len(found[0]) < 60 * 59 // 4


def repeats_by_hand(texts):
    first, found = {}, {}
    for i, text in sorted(texts):
        body = (text or "").encode()
        gone = [False] * len(body)
        for j in range(len(body) - 49):
            if first.setdefault(body[j:j + 50], i) < i:
                gone[j:j + 50] = [True] * 50
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        found[i] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return found


def test_repeated_passages_equal_brute_force(spark, sf_dir):
    found = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op5_repeated_passages"](spark, sf_dir).collect()}
    assert found == repeats_by_hand(rows_of(spark, sf_dir)[["doc_id", "text"]].itertuples(index=False))


def test_merge_of_runs_sorts_and_knows_prefixes():
    random.seed(5)
    runs, everything = [], []
    for _ in range(7):
        words = sorted(bytes(random.choices(b"ab", k=6)) + bytes(random.choices(b"abc", k=44)) for _ in range(random.randint(0, 60)))
        if words:
            table = np.frombuffer(b"".join(words), np.uint8).reshape(-1, 50)
            shared, tails = passages.front_code(table)
            shared = np.frombuffer(shared, np.uint8)
            assert passages.unfold(shared, tails) == words
            runs.append((words, shared))
            everything += words
    order, prefix = passages.merge_runs(runs)
    merged = [everything[i] for i in order]
    assert merged == sorted(everything)
    for x, y, n in zip(merged, merged[1:], prefix[1:]):
        assert x[:n] == y[:n] and x[n:n + 1] != y[n:n + 1] or n == 50


def test_repetition_figures(spark, sf_dir):
    random.seed(2)
    texts = ["".join(random.choices(["a ", "b ", "a\n", "b", "\n", "c d ", " ", "é "], k=random.randint(0, 60))) for _ in range(1500)]
    for text in [*texts, *rows_of(spark, sf_dir)["text"]]:
        words, seen, repeated, covered = WORD.findall(text), set(), 0, set()
        for line in text.split("\n"):
            repeated += bool(WORD.search(line)) and line in seen
            seen.add(line)
        counts = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        for i in range(len(words) - 4):
            covered.update(range(i, i + 5) if counts[tuple(words[i:i + 5])] > 1 else ())
        found = repetition.measure(text)
        assert (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered))


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", r"\[<[INST]</s>\\"), (1, 1, "assistant", "<<SYS>> ok "), (2, 0, "assistant", "first"), (2, None, None, None),
         (3, 0, "tool", "[ROLE]x[TEXT]"), (None, 0, "user", " ")], "conv_id int, turn int, role string, text string")
    chats = chat.format_chats(turns)
    found = {r["conv_id"]: r for r in chats.withColumns(
        {"read": chat.read_turns(F.col("formatted")), "learned": chat.loss_text(F.col("segments"))}).collect()}
    assert [tuple(t) for t in found[1]["read"]] == [("user", r"\[<[INST]</s>\\"), ("assistant", "<<SYS>> ok ")]
    assert found[1]["learned"] == "<<SYS>> ok " and found[1]["valid"] and found[1]["first_bad_turn"] is None
    assert [tuple(t) for t in found[2]["read"]] == [("", ""), ("assistant", "first")] and found[2]["first_bad_turn"] == 0
    assert [tuple(t) for t in found[3]["read"]] == [("tool", "[ROLE]x[TEXT]")] and not found[3]["valid"]
    assert [tuple(t) for t in found[None]["read"]] == [("user", " ")]


def test_mixture_repeats_whole_documents(spark, sf_dir):
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    assert (mixed["taken"] == mixed["copies"] * mixed["size"]).all() and mixed["copies"].between(0, 3).all()
    for _, own in mixed.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()


def test_models_on_held_out_rows(spark, sf_dir):
    found = registry.QUERIES["op1_language_id"](spark, sf_dir).toPandas().merge(rows_of(spark, sf_dir), on="doc_id")
    held = found[found["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and held["score"].between(0, 1).all()
    scored = registry.QUERIES["op10_toxicity"](spark, sf_dir).toPandas()
    assert len(scored) == len(found) and scored["score"].between(0, 1).all()
    assert ((scored["score"] >= 0.5) == (scored["predicted"] == 1)).all()
    judged = registry.QUERIES["op6_site_quality"](spark, sf_dir).toPandas().merge(rows_of(spark, sf_dir, "labels"), on="doc_id")
    assert ((judged["quality_x"] >= site_quality.LEAST_QUALITY) == judged["kept"]).all()
    assert (judged["kept"] == (judged["quality_y"] == 1)).mean() > 0.85


def test_toxic_stems_carry_over_to_new_words():
    random.seed(4)
    plain = [f"{a}{b}" for a in ("ta", "re", "lo", "mi", "su") for b in ("na", "ter", "lin", "do", "ker")]
    def text(bad):
        words = random.choices(plain, k=40)
        return " ".join([*words[:20], *(["grumpf" + random.choice(["a", "en", "or", "ist", "el"])] if bad else []), *words[20:]])
    labels = np.array([i % 2 for i in range(300)])
    model = toxicity.train([text(y) for y in labels], labels)
    def logit(t):
        return toxicity.passage_means(model.amounts(toxicity.words_of(t))).max() + model.bias
    assert logit("tana grumpfung reter loker") > 0 > logit("tana sudo reter loker")


def test_output_codes_are_far_apart():
    for n in (2, 3, 5, 12, 30):
        codes = language.codewords(n)
        gaps = (codes.shape[1] - codes @ codes.T) / 2 + np.eye(n) * 99
        assert gaps.min() >= 1 and (abs(codes.sum(axis=0)) < n).all()


def every_operator(docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "cast(doc_id % 2 as int) as quality")
    return {
        "language": language.identify(docs, language.fit(docs)), "exact": exact_dedup.mark_copies(docs), "drop": exact_dedup.drop_copies(docs),
        "jaccard": jaccard.join_similar(docs), "near": jaccard.drop_similar(docs), "passages": passages.remove_repeats(docs),
        "mix": mixing.mix(docs), "mixture": mixing.mixture(docs), "bpe": bpe.encode(docs, "byte_bpe_50k.json"),
        "round": bpe.round_trip(docs, "byte_bpe_50k.json", with_ids=True), "rules": repetition.judge(docs),
        "toxicity": toxicity.score(docs, toxicity.fit(docs, labels.select("doc_id", "toxic"))),
        "sites": site_quality.judge(docs, labels.select("doc_id", "quality"), F.col("source"), F.col("lang")),
    }


def test_no_rows(no_documents):
    for name, found in every_operator(no_documents).items():
        assert found.count() == 0, name


def test_odd_rows(spark, odd_documents):
    n, columns = odd_documents.count(), odd_documents.columns
    made = {name: found.toPandas() for name, found in every_operator(odd_documents).items()}
    for name, found in made.items():
        assert list(found.columns[:len(columns)]) == columns, name
        assert len(set(found.columns)) == len(found.columns), name
        if name not in ("drop", "near", "mixture"):
            assert len(found) == n, name
    exact = made["exact"]
    assert exact["kept_"].sum() == len(made["drop"]) == exact["text"].fillna("").nunique()
    near = made["jaccard"]
    passage = near[near["doc_id"].isin([4, 5])]
    assert set(passage["component_id_"]) == {4} and passage["stays"].sum() == 1
    assert near[near["n_shingles"] == 0]["stays"].all()
    cut = made["passages"].set_index("doc_id")
    assert (cut.loc[5, "n_removed"] == cut.loc[5, "n_bytes_"]).all() and cut.loc[4, "n_removed"] == 0
    assert set(made["language"][made["language"]["lang_pred"] == "und"]["doc_id"]) >= {1, 2, 3, 11}
    assert (made["mix"].loc[made["mix"]["text"].isna(), "taken"] == 0).all()
    for text, digest in made["round"][["text", "decoded_sha256"]].itertuples(index=False):
        assert digest == hashlib.sha256((text or "").encode()).hexdigest()


def test_pipeline_stages_and_result(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = docs.toPandas()
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == list(given.columns)
        kept.append(docs.toPandas())
    assert len(kept[0]) >= 0.98 * len(given)
    texts = dict(kept[0][["doc_id", "text"]].itertuples(index=False))
    largest = {}
    for i, text in texts.items():
        largest[text] = max(i, largest.get(text, i))
    assert sorted(kept[1]["doc_id"]) == sorted(largest.values())
    groups = links_by_hand(kept[1][["doc_id", "text"]].itertuples(index=False))
    assert sorted(kept[2]["doc_id"]) == sorted(i for i, (_, least) in groups.items() if i == least)
    assert set(kept[3]["doc_id"]) <= set(kept[2]["doc_id"]) and kept[3].groupby("doc_id").size().max() <= 3
    theirs, run = tokenizer(), corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(run["doc_id"]) == sorted(kept[3]["doc_id"]) and "text" not in run
    for i, ids in run[["doc_id", "token_ids"]].itertuples(index=False):
        assert list(ids) == theirs.encode(texts[i], add_special_tokens=False).ids

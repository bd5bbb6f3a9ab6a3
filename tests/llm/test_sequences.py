"""Piece encoding, conversation repair and token alignment against libraries and plain Python."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import alignment, bpe, pieces, registry, repair

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHAR = re.compile(r"[^\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.installed(B))


def odd_strings(n, seed):
    random.seed(seed)
    parts = ["a", "aa", " ", "  ", "    ", "\n", "\t", "ing", "the", " the", "ß", "日本", "1", "23", "!", "<s>", "</s>", "<unk>", "<0x41>", "🙂",
             "\x00", "\x01", "▁", "▁▁", "---", "====", "é", "\r\n", "﻿", "​", "ﬁ", "　", " (", "tion", "://", "<|endoftext|>"]
    return ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(n)]


def test_pieces_equal_the_library(library):
    own = pieces.pieces(B)
    for text in [*odd_strings(3000, 3), *(" " * n for n in range(100)), "a" * 30_000, "ab " * 10_000]:
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_pieces_are_decoded_as_the_library_does(library):
    own = pieces.pieces(B)
    random.seed(4)
    for _ in range(3000):
        ids = [random.choice([random.randrange(32_000), random.randrange(260), 28_705, 259]) for _ in range(random.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_op11_equals_the_library(spark, sf_dir, library):
    found = {r["doc_id"]: r for r in registry.QUERIES["op11_piece_round_trip"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "")
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
        assert [found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]] == [len(ids), *digests]


def test_pieces_on_odd_rows(spark, odd_documents, no_documents, library):
    made = pieces.encode(odd_documents, B)
    assert made.columns == [*odd_documents.columns, "token_ids_"]
    back = pieces.decode(made.withColumn("token_ids", F.col("token_ids_")), B).select("text", "token_ids", "decoded").collect()
    for text, ids, decoded in back:
        assert ids == library.encode(text or "") and decoded == (text or "")
    assert pieces.round_trip(no_documents, B).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="normalizer, pre_tokenizer"):
        bpe.Vocabulary(bpe.installed("word_bpe_49k.json"))
    pb = pytest.importorskip("sentencepiece").sentencepiece_model_pb2
    model = pb.ModelProto()
    with open(pieces.installed(B), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.byte_fallback = False
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="no byte fallback, a normalizer"):
        pieces.Pieces(str(path))


# -- alignment ---------------------------------------------------------------


def aligned_by_hand(rows):
    """doc_id -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by comparing the ranges of all tokens."""
    theirs = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.installed(A))
    theirs.encode_special_tokens = True
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.installed(B))
    letters, found, counts = bpe.byte_letters(), {}, collections.Counter()
    for i, text in rows:
        a, b = (theirs.encode(" " + text, add_special_tokens=False).ids, library.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in theirs.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if library.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [library.id_to_piece(x)]]
        if any(b"".join(side) != (" " + (text or "")).encode() for side in (bytes_a, bytes_b)):
            a = b = []
        ends_a, ends_b = ([0, *np.cumsum([len(x) for x in side]).tolist()] for side in (bytes_a, bytes_b))
        links, x, y, groups, group = [], 0, 0, [], ([], [])
        while a and x < len(a):
            links.append((a[x], b[y]))
            if ends_a[x + 1] == ends_b[y + 1]:
                groups.append((group[0] + [a[x]], group[1] + [b[y]]))
                x, y, group = x + 1, y + 1, ([], [])
            elif ends_a[x + 1] < ends_b[y + 1]:
                group[0].append(a[x])
                x += 1
            else:
                group[1].append(b[y])
                y += 1
        if len(a) < 200:
            pairs = [(p, q) for u, p in enumerate(a) for v, q in enumerate(b) if max(ends_a[u], ends_b[v]) < min(ends_a[u + 1], ends_b[v + 1])]
            assert sorted(pairs) == sorted(links)
        counts.update(set(links))
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        found[i] = (a, b, groups, links, shown)
    top = collections.defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    return {i: (len(a), len(b), len(g), len(k), sum(counts[p] == top[p[0]] for p in k), sum(counts[p] for p in k), shown)
            for i, (a, b, g, k, shown) in found.items()}


def rows_as_by_hand(frame):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in frame.collect()}


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE_PAIRS, 2_000])
def test_alignment_equals_plain_python(spark, sf_dir, slice_pairs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = ["", None, " ", "a", "▁x", "x\x00y", "<|endoftext|> hi </s>", "🙂 日本 ß\n\n\n  ", "a" * 5000, "🙂" * 3000, *odd_strings(100, 8)]
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    found = rows_as_by_hand(alignment.align(docs, A, B, carry=["doc_id"], with_groups=True, slice_pairs=slice_pairs))
    assert found == aligned_by_hand([tuple(r) for r in docs.collect()])


def test_op13_carries_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    by_hand = aligned_by_hand([tuple(r) for r in rows])
    found = registry.QUERIES["op13_token_alignment"](spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        shown = by_hand[r["doc_id"]][-1]
        assert r["groups_sha256"] == (hashlib.sha256(shown.encode()).hexdigest() if shown else "")


def test_pieces_of_the_merge_are_stitched():
    random.seed(9)
    for _ in range(200):
        ends = [sorted(random.sample(range(1, 60), random.randint(0, 40))) + [60] for _ in range(2)]
        whole = alignment.Alignment(*(np.array(e) for e in ends), piece=10_000)
        for piece in (1, 2, 3, 7):
            found = alignment.Alignment(*(np.array(e) for e in ends), piece=piece)
            assert found.groups == whole.groups == len(set(ends[0]) & set(ends[1]))
            for name in ("group_a", "group_b", "link_a", "link_b"):
                assert getattr(found, name).tolist() == getattr(whole, name).tolist()


def test_alignment_on_odd_rows(odd_documents, no_documents):
    made = alignment.align(odd_documents, A, B)
    assert made.columns[:len(odd_documents.columns)] == odd_documents.columns
    rows = made.collect()
    assert len(rows) == odd_documents.count()
    assert all((r["n_a"], r["n_b"], r["groups_sha256"]) == (0, 0, "") for r in rows if not r["text"])
    assert alignment.align(no_documents, A, B).count() == 0


# -- repair ------------------------------------------------------------------


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        shown = CHAR.findall(text)
        found.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def repaired_by_hand(rows):
    """(cost, audit, repaired rows), by trying all edits."""
    marks, fits = faults(rows), re.compile(r"(s?(ua)+)?\Z")
    best = (3 * len(rows), DELETED * len(rows), [])

    def search(i, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and fits.match("".join(role[:1] or "?" for role, _ in out)):
            best = min(best, (cost, audit, out), key=lambda x: x[:2])
        for role in ("user", "assistant"):
            search(i, cost + 2, audit + "I", out + [(role, "")])
        if i < len(rows):
            search(i + 1, cost + 3, audit + "D", out)
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                search(i + 1, cost + more, audit + "K", out + [rows[i][1:]])
                for role in ("user", "assistant"):
                    search(i + 1, cost + 2 + more, audit + "R", out + [(role, rows[i][2])])

    search(0, 0, "", [])
    return best


DELETED = "D"


def repaired(rows):
    first, found, edits = {}, repair.Conversation(), []
    for turn, role, text in rows:
        shown = CHAR.findall(text)
        least = first.setdefault((role, text), turn)
        edits += found.add(turn, role, text, not shown, not shown or shown[-1] not in ".!?", turn is not None and (least is None or turn > least))
    edits += found.finish()
    return found, [(role, text) for letter, role, text in edits if letter != "D"]


def drawn_rows(n):
    turn, rows = 0, []
    for _ in range(n):
        turn += random.choice([0, 1, 1, 1, 3])
        rows.append((turn, random.choice(["user", "assistant", "system", "user", "assistant", "tool", " "]), random.choice(["hi.", "ok!", "no", "", "  ", "x?"])))
    return sorted(rows)


@pytest.mark.parametrize("prime, waiting", [(None, 256), (None, 1), (1, 1), (3, 2)])
def test_cheapest_edits_equal_trying_all(monkeypatch, prime, waiting):
    """Also where all hashes collide, and where edits are sent on at once."""
    monkeypatch.setattr(repair, "WAITING", waiting)
    if prime:
        monkeypatch.setattr(repair, "_PRIME", prime)
    random.seed(5)
    for _ in range(500):
        rows = drawn_rows(random.randint(0, 4))
        cost, audit, out = repaired_by_hand(rows)
        found, made = repaired(rows)
        assert (found.cost, "".join(found.audit), made) == (cost, audit, out), rows
        assert (found.blank, found.duplicate, found.truncated) == tuple(map(faults(rows).count, ("blank", "duplicate", "truncated")))


def test_long_conversations_pass_in_bounded_memory():
    random.seed(6)
    found, most = repair.Conversation(), 0
    for i in range(20_000):
        for _ in found.add(i, random.choice(["user", "assistant", "system"]), f"x{i}.", random.random() < 0.1, False, False):
            pass
        most = max(most, len(found.rows))
    assert most <= 2 * repair.WAITING and len(list(found.finish())) < 600 and "".join(found.audit).count("I") > 0


def test_comparison_of_long_strings():
    random.seed(7)
    start = repair.Edit(None, "")
    strings = ["".join(random.choices("DIK", k=random.randint(0, 40))) for _ in range(60)]
    nodes = []
    for text in strings:
        node = start
        for letter in text:
            node = repair.Edit(node, letter)
        nodes.append(node)
    for x, a in zip(strings, nodes):
        for y, b in zip(strings, nodes):
            assert repair.before(a, b) == (x < y)


def damaged_by_hand(rows):
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        drawn = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if drawn == 1 else re.sub("[.!?]", "", text) if drawn == 2 else text
        row = (turn, "user" if drawn == 4 else role, text)
        found[conv] += [] if drawn == 0 else [row, row] if drawn == 3 else [row]
    return {conv: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, rows in found.items()}


def summary_by_hand(rows):
    cost, audit, out = repaired_by_hand(rows) if len(rows) < 5 else (lambda f: (f[0].cost, "".join(f[0].audit), f[1]))(repaired(rows))
    turns = {t for t, _, _ in rows if t is not None}
    marks = faults(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{role}:{text}" for role, text in out)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(marks.count, ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def check_repair(made, rows):
    found = {r[0]: tuple(r)[1:] for r in made.collect()}
    by_hand = damaged_by_hand(rows)
    assert set(found) == set(by_hand)
    for conv, own in by_hand.items():
        assert found[conv] == summary_by_hand(own), conv


def test_op12_equals_plain_python(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repair(registry.QUERIES["op12_conversation_repair"](spark, sf_dir), rows)


def test_repair_on_odd_rows(spark):
    random.seed(10)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "b"), (1, None, "user", "b"), (1, 5, "assistant", ""),
            (2, 1, "", "x."), (3, 7, "Assistant", "\t"), (4, 2, "system", None), (5, None, "user", "only."), (6, 1, "user", "é" * 50_000)]
    rows += [(100 + c, t, role, text) for c in range(60) for t, role, text in drawn_rows(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as cost", "'x' as audit", "true as lost")
    damaged = repair.damage(frame)
    check_repair(repair.repair(damaged, lost="lost"), rows)
    assert repair.repair(frame.filter("false")).count() == 0
    whole = repair.repaired_rows(damaged, lost="lost").orderBy("conv_id", "place").collect()
    texts = collections.defaultdict(list)
    for r in whole:
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in repair.repair(damaged, lost="lost").collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(texts[r["conv_id"]]).encode()).hexdigest()

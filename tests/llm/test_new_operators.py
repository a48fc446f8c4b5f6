"""Packing, conversation repair and the manifest against plain versions."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute_new as brute
from wardspark.llm import conversation_repair as repair
from wardspark.llm import manifest, packing
from wardspark.llm.queries import QUERIES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- packing

def bins(counts, length):
    """(lengths, ...) of every sequence of the plan."""
    return [[n for n, times in held for _ in range(times)]
            for many, held in packing.plan(counts, length) for _ in range(many)]


@pytest.mark.parametrize("length", [1, 2, 7, 64])
def test_plan_uses_every_piece_once(length):
    rng = np.random.default_rng(length)
    for _ in range(60):
        counts = np.zeros(length + 1, np.int64)
        for n in rng.integers(1, length + 1, rng.integers(0, 8)):
            counts[n] += int(rng.choice([1, 1, 2, 5, 40]))
        found = bins(counts, length)
        assert all(sum(b) <= length for b in found)
        used = np.bincount([n for b in found for n in b], minlength=length + 1) if found else counts * 0
        assert (used == counts).all()
        total = int((np.arange(length + 1) * counts).sum())
        assert len(found) >= -(-total // length)


def test_exact_complements_leave_no_gap():
    counts = np.zeros(101, np.int64)
    counts[[60, 40]] = 5, 5            # pairs
    counts[[50, 30, 20]] = 4, 4, 4     # a pair in the gap
    counts[[70, 15, 10, 5]] = 3, 3, 3, 3   # a triple in the gap
    assert len(bins(counts, 100)) == 12
    counts = np.zeros(101, np.int64)
    counts[34], counts[33] = 5, 10     # the same length twice
    assert len(bins(counts, 100)) == 5
    counts = np.zeros(101, np.int64)
    counts[2] = 500                    # many small ones in a sequence
    assert len(bins(counts, 100)) == 10
    assert bins(np.zeros(101, np.int64), 100) == []


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.lognormal(6.4, 1, 30_000).astype(int) + 1, 4096), minlength=4097)
    found = packing.plan(counts)
    total = int((np.arange(4097) * counts).sum())
    assert sum(many for many, _ in found) <= 1.005 * -(-total // 4096)


def test_word_coder_equals_the_library(monkeypatch):
    judge, own = Tokenizer.from_file(WORD_BPE), packing.WordCoder(WORD_BPE)
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    rng = np.random.default_rng(8)
    signs = list("abAZ é́É.,'s!\"-  \n\t\x0b  2²日İıſKΣς<|>") + [
        "'ll ", "don't ", "e.g. ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "x" * 70, "...", ".a", " \n "]
    for _ in range(150):
        texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(20)] + [""]
        ids, sizes = own.encode(pa.array(texts, pa.string()))
        found = np.split(ids, np.cumsum(sizes)[:-1])
        for text, one in zip(texts, found):
            assert one.tolist() == judge.encode(text, add_special_tokens=False).ids, text
    assert own.encode(pa.array([], pa.string()))[1].tolist() == []


def test_word_coder_holds_no_more_words_than_it_may(monkeypatch):
    judge, own = Tokenizer.from_file(WORD_BPE), packing.WordCoder(WORD_BPE)
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    for n in [20, 20, 5, 40, 1, 20]:
        texts = [" ".join(f"word{n}x{i}" for i in range(n)) + " " + "long" * 20] * 2 + [f"once{n}"]
        ids, sizes = own.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for t in texts for i in judge.encode(t, add_special_tokens=False).ids]
        assert len(own.known) <= 30 and f"once{n}" not in own.known and "long" * 20 not in own.known
        assert len(own.sizes) == len(own.known) and own.sizes.sum() == len(own.ids)


TEXTS = [(1, "Some words. " * 3), (2, "a b c d " * 30), (3, "a b c d " * 30), (3, "a b c d " * 30), (4, None), (5, ""),
         (None, "no id"), (None, None), (6, "x <|endoftext|> y"), (7, "word " * 100), (8, "Ünïcode É 日本語 😀, ok.")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, n, "clash") for n, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, rank string").repartition(3)


@pytest.mark.parametrize("length", [10, 64])
def test_packing(docs, length):
    judge = Tokenizer.from_file(WORD_BPE)
    packed = packing.pack(packing.cut(docs, WORD_BPE, 1, length, with_ids=True), length)
    rows = packed.collect()
    wanted = sorted([(k, *p[:4]) for k, t in TEXTS for p in brute.pieces(t, judge, 1, length)], key=repr)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == wanted
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length, r.ids))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for number, parts in held.items():
        parts.sort(key=lambda p: p[0])
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts[:-1]]).tolist()
        assert sum(p[1] for p in parts) <= length
        assert whole[number] == [i for p in parts for i in p[2]]
    assert set(whole) == set(held)


@pytest.mark.parametrize("most", [0, 200_000])
def test_packing_writes_the_pieces_only(spark, docs, monkeypatch, most):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", most)  # joined by shuffle, or by broadcast
    paths = []
    monkeypatch.setattr("wardspark.session._OPEN", [paths])
    packed = packing.pack(packing.cut(docs, WORD_BPE, 1, 10), 10)
    judge = Tokenizer.from_file(WORD_BPE)
    wanted = sorted([(k, *p[:4]) for k, t in TEXTS for p in brute.pieces(t, judge, 1, 10)], key=repr)
    rows = packed.collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == wanted
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert len(paths) == 1 and "/pieces-" in paths[0]


def test_packing_nothing(docs):
    assert packing.pack(packing.cut(docs.filter("false"), WORD_BPE)).count() == 0


# ---- conversation repair

SAYINGS = ["Hello there.", "Fine!", "no end", "  ", "", "What?", "Fine!", " x . ", "so\n", None]


def invented(seed, most):
    rng, rows = random.Random(seed), []
    for conv in [*range(80), None]:
        for n in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "util"])
            rows.append((conv, rng.choice([n, n, n, n * 2, None]), role, rng.choice(SAYINGS)))
    return rows


@pytest.mark.parametrize("seed,most", [(1, 4), (2, 7), (3, 12)])
def test_repair_equals_the_cheapest_of_all_ways(spark, seed, most):
    rows = invented(seed, most)
    turns = spark.createDataFrame([(*r, "clash") for r in rows],
                                  "conv_id long, turn long, role string, text string, cost string").repartition(3)
    got = sorted([tuple(r) for r in repair.repair(repair.damaged(turns)).collect()], key=repr)
    assert got == sorted([(k, *brute.repaired(v)) for k, v in brute.damaged(rows).items()], key=repr)


def test_every_way_is_tried():
    """The cheapest repair of all short conversations, by trying all edit sequences."""
    from itertools import product

    edits = [(i, e) for i in ("", "I", "II") for e in "DKR"]
    texts = {0: "ok.", 1: "", 3: "open"}
    for initials in product("sua", repeat=3):
        for faults in random.Random("".join(initials)).sample(list(product(texts, repeat=3)), 5):
            rows = [(n, {"s": "system", "u": "user", "a": "assistant"}[c], f"{n}{texts[f]}" if f != 1 else "")
                    for n, (c, f) in enumerate(zip(initials, faults))]
            best = None
            for ways in product(edits, repeat=3):
                for tail in ("", "I", "II"):
                    cost, state, ok = 3 * len(tail), "", all(e == "D" for (_, e), f in zip(ways, faults) if f == 1)
                    for (inserted, edit), c, f in zip(ways, initials, faults):
                        cost += 3 * len(inserted) + {"D": 4, "K": 0, "R": 3}[edit] + (3 if f == 3 and edit != "D" else 0)
                        for _ in inserted:
                            state += "a" if state[-1:] == "u" else "u"
                        if edit == "R":
                            state += "a" if state[-1:] == "u" else "u"
                        elif edit == "K":
                            ok = ok and c in {"": "su", "s": "u", "u": "a", "a": "u"}[state[-1:]]
                            state += c
                    for _ in tail:
                        state += "a" if state[-1:] == "u" else "u"
                    if ok and state[-1:] in ("", "a"):
                        audit = "".join(i + e for i, e in ways) + tail
                        best = min(best or (99, ""), (cost, audit))
            steps = repair.Steps()
            conversation = repair.Conversation(steps, 1)
            for (turn, role, text), f in zip(rows, faults):
                conversation.add(turn, role, text, f)
            found = conversation.result()
            assert found[6:8] == best and brute.repaired(rows)[5:7] == best, (initials, faults)


def test_giant_conversation_waits_in_files(monkeypatch):
    """Buffers of a few bytes and chunks of a few rows give what large ones give."""
    rng = random.Random(2)
    rows = [(n, rng.choice(["user", "assistant", "tool"]), f"text {n}.", rng.choice([0, 0, 0, 1, 2, 3]))
            for n in range(5000)]

    def run():
        conversation = repair.Conversation(repair.Steps(), 1)
        for row in rows:
            conversation.add(*row)
        return conversation.result()

    wanted = run()
    monkeypatch.setattr(repair, "HELD", 64)
    for chunk in (1, 7, 4999, 5000, 5001):
        monkeypatch.setattr(repair, "CHUNK", chunk)
        assert run() == wanted


def test_batches_of_any_size(spark):
    rows = invented(5, 9)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    wanted = sorted(map(repr, repair.repair(turns).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(repr, repair.repair(turns).collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert repair.repair(turns.filter("false")).count() == 0
    plan = repair.repair(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# ---- manifest

def documents(seed, sizes):
    rng, rows, number = random.Random(seed), [], 0
    for source, size in sizes.items():
        for _ in range(size):
            number += 1
            rows.append((number * 7 % 1009, source, rng.choice(["en", None]), rng.choice([None, number]),
                         rng.choice(["a\nb", "plain", "", None, "é\n\n日"])))
    rng.shuffle(rows)
    return rows


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_of(spark, rows):
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, "
                                                             "text string, at string").repartition(3)
    shown = F.when(manifest_fold(), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.manifest(table, FIELDS, "doc_id", "source", {"text": shown})


def manifest_fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 4}, {"a": 9, "b": 10, "c": 28, None: 5, "é": 1, "Z": 2}])
def test_manifest(spark, sizes):
    rows = documents(1, sizes)
    rows += [(None, "a", "en", 1, "x\ny"), rows[0], rows[0], (rows[0][0], *rows[0][1:4], "other")]
    got = sorted([tuple(r) for r in manifest_of(spark, rows).collect()], key=repr)
    assert got == sorted(brute.manifest(rows), key=repr)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_many_superblocks(spark, monkeypatch, levels):
    """Superblocks of 3 or 9 leaves: several levels of them, in the groups and above."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3 ** levels)
    for block, size in ((0, 5), (1, 4), (2, 3 ** levels)):
        shapes = manifest._levels([str(n) for n in range(size)][:3 ** levels], block)
        assert len(shapes) == levels + 1 if block else len(shapes[-1]) == 1
    rows = documents(2, {f"s{n:02}": n % 5 + 1 for n in range(12)} | {"hot": 100})
    nodes = [brute.leaf(r) for r in sorted(r for r in rows if r[1] == "hot")]
    top, proofs = brute.climbed(nodes)
    # the local functions, level by level, as Spark groups them
    import pandas as pd
    level, at = [pd.DataFrame({"grp": "hot", "at": range(len(nodes)), "digest": nodes})], 0
    while len(level[-1]) > 1 or len(level) == 1:
        below = level[-1].assign(block=level[-1]["at"] // manifest.BLOCK)
        level.append(pd.concat([manifest._top(("hot", b), g) for b, g in below.groupby("block")]))
    assert level[-1]["digest"].tolist() == [top]
    outer = pd.DataFrame({"grp": "hot", "at": [0], "lefts": [[]], "rights": [[]], "subroot": [top]})
    for below in level[-2::-1]:
        below = below.assign(block=below["at"] // manifest.BLOCK)
        outer = pd.concat([manifest._descend(g, outer[outer["at"] == b]) for b, g in below.groupby("block")])
    for node, lefts, rights, own in zip(nodes, outer["lefts"], outer["rights"], proofs):
        assert ["".join(a) for a, _ in own] == list(lefts) and ["".join(b) for _, b in own] == list(rights)


def test_manifest_of_nothing(spark):
    rows = documents(1, {"a": 2})
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.manifest(table.filter("false"), FIELDS, "doc_id", "source").count() == 0
    found = manifest.manifest(table, FIELDS, "doc_id", "source")
    assert found.filter("verified").count() == 2


def test_queries(spark, tmp_path):
    """The registered queries on small tables."""
    rows = documents(4, {"a": 30, "b": 5, None: 2})
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    turns = invented(6, 6)
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    sf = str(tmp_path)
    got = sorted([tuple(r) for r in QUERIES["op13_manifest"](spark, sf).collect()], key=repr)
    assert got == sorted(brute.manifest(rows), key=repr)
    got = sorted([tuple(r) for r in QUERIES["op12_conversation_repair"](spark, sf).collect()], key=repr)
    assert got == sorted([(k, *brute.repaired(v)) for k, v in brute.damaged(turns).items()], key=repr)
    judge = Tokenizer.from_file(WORD_BPE)
    got = sorted([tuple(r)[:5] for r in QUERIES["op11_packing"](spark, sf).collect()], key=repr)
    assert got == sorted([(r[0], *p[:4]) for r in rows for p in brute.pieces(r[4], judge)], key=repr)

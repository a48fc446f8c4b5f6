"""The pipeline and the registered queries without SQL twins, against plain versions of their rows."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from wardspark.llm import bpe
from wardspark.llm.queries import QUERIES

PASSAGE = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
WORDS = {"en": "the dog and cat are asleep while rain falls on every old house in town".split(),
         "de": "der hund und die katze schlafen nicht weil regen auf jedes alte haus im dorf".split()}


def invented():
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(WORDS[lang], 90)), lang)
            for i, lang in enumerate(["en", "de"] * 12)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + ".", "de"), rows[2], rows[2]]
    rows += [(110, f"{rows[4][1]} {PASSAGE.upper()}! {rows[6][1]}", "en"), (111, "too few words", "en"),
             (112, " ".join(map(str, rng.permutation(900)[:80] + 10)), "en"), (113, None, None),
             (114, "", "de"), (115, rows[8][1].upper(), "en"), (116, "# " + rows[9][1] + " $" * 30, "de"),
             (117, "same line of text\n" * 30, "en"), (None, " ".join(rng.choice(WORDS["en"], 80)), "en")]
    return rows


ROWS = invented()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "documents": (ROWS, "doc_id long, text string, lang string"),
        "benchmark": ([(1, PASSAGE), (2, "never anywhere")], "item_id long, text string"),
        "labels": ([(k, int(lang == "en")) for k, _, lang in ROWS[:24]], "doc_id long, quality int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    return path


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def encoded(text):
    own = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    judge = tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks,
                              special_tokens={})
    ids = judge.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(), ids)


def stages_of_plain_versions():
    windows = brute.item_windows([(1, PASSAGE), (2, "never anywhere")])
    rows = [(k, t) for k, t, _ in ROWS if brute.kept(t)]
    yield rows
    rows = [r for r in rows if any(c.isalpha() for c in r[1])]
    yield rows
    roots, first = brute.linked([(k, brute.simhash(t)) for k, t in rows]), {}
    for root, row in sorted(zip(roots, rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        first.setdefault(root, row)
    yield list(first.values())
    yield [(k, t) for k, t in first.values() if not brute.overlap(t, windows)[1]]


def test_every_stage_keeps_the_rows_of_its_plain_version(spark, folder):
    docs, sizes = spark.read.parquet(f"{folder}/documents.parquet"), [len(ROWS)]
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, stages_of_plain_versions()):
        docs = corpus_pipeline.written(stage(spark, docs, folder), "stage")
        assert rows_of(docs.select("doc_id", "text")) == sorted(wanted, key=repr)
        sizes.append(len(wanted))
    assert sizes == sorted(set(sizes), reverse=True)  # each stage drops something


def test_pipeline_chains_the_stages(spark, folder):
    *_, last = stages_of_plain_versions()
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert rows_of(found) == sorted([(k, *encoded(t)) for k, t in last], key=repr)


def test_op1_quality_classifier(spark, folder):
    label = {k: int(lang == "en") for k, _, lang in ROWS[:24]}
    found = rows_of(QUERIES["op1_quality_classifier"](spark, folder))
    assert [r[:2] for r in found] == sorted([(k, brute.fold(k, 5) == 0) for k, _, _ in ROWS], key=repr)
    assert all(predicted == (score >= 0.3) and predicted == label.get(k, predicted)
               for k, _, score, predicted in found)


def test_op2_lm_scoring(spark, folder):
    train = [brute.fold(k, 5) != 1 for k, _, _ in ROWS]
    texts = [t for _, t, _ in ROWS]
    model = brute.Ppm([t for t, own in zip(texts, train) if own])
    wanted = sorted([(k, not own, *b, model.score(t)) for (k, t, _), own, b in zip(
        ROWS, train, brute.base(texts, train))], key=repr)
    found = rows_of(QUERIES["op2_lm_scoring"](spark, folder))
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted])


def test_op4_simhash_dedup(spark, folder):
    prints = [(k, brute.simhash(t)) for k, t, _ in ROWS]
    wanted = [(k, f"{p:016x}", root) for (k, p), root in zip(prints, brute.linked(prints))]
    assert rows_of(QUERIES["op4_simhash_dedup"](spark, folder)) == sorted(wanted, key=repr)


def test_op5_byte_bpe(spark, folder):
    wanted = [(k, *encoded(t)[:3]) for k, t, _ in ROWS]
    assert rows_of(QUERIES["op5_byte_bpe"](spark, folder)) == sorted(wanted, key=repr)


def test_op7_token_files(spark, folder):
    judge = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, wanted = 0, []
    for key, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*judge.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(QUERIES["op7_token_files"](spark, folder)) == sorted(wanted, key=repr)


def test_op10_language_id(spark, folder):
    lang = {k: v for k, _, v in ROWS[:24]}
    found = rows_of(QUERIES["op10_language_id"](spark, folder))
    assert [r[:2] for r in found] == sorted([(k, brute.fold(k, 3) == 1) for k, _, _ in ROWS], key=repr)
    assert all(got == lang.get(k, got) for k, _, got, _ in found)
    assert {k for k, _, got, _ in found if got == "und"} == {112, 113, 114}

"""Awkward cases of the training-data operators: collisions, huge attachments, clashing names, slices, plain models."""

import hashlib
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wardspark.llm import (bpe, chat_format, columns, common, decontamination, features, language, licences, ppm,
                           quality_model, quality_rules, simhash, token_files)
from wardspark.session import scratch_path


def test_windows_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    """With two hash values in all, every window is a suspect and neighbours differ."""
    def coarse(words):
        n = F.size(words)
        return F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda word, i: F.shiftleft(
            F.pmod(F.xxhash64(word), F.lit(2)), 31).bitwiseOR(i.cast("long")))

    monkeypatch.setattr(quality_rules, "_window_keys", coarse)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 25))) for _ in range(60)] + ["a b c " * 30, "x y z w"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._row.doc_id: r.n_repeat_words for r in quality_rules.ledger(table).collect()}
    assert got == {n: brute.rules(t)[4] for n, t in enumerate(texts)}


# ---- attachments

def attachment_rows(spark, *parts):
    listed = ", ".join(f"named_struct('type', '{t}', 'text', CAST(NULL AS STRING), 'ref', 'r', 'width', {w}, 'height', {h}, "
                       f"'seconds', {s}, 'pages', {p})" for t, w, h, s, p in parts)
    return spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(array({listed}) AS "
                     f"array<{chat_format.PART}>) AS content")


@pytest.mark.parametrize("part,tokens", [
    (("image", 2 ** 31 - 1, 2 ** 31 - 1, "NULL", "NULL"), 76695845 ** 2), (("image", 1, 1, "NULL", "NULL"), 1),
    (("image", "NULL", 5, "NULL", "NULL"), 1), (("image", -5, 100, "NULL", "NULL"), 1),
    (("document", "NULL", "NULL", "NULL", 10_000_000), 2_560_000_000), (("document", "NULL", "NULL", "NULL", -3), 1),
    (("audio", "NULL", "NULL", "double('infinity')", "NULL"), 1), (("audio", "NULL", "NULL", "double('nan')", "NULL"), 1),
    (("audio", "NULL", "NULL", "1e300", "NULL"), 1), (("audio", "NULL", "NULL", "4000.0D", "NULL"), 100_000)])
def test_attachments_of_any_size(spark, part, tokens):
    row = chat_format.parse(chat_format.format_conversations(attachment_rows(spark, part))).head()
    assert [a.tokens for a in row.attachments] == [tokens]
    mark = f"<|{part[0]}|>"
    shown = mark * tokens if tokens <= chat_format.MOST_PLACEHOLDERS else f"<|{part[0]}*{tokens}|>"
    assert shown in row.formatted


def test_formatting_nothing_and_other_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi <|end|>", "x", 5)],
                                  "conv_id long, turn long, role string, text string, body string, mask int")
    made = turns.withColumn("content", chat_format.text_part(F.col("text")))
    row = chat_format.parse(chat_format.format_conversations(made)).head()
    assert [(t.role, t.text) for t in row.turns] == [("user", "hi <|end|>")]
    assert chat_format.parse(chat_format.format_conversations(made.filter("false"))).count() == 0


# ---- near duplicates

def test_one_of_each_with_columns_without_order(spark):
    rows = [(1, "same text here", {"a": 1}, 2), (1, "same text here", {"b": 2}, 1), (2, "same text here", None, 0),
            (3, "quite another text", {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, root int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.root) for r in kept.collect())
    assert got == [(1, 1), (3, None)]  # of equal ids and texts the least other columns that have an order


# ---- language-model scores

def test_scores_by_keys_of_any_name(spark):
    rows = [(n, f"k{n}", 1.0, f"some words {n % 3} here", n % 2 == 0) for n in range(12)]
    docs = spark.createDataFrame(rows, "block long, token string, score double, text string, train boolean")
    found = ppm.score(docs, ["block", "token", "score"], "train").collect()
    assert sorted((r._key.block, r._key.token, r._key.score) for r in found) == [r[:3] for r in rows]
    assert ppm.score(docs.filter("false"), ["block"], "train").count() == 0
    assert all(r.score < 0 for r in ppm.score(docs, ["block"], F.lit(False)).collect())


def test_slices_of_long_texts_give_the_same_scores(spark, monkeypatch):
    train = [t.encode() for t in ("banana bandana " * 20, "can a man", "")]
    grams, counts = ppm._gram_counts(train)
    for size in (1, 2, 7, 64, 319, 320, 321):
        monkeypatch.setattr(ppm, "SLICE", size)
        again = ppm._gram_counts(train)
        assert (again[0] == grams).all() and (again[1] == counts).all()
        own = ppm.Lengths(grams, np.arange(len(grams), dtype=float))
        got = own.of(ppm._buffer(train))
        assert len(got) == len(ppm._buffer(train)) - ppm.ORDER
        if size == 1:
            wanted = got
        assert (got == wanted).all()


def test_feature_slices(monkeypatch):
    text = "Grüße aus dem 日本 " * 30
    def found():
        return [np.sort(np.concatenate(list(f(x, (1, 3, 5), 12)))) for f, x in (
            (features.byte_grams, text.encode()), (features.character_grams, text))]
    wanted = found()
    for size in (1, 4, 5, 6, len(text) - 1, len(text), len(text) + 1):
        monkeypatch.setattr(features, "SLICE", size)
        assert all((a == b).all() for a, b in zip(found(), wanted))
    # characters, not bytes: as many 3-grams as places
    assert len(list(features.character_grams("äöü", (3,), 12))[0]) == 1


@pytest.mark.parametrize("size", [1, 9, 10, 11, 1 << 20])
def test_byte_bpe_slices(spark, monkeypatch, size):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import tiktoken
    own = bpe.coder(path, public_tokenizers.PATTERN)
    judge = tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.vocabulary.ranks,
                              special_tokens={})
    monkeypatch.setattr(columns, "SLICE_BYTES", size)
    monkeypatch.setattr(bpe, "DECODED_BYTES", max(1, size // 2))
    import pyarrow as pa
    texts = ["", "a  b", "x" * 400, "é　 z, ok", None, "one two two. ", " end", "日本 <|endoftext|>"] * 2
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    rows = [part for part in columns.slices(batch)]
    assert sum(r.num_rows for r in rows) == len(texts)
    got = [ids for r in rows for ids in own.encode_column(r.column("text").fill_null("")).to_pylist()]
    assert got == [judge.encode_ordinary(t or "") for t in texts]
    for ids, text in zip(got, texts):
        assert own.decode(np.array(ids, np.int64))[0] == (text or "").encode()


def test_prefixes_of_a_long_piece():
    own = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for size in (63, 64, 65, 2000):
        data = ("abcde" * size)[:size]
        ids = np.frombuffer(own.piece(data), "<u4").tolist()
        assert ids == own.merged(data.encode()) and own.decode(own.piece(data)) == data.encode()


def test_byte_bpe_of_nothing_and_other_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)],
                                 "doc_id long, text string, n_tokens string")
    found = bpe.digests(docs, path, public_tokenizers.PATTERN, ["doc_id"]).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id is None, r.n_tokens, r.decoded_sha256) for r in found) == sorted(
        [(False, 2, hashlib.sha256(b"a b").hexdigest())] * 2 + [(True, 0, none)])
    assert bpe.digests(docs.filter("false"), path, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
    rows = bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path,
                                public_tokenizers.PATTERN).collect()
    assert sorted((bytes(r.decoded), r._row.n_tokens or "") for r in rows) == [(b"", ""), (b"a b", "x"), (b"a b", "x")]


def test_token_files_of_nothing_and_of_one_hot_id(spark):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "tokens")
    docs = spark.createDataFrame([(7, f"text {n % 50}", "x") for n in range(300)], "doc_id long, text string, ids string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, over several files
    token_files.write_tokens(docs.repartition(4), folder, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = token_files.read_tokens(spark, folder)
    rows = sorted(found.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()
    assert found.select("ids").distinct().count() == 50
    assert spark.read.orc(folder).select("part").distinct().count() > 1  # one id over several files
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs.filter("false"), folder, path)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_licences_of_nothing_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "x")], "doc_id long, text string, score string")
    found = licences.scan(docs, licences.template_table(spark)).collect()
    assert [(r._row.score, r.licence) for r in found] == [("x", "MIT line")]
    assert licences.scan(docs.filter("false"), licences.template_table(spark)).count() == 0


def test_overlap_with_repeated_rows(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old river bank"
    texts = [(n % 3, f"{passage} {n % 2}" if n % 4 else "nothing here") for n in range(40)] + [(None, passage)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    windows = brute.item_windows([("i", passage)])
    wanted = sorted(repr((k, *brute.overlap(t, windows)[:3])) for k, t in texts)
    found = decontamination.overlap(docs, items).collect()
    assert sorted(repr((r._row.doc_id, r.n_words, r.n_hit, r.n_items)) for r in found) == wanted


# ---- models, by plain versions

def test_quality_score_is_the_softmax_of_the_mean(spark):
    """Vectors averaged over all words, pairs and character n-grams, then a softmax layer."""
    rng = np.random.default_rng(4)
    good = ["Grüße und viele Worte " + " ".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30)]
    bad = ["buy!! $$$ now!! " + " ".join(rng.choice(list("stuvwxyz"), 6)) for _ in range(30)]
    labels = np.array([1] * 30 + [0] * 30)
    rows = []
    for text in good + bad:
        at, n = quality_model._counted(text)
        rows.append((at, n / n.sum()))
    vectors, layer, bias = quality_model.sgd(rows, labels)
    model = quality_model.Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

    def buckets(text):
        """Plainly, one feature at a time."""
        factor = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1]
        words = [zlib.crc32(w) for w in text.encode().split()]
        pairs = [((b - a) % 2 ** 32) ^ factor[3] for a, b in zip(words, words[1:])]
        for crc in words + pairs:
            yield (crc * factor[0] % 2 ** 32) >> (32 - quality_model.BITS)
        for size in quality_model.GRAMS:
            for start in range(len(text) - size + 1):
                mixed = 0
                for k in range(size):
                    mixed = (mixed * factor[4] + (ord(text[start + k]) + 1) * factor[k]) % 2 ** 32
                yield ((mixed ^ mixed >> 15) * factor[1] % 2 ** 32) >> (32 - quality_model.BITS)

    for text in ["Grüße", "buy now", "", "viele Worte $$$ 日本", good[0], bad[0]]:
        found = list(buckets(text))
        hidden = np.mean([vectors[b] for b in found], axis=0) if found else np.zeros(quality_model.DIM)
        out = hidden @ layer + bias
        share = np.exp(out - out.max())
        assert model.score(text) == pytest.approx(float((share / share.sum())[1]), abs=1e-4)
    assert all(model.score(t) > 0.5 for t in good) and all(model.score(t) < 0.5 for t in bad)


def test_language_decision_by_all_duels(spark):
    """The winner of most duels within the winning family, one pair at a time."""
    rng = np.random.default_rng(5)
    alphabets = {"de": "abcdeü", "en": "efghij", "nl": "ijklmn", "fr": "opqrsé", "es": "stuvwñ", "xx": "yzab"}
    texts, names = [], []
    for name, letters in alphabets.items():
        for _ in range(20):
            texts.append(" ".join("".join(rng.choice(list(letters), 5)) for _ in range(8)))
            names.append(name)
    x = np.stack([language.vector(t) for t in texts])
    model = language.Model.fit(x, np.array(names, dtype=object))

    def duels(group, v):
        wins, least = {n: 0 for n in group.names}, {n: np.inf for n in group.names}
        margin = {n: 0.0 for n in group.names}
        k = 0
        for i, a in enumerate(group.names):
            for b in group.names[i + 1:]:
                m = float(v @ group.weights[:, k] + group.biases[k])
                k += 1
                for name, own in ((a, m), (b, -m)):
                    wins[name] += own > 0
                    least[name] = min(least[name], own)
                    margin[name] += own
        best = max(group.names, key=lambda n: (wins[n], margin[n]))
        return best, 1 / (1 + np.exp(-np.clip(2 * least[best], -30, 30)))

    asked = texts[::7] + ["abc", "ü", "½ ² ①", "Ⅷ", "12 !", "", None, "é"]
    found, scores = model.predict(asked)
    for text, name, score in zip(asked, found, scores):
        letters = [c for c in text or "" if unicodedata.category(c)[0] == "L"]
        if not letters:
            assert (name, score) == ("und", 0.0)
            continue
        family, sure = duels(model.families, language.vector(text))
        wanted, closer = duels(model.within[family], language.vector(text))
        assert name == wanted and score == pytest.approx(sure * closer, rel=1e-4)
    right = [a == b for a, b in zip(model.predict(texts)[0], names)]
    assert np.mean(right) > 0.95


def test_held_out_quality_and_language(spark):
    """Bounds on rows that weren't learned from, on the smallest given tables."""
    from pathlib import Path

    from wardspark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) >= 0.95 and len(rows) > 20
    rows = [r for r in QUERIES["op10_language_id"](spark, sf).collect() if r.held_out and docs[r.doc_id]]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in rows]) >= 0.95 and len(rows) > 200


def test_models_keep_other_columns(spark):
    rows = [(n, "der hund und die katze" if n % 2 else "the dog and the cat", "de" if n % 2 else "en", n % 2, "x", "y")
            for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, score string, "
                                       "lang_pred string")
    found = language.identify(docs, language.train(docs))
    assert {(r._row.score, r._row.lang_pred, r.lang_pred) for r in found.collect()} == {("x", "y", "de"), ("x", "y", "en")}
    scored = quality_model.score(docs, quality_model.train(docs, "quality"))
    assert {r._row.score for r in scored.collect()} == {"x"}
    assert language.identify(docs.filter("false"), language.train(docs.filter("false"))).count() == 0
    assert quality_model.score(docs.filter("false"), quality_model.train(docs, "quality")).count() == 0


@pytest.mark.parametrize("copies", [3, 100])
def test_scores_of_rows_repeated_very_often(spark, monkeypatch, copies):
    """A third of the rows are one row: it is dealt once, counts as often as it comes, and is scored as often."""
    monkeypatch.setattr(ppm, "COPIES", copies)
    rows = [(7, "the same row", True)] * 150 + [(8, "another one", False)] * 120 + [(8, "another one", True)] * 5
    rows += [(n, f"text {n % 40} of many", n % 3 > 0) for n in range(200)] + [(None, None, True)] * 101
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(5)
    found = ppm.score(docs, ["doc_id"], "train", block_bytes=500).collect()
    model = brute.Ppm([t for _, t, own in rows if own])
    wanted = sorted([(k, *b, model.score(t)) for (k, t, _), b in zip(
        rows, brute.base([t for _, t, _ in rows], [own for _, _, own in rows]))], key=repr)
    got = sorted([(r._key.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found], key=repr)
    assert [r[:4] for r in got] == [r[:4] for r in wanted]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in wanted])
    # no block holds the copies
    assert len(rows) == len(got)


@pytest.mark.parametrize("size", [1, 100, 1 << 16])
def test_short_pieces_are_coded_side_by_side(monkeypatch, size):
    import random
    import tiktoken
    own = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    judge = tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks,
                              special_tokens={})
    rand = random.Random(5)
    words = ["".join(rand.choices(["th", "e", "ing", "é", "日", "x", "7", "'s", ".", " "], k=k % 20)) for k in range(600)]
    monkeypatch.setattr(bpe, "PIECE_BYTES", size)
    monkeypatch.setattr(bpe, "REMEMBERED", 400)  # pairs are forgotten on the way
    # no Python call for each byte of a short piece
    monkeypatch.setattr(bpe.Vocabulary, "last_token", None)
    ids, begins, sizes = bpe.Coder(own).new(words)
    wanted = [judge.encode_ordinary(w[1:] if w[:1] == " " else " " + w) for w in words]
    assert [ids[a:a + n].tolist() for a, n in zip(begins, sizes)] == wanted
    assert np.frombuffer(own.encode(" ".join(words[:90])), "<u4").tolist() == judge.encode_ordinary(" ".join(words[:90]))


def test_byte_bpe_with_few_tokens():
    own = bpe.Vocabulary({b"a": 0, b"b": 1, b"ab": 2, b"cab": 3}, ".+")
    ids, sizes = own.pieces(["abb", "", "cab", "ba"])
    assert ids.tolist() == [2, 1, 3, 1, 0] and sizes.tolist() == [2, 0, 1, 2]
    assert [x.tolist() for x in own.pieces([])] == [[], []]
    with pytest.raises(ValueError, match="byte 99 "):
        own.pieces(["ab", "acb"])


def test_tables_of_short_rows_have_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "FEW_FILES", 4)
    made, write = {}, common.written

    def counted(df, label, parts=None):
        out = write(df, label, parts)
        made.setdefault(label, []).append(len(out.inputFiles()))
        return out

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        monkeypatch.setattr(simhash, "written", counted)
        monkeypatch.setattr(decontamination, "written", counted)
        pairs = spark.range(300).selectExpr("id * 10 AS a", "id * 10 + 1 + id % 3 AS b")
        roots = {tuple(r) for r in simhash.components(pairs).collect()}
        assert roots == {(n, k * 10) for k in range(300) for n in (k * 10, k * 10 + 1 + k % 3)}
        items = spark.createDataFrame([(k, " ".join(f"w{k}x{n}" for n in range(12))) for k in range(40)], "item_id long, text string")
        docs = spark.createDataFrame([(k, " ".join(f"w{k}x{n}" for n in range(k % 14))) for k in range(40)], "doc_id long, text string")
        hits = {r._row.doc_id: r.n_hit for r in decontamination.overlap(docs, items).collect()}
        assert hits == {k: min(k % 14, 12) if k % 14 > 9 else 0 for k in range(40)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = max(4, spark.sparkContext.defaultParallelism)
    assert set(made) >= {"edges", "roots", "vocabulary", "keys", "key-terms", "wanted", "lists"}
    assert max(max(n) for n in made.values()) <= most

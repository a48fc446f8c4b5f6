"""Operators against plain versions on a small awkward table."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from wardspark.llm import (bpe, chat_format, columns, decontamination, language, licences, ppm,
                           quality_model, quality_rules, simhash, token_files)
from wardspark.session import scratch_path

PASSAGE = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
PROSE = " ".join(f"word{i % 17} and{i % 5} then{i * 7 % 23}" for i in range(60))
TEXTS = [
    (1, "Some words. " + PASSAGE.upper() + "!"), (2, PROSE), (3, PROSE), (3, PROSE), (4, PROSE + " x"),
    (5, None), (6, ""), (None, "no id here"), (None, None), (7, "  spaced \n\n out\t\ttext \n "),
    (8, "Ünïcode É mañana 日本語 текст 😀 don't I'll 123 4567"), (9, "same line\nsame line\nsame line"),
    (10, "fox " * 400), (11, "a" * 3000), (12, "x\ny  z   " * 50), (13, "One two"),
    (14, "intro\nReleased under the MIT License.\nend"), (15, "!!! ### $$$"),
]
ITEMS = [(100, PASSAGE), (101, "one TWO"), (102, PASSAGE), (103, ""), (None, "intro released under"),
         (104, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", n, "clash") for n, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, "
                                       "fp string").repartition(3)


def empty(docs):
    return docs.filter("false")


def by_row(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_quality_rules(docs):
    found = quality_rules.apply_policy(quality_rules.ledger(docs), 1).collect()
    got = sorted([(r._row.doc_id, *[r[m] for m in quality_rules.MEASURES[:5]], not r.kept)
                  for r in found], key=repr)
    assert got == sorted([(k, *brute.rules(t)) for k, t in TEXTS], key=repr)
    assert quality_rules.ledger(empty(docs)).count() == 0


def test_ablations_count_what_a_rule_alone_drops(docs):
    entries = quality_rules.ledger(docs)
    bits = [r.failed & quality_rules.mask(quality_rules.BASE) for r in entries.collect()]
    got = {r.rule: (r.failing, r.only_this) for r in quality_rules.ablations(entries, 1).collect()}
    assert got == {n: (sum(b & 1 << i > 0 for b in bits), sum(b == 1 << i for b in bits))
                   for i, n in enumerate(quality_rules.BASE)}


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.overlap(docs, items).collect()
    windows = brute.item_windows(ITEMS)
    got = sorted([(r._row.doc_id, r.n_words, r.n_hit, r.n_items,
                   hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found], key=repr)
    assert got == sorted([(k, *brute.overlap(t, windows)) for k, t in TEXTS], key=repr)
    assert decontamination.overlap(docs, items.filter("false")).agg(F.sum("n_hit")).head()[0] == 0
    assert decontamination.overlap(empty(docs), items).count() == 0


@pytest.mark.parametrize("span", [1, 3, 7])
def test_near_matches(spark, span):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("aabbbcdefgh"), 40)) for _ in range(30)] + [None, "", "H, g!"]
    phrases = [("one", "A b c"), ("two", "g H"), ("twice", "d d e"), ("none", "a zzz"), ("void", "!"),
               ("alone", "f")]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontamination.near_matches(
        table, spark.createDataFrame(phrases, "phrase string, text string"), span)
    keys = table.select("doc_id", *decontamination.row_key(F.col("doc_id"), F.col("text")))
    got = found.join(keys, decontamination.KEY).collect()
    assert by_row(got, "doc_id", "phrase", "pos") == sorted(brute.near(texts, phrases, span), key=repr)


@pytest.mark.parametrize("bucket_rows", [1, 20_000])
def test_simhash(spark, bucket_rows):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 4)
    prints = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
              for c in centre for _ in range(40)]
    table = spark.createDataFrame([(simhash._signed(p),) for p in set(prints)], "fp long")
    roots = dict(simhash.components(simhash.links(table, 3, bucket_rows)).collect())
    wanted = brute.linked([(simhash._signed(p), p) for p in sorted(set(prints))])
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in sorted(set(prints))]
    assert got == wanted


def test_every_close_pair_shares_a_table():
    rng = np.random.default_rng(5)
    tables = simhash.masks()
    for _ in range(3000):
        change = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not change & mask for mask in tables)


def test_near_duplicates(docs):
    found = simhash.near_duplicates(docs).collect()
    prints = [(k, brute.simhash(t)) for k, t in TEXTS]
    wanted = [(k, simhash._signed(p), c) for (k, p), c in zip(prints, brute.linked(prints))]
    assert by_row(found, "doc_id", "fp", "component_id") == sorted(wanted, key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute.linked(prints)))
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_byte_bpe(docs):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.vocabulary(path, public_tokenizers.PATTERN)
    judge = tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks,
                              special_tokens={})
    found = bpe.digests(docs, path, public_tokenizers.PATTERN, ["doc_id"], with_ids=True).collect()
    assert by_row(found, "doc_id", "ids") == sorted(
        [(k, judge.encode_ordinary(t or "")) for k, t in TEXTS], key=repr)
    assert all(r.decoded_sha256 == hashlib.sha256(own.decode(np.array(r.ids, "<u4").tobytes()))
               .hexdigest() for r in found)


def test_appending_and_editing_prefixes():
    own = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = b"unbelievable" * 60
    grown = bpe.Prefixes(own, text[:100])
    grown.append(text[100:])
    assert grown.ids() == bpe.Prefixes(own, text).ids()
    anew = grown.edit(20, 25, b"xyz")
    assert grown.ids() == bpe.Prefixes(own, text[:20] + b"xyz" + text[25:]).ids()
    assert anew < len(text) // 2


def test_token_files(spark, docs):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    judge = Tokenizer.from_file(path)
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, folder, path)
    rows = token_files.checksums(token_files.read_tokens(spark, folder)).collect()
    wanted = {}
    for key, text in TEXTS:
        ids = [*judge.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    # rows of one id come one after the other, by a hash of their texts
    start = 0
    for row in sorted(rows, key=lambda r: r.start):
        assert row.start == start and (row.n_tokens, row.ids_crc32) in wanted[row.doc_id]
        wanted[row.doc_id].remove((row.n_tokens, row.ids_crc32))
        start += row.n_tokens
    assert not any(wanted.values())
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    assert token_files.lookup(spark, folder, [8]).count() == 1


def test_ppm(docs):
    table = docs.withColumn("train", F.col("doc_id") % 3 != 0)
    found = ppm.score(table, ["doc_id"], "train", block_bytes=2000).collect()
    train = [k is not None and k % 3 != 0 for k, _ in TEXTS]
    model = brute.Ppm([t for (_, t), own in zip(TEXTS, train) if own])
    wanted = sorted([(k, *b, model.score(t)) for (k, t), b in zip(
        TEXTS, brute.base([t for _, t in TEXTS], train))], key=repr)
    got = sorted([(r._key.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found],
                 key=repr)
    assert [r[:4] for r in got] == [r[:4] for r in wanted]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in wanted])


def test_chances_of_all_bytes_add_up():
    model = brute.Ppm(["banana bandana", "can"])
    for context in (b"\xfe\xfe\xfe\xfe", b"bana", b"zzza", b"zzzz"):
        assert sum(model.chance(context, s) for s in range(256)) == pytest.approx(1)


def test_chat_format(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user\nno<|end|>\n", "a\\b <\\ [n \\", None, "plain"]
    rows = [(c, n, "assistant" if n % 2 else "ro\nle[n<", t) for c in (1, 2, None)
            for n, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = chat_format.parse(chat_format.format_conversations(turns.select(
        "conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("content")))).collect()
    assert len(parsed) == 3
    for row in parsed:
        assert [(t.role, t.text) for t in row.turns] == [
            ("assistant" if n % 2 else "ro\nle[n<", t or "") for n, t in enumerate(texts)]
        assert row.learned_text == "".join(t or "" for t in texts[1::2])
        assert "</s>" not in row.formatted and "[INST]" not in row.formatted


def test_attachments_become_placeholders(spark):
    turns = spark.sql(f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, from_json('[
      {{"type": "text", "text": "see"}}, {{"type": "image", "ref": "a.png", "width": 56, "height": 29}},
      {{"type": "audio", "ref": "b.wav", "seconds": 0.1}}, {{"type": "document", "ref": "c.pdf"}}]',
      'array<{chat_format.PART}>') AS content""")
    row = chat_format.format_conversations(turns).head()
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [
        ("image", "a.png", 4), ("audio", "b.wav", 3), ("document", "c.pdf", 1)]
    assert row.formatted.count("<|image|>") == 4 and row.formatted.count("<|audio|>") == 3


def test_licences(spark, docs):
    found = licences.scan(docs, licences.template_table(spark)).collect()
    assert [(r._row.doc_id, r.licence, r.unit, r.score) for r in found if r.licence] == [
        (14, "MIT line", 1, 1.0)]
    assert len(found) == len(TEXTS)


def licence_rows(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licences.scan(table, licences.template_table(spark)).collect()
    return [(r.licence, r.unit, r.score, r.licences) for r in sorted(found, key=lambda r: r._row.doc_id)]


def test_licences_wrapped_inside_lines_and_in_full(spark):
    mit, gpl = licences.TEMPLATES["MIT text"], licences.TEMPLATES["GPL-3.0 header"]
    inline = "Our new guide is out. Released under the MIT License. Contact us for more."
    got = licence_rows(spark, [
        "MIT License\n\nCopyright (c) 2026\n\n" + mit, inline, f"{PROSE}\n" + "\n".join(
            f" * {line}" for line in gpl.split("\n")) + f"\n{PROSE}",
        f"{PROSE}\n{licences.TEMPLATES['Apache-2.0 text']}\n{PROSE}",
        licences.TEMPLATES["GPL-3.0 text"]])
    # notices and headers that are part of a text tie with it
    assert [(r[0], r[1], r[2]) for r in got] == [
        ("MIT notice", -2, 1.0), ("MIT line", -2, 1.0), ("GPL-3.0 header", -2, 1.0),
        ("Apache-2.0 header", -2, 1.0), ("GPL-3.0 text", -1, 1.0)]
    assert got[0][3] == ["MIT notice", "MIT text"] and "Apache-2.0 text" in got[3][3]


def test_licences_against_scoring_every_window(spark):
    rng = np.random.default_rng(4)
    names = ["MIT line", "Apache-2.0 line", "GPL-3.0 line", "ISC notice", "MIT notice", "0BSD text",
             "GPL-2.0 header", "MPL-2.0 header"]
    templates = {n: licences.TEMPLATES[n] for n in names} | {
        "repeats": "to be or not to be or to be", "one": "word", "two": "so it"}
    texts = [None, "", "word", "so it", "x so it y", "to be or not to be " * 5, "be or to be or not"]
    for _ in range(150):
        parts = []
        for name in rng.choice(list(templates), rng.integers(1, 4)):
            words = templates[name].split()
            for _ in range(rng.integers(0, 1 + len(words) // 5)):  # words changed, lost and put in
                at, kind = rng.integers(len(words)), rng.integers(3)
                words[at:at + (kind < 2)] = [["other"], [], ["new"]][kind]
                words = words or ["none"]
            parts += [str(x) for x in words] + ["filler"] * int(rng.integers(0, 3))
        texts.append("".join(x + str(rng.choice([" ", " ", " ", "\n", " * "])) for x in parts))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[9])],
                                  "doc_id long, text string").repartition(3)
    for least in (0.8, 0.55):
        found = licences.scan(table, licences.template_table(spark, templates), least).collect()
        wanted = [brute.licences(t, templates, least) for t in texts]
        assert len(found) == len(texts) + 1
        for row in found:
            own = wanted[row._row.doc_id]
            best = min(((-s, not whole, name, unit) for name, (s, whole, unit) in own.items()),
                       default=(0, True, None, None))
            assert (row.licences, row.licence, row.unit) == (sorted(own), best[2], best[3])
            assert row.score == pytest.approx(-best[0])


def test_language(spark):
    german, english = "der hund und die katze schlafen nicht", "the dog and the cat are asleep"
    french, spanish = "le chien et le chat ne dorment pas", "el perro y el gato no duermen"
    rows = [(i, f"{t} {i}", k) for i, (t, k) in enumerate(
        [(german, "de"), (english, "en"), (french, "fr"), (spanish, "es")] * 10)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(known)
    asked = spark.createDataFrame([(1, "die katze und der hund"), (2, "the cat and dog"), (3, None),
                                   (4, "12 !"), (5, "el gato y el perro"), (6, "")],
                                  "doc_id long, text string")
    got = {r._row.doc_id: (r.lang_pred, r.score) for r in language.identify(asked, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "de", 2: "en", 3: "und", 4: "und", 5: "es", 6: "und"}
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.train(known.filter("false")).predict(["text"]) [0] == ["und"]


def test_quality_model(spark):
    rows = [(i, (PROSE if i % 2 else "spam!! buy!! now!! ") + f" {i}", i % 2) for i in range(40)]
    rows += [(90, None, None), (91, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    scored = quality_model.score(table, quality_model.train(table, "quality")).collect()
    assert all((r.score >= 0.5) == bool(r._row.quality) for r in scored if r._row.quality is not None)
    assert all(0 <= r.score <= 1 for r in scored)
    assert quality_model.train(table.filter("false"), "quality").score("x") == pytest.approx(0.5)


def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_keeps_texts_of_an_unsure_language(spark, docs, monkeypatch):
    def identified(rows, model):
        return rows.select(F.struct(*rows.columns).alias("_row"), F.lit(0.1).alias("score"),
                           F.when(F.col("doc_id") == 1, "und").otherwise("nl").alias("lang_pred"))

    monkeypatch.setattr(language, "identify", identified)
    rows = docs.filter("doc_id IN (1, 2, 3)")
    kept = corpus_pipeline.keep_known_languages(spark, rows, "")
    assert by_row(kept.collect(), "doc_id") == [(2,), (3,), (3,)]


def test_token_encoder_that_forgets(monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    judge, own = Tokenizer.from_file(path), token_files.Encoder(path)
    monkeypatch.setattr(columns, "REMEMBERED", 20)
    rng = np.random.default_rng(8)
    signs = list("ab é́.,'s \n  \t²1日<|> ") + ["<|endoftext|>", "z" * 70 + "."]
    for _ in range(60):
        texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(20)]
        assert own.encode(texts) == [
            np.array(judge.encode(x, add_special_tokens=False).ids, "<i4").tobytes() for x in texts]


def test_special_tokens_in_texts_are_the_library_s():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    judge, own = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["a b", "a <|endoftext| > b", "a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y  z", ""]
    found = [np.frombuffer(ids, "<i4").tolist() for ids in own.encode(texts)]
    assert found == [judge.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(found[2]) == 4 and 50256 in found[2]


def test_token_slices(monkeypatch):
    """Slices of a batch of a few bytes: the same ids, and offsets that go on."""
    from types import SimpleNamespace

    import pyarrow as pa
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    judge = Tokenizer.from_file(path)
    monkeypatch.setattr(columns, "SLICE_BYTES", 40)
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(
        get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    texts = [None, "", "a  b", "one two two. ", "x" * 200, "é　 z", " end", "<|endoftext|>"] * 3
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(len(part))),
                                           "text": pa.array(part, pa.string())})
               for part in (texts[:10], [], texts[10:])]
    rows = [r for b in token_files._encode(path, 0)(iter(batches)) for r in b.to_pylist()]
    wanted = [[*judge.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [r["ids"] for r in rows] == wanted
    assert [r["n_tokens"] for r in rows] == [len(ids) for ids in wanted]
    assert [r["offset"] for r in rows] == [sum(map(len, wanted[:n])) for n in range(len(wanted))]
    assert {r["part"] for r in rows} == {3}


def test_counts_of_the_language_model_are_dropped(spark):
    """Once the values are found, the tables of counts that led there take no disk."""
    from pathlib import Path

    from wardspark.llm import ppm
    from wardspark.session import shared_folder

    def tables():
        folder = Path(shared_folder(spark).removeprefix("file:"))
        return {p.name for label in ("counts", "grams", "found") for p in folder.glob(f"{label}-*")}

    before = tables()
    docs = spark.createDataFrame([(n, f"some words {n}", n % 2 == 0) for n in range(20)], "doc_id long, text string, train boolean")
    assert ppm.score(docs, ["doc_id"], "train").filter("score < 0").count() == 20
    assert {name.split("-")[0] for name in tables() - before} == {"found"}

"""Language-model scoring by prediction by partial matching over bytes.

A trie of contexts of up to ``ORDER`` bytes counts what followed them in the training texts. A byte
is coded in its longest known context; if it never followed that context, an escape (method D: half
a count per distinct successor) leads to the next shorter one, where the successors already
ruled out are excluded; below the empty context every byte value is as likely. The code length
of a byte depends on the ``ORDER`` bytes before it alone, so it is computed once for each distinct
gram of ``ORDER + 1`` bytes.

Texts are dealt into blocks of bounded size. A block gives its distinct grams and tokens with
their counts; these are summed over the corpus, the code lengths computed by branches of the
trie, and each block gets back the lengths of its own grams only. Nothing of the corpus is sent
whole to the driver or to a task: a branch, all contexts that end in the same two bytes, has fewer
than 256 ** 3 grams, and only the 65,536 counts of byte pairs are shared with all tasks. A common gram
or token appears once per block.

A text is padded with 0xFE in front and ends with 0xFF, bytes that UTF-8 never uses; the end is
coded too. A null text is empty and consists of its end. Without training rows every byte costs log
256, and a token of the base model log 2 (N = V = 0). Repeated rows get equal scores; there are no ties to
break. Rows that are equal in keys and text very often are dealt once, count as often as they come, and get their score
back by a join, so no block holds the copies. A text longer than a block is a block of its own, worked through in slices. An empty table gives an empty
result. Other columns are not looked at, and keys may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardspark.llm.common import KEY, small, written
from wardspark.session import scratch_path, scratch_tables

ORDER = 4
PAD, END = 0xFE, 0xFF
END_TOKEN = b" "  # no word holds a space
BLOCK_BYTES = 8 << 20
SLICE = 1 << 20  # grams handled at once, and bytes of texts
COPIES = 100  # rows that are equal in key and text more often than this are dealt once


def _buffer(texts: list[bytes]) -> np.ndarray:
    pad, end = bytes([PAD]) * ORDER, bytes([END])
    return np.frombuffer(b"".join([pad + t + end for t in texts]), np.uint8)


def _chunks(texts: list[bytes]):
    """Consecutive texts of about ``SLICE`` bytes; a longer text alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _grams(buffer: np.ndarray):
    """Slices of (start, grams); a gram that ends in padding is -1."""
    size = len(buffer) - ORDER
    for at in range(0, max(size, 0), SLICE):
        part = buffer[at:min(at + SLICE, size) + ORDER].astype(np.int64)
        gram = part[:len(part) - ORDER]
        for k in range(1, ORDER + 1):
            gram = (gram << 8) | part[k:len(part) - ORDER + k]
        gram[part[ORDER:] == PAD] = -1
        yield at, gram


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for chunk in _chunks(texts):
        for _, gram in _grams(_buffer(chunk)):
            found, n = np.unique(gram, return_counts=True)
            keys.append(found[found >= 0])
            counts.append(n[found >= 0])
    return _summed(keys, counts)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the (lower-cased) texts, and the number of words of each."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    owner = pc.list_parent_indices(lists).filter(real).to_numpy()
    return words.filter(real), np.bincount(owner, minlength=len(texts))


def _lowered(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return pc.ascii_lower(pc.fill_null(column, ""))


def _count_block(table: pa.Table) -> pa.Table:
    """``block, token, gram, n`` of one block: training counts of each distinct token and gram
    in it, 0 for those that only other rows hold."""
    texts = _lowered(table)
    # how often a row counts: its copies, or not at all
    weights = table.column("weight").to_numpy()
    words, sizes = _words(texts)
    coded = words.dictionary_encode()
    n_words = np.bincount(coded.indices.to_numpy(), np.repeat(weights, sizes), len(coded.dictionary))
    raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    raw = raw.to_pylist()
    parts = [(w, _gram_counts([t for t, own in zip(raw, weights) if own == w])) for w in np.unique(weights)]
    grams, n_grams = _summed([keys for _, (keys, _) in parts], [w * counts for w, (_, counts) in parts])
    tokens = coded.dictionary.cast(pa.binary()).to_pylist() + [END_TOKEN]
    total = len(tokens) + len(grams)
    n = np.concatenate((n_words, [int(weights.sum())], n_grams)).astype(np.int64)
    gram_column = np.concatenate((np.full(len(tokens), -1, np.int64), grams))
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(total, block, np.int64)),
                     "token": pa.array(tokens + [None] * len(grams), pa.binary()),
                     "gram": pa.array(gram_column), "n": pa.array(n)})


def _branch(pairs: np.ndarray):
    """Code lengths of the grams of one branch. ``pairs[a, b]`` counts byte b after byte a."""
    single = pairs.sum(axis=0)

    def run(table: pa.Table) -> pa.Table:
        gram = table.column("gram").to_numpy()
        n = table.column("n").to_numpy()
        symbol = gram & 255
        previous = int((gram[0] >> 8) & 255)
        # per level, from the longest context down: context and count of each (context, symbol)
        contexts = [(gram >> 8) & ((1 << (8 * k)) - 1) for k in range(ORDER, 1, -1)]
        own = []
        for context in contexts:
            key = (context << 8) | symbol
            found, at = np.unique(key, return_inverse=True)
            own.append(np.bincount(at, n, len(found))[at])
        contexts += [np.full(len(gram), previous, np.int64), np.zeros(len(gram), np.int64)]
        own += [pairs[previous][symbol].astype(float), single[symbol].astype(float)]
        out = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        excluded_mass = np.zeros(len(gram))
        excluded = np.zeros(len(gram))
        for level in range(ORDER + 1):
            context, count = contexts[level], own[level]
            below = own[level + 1] if level < ORDER else np.zeros(len(gram))
            if level <= ORDER - 2:
                # one row per (context, symbol) that has been seen
                key = (context << 8) | symbol
                _, first = np.unique(key, return_index=True)
                first = first[count[first] > 0]
                _, at = np.unique(context, return_inverse=True)
                size = int(at.max()) + 1
                mass = np.bincount(at[first], count[first], size)[at]
                distinct = np.bincount(at[first], minlength=size)[at].astype(float)
                next_mass = np.bincount(at[first], below[first], size)[at]
            else:
                row = pairs[previous] if level == ORDER - 1 else single
                mass = np.full(len(gram), float(row.sum()))
                distinct = np.full(len(gram), float((row > 0).sum()))
                next_mass = np.full(len(gram), float(single[row > 0].sum()))
            left, kinds = mass - excluded_mass, distinct - excluded
            hit = open_ & (count > 0)
            out[hit] += np.log10((count[hit] - 0.5) / left[hit])
            open_ &= ~hit
            escape = open_ & (left > 0)
            out[escape] += np.log10(kinds[escape] / (2 * left[escape]))
            excluded_mass, excluded = next_mass, distinct
        out[open_] -= np.log10(256 - excluded[open_])
        return pa.table({"gram": table.column("gram"), "value": pa.array(out)})
    return run


class Lengths:
    """Looks up the value of the gram that ends at each place of a buffer.

    ``grams`` are sorted and hold every gram of the buffers.
    """

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.grams, self.values = grams, values

    def of(self, buffer: np.ndarray) -> np.ndarray:
        """One value per place from ``ORDER`` on, 0 where that is padding."""
        out = np.zeros(max(len(buffer) - ORDER, 0))
        for at, gram in _grams(buffer):
            real = gram >= 0
            out[at:at + len(gram)][real] = self.values[np.searchsorted(self.grams, gram[real])]
        return out


def _base(texts: pa.Array, tokens: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of words, the sum of log10(c + 0.5) over its tokens, and how many are known."""
    words, sizes = _words(texts)
    coded = words.dictionary_encode()
    known = tokens.column("token").combine_chunks()
    value = tokens.column("value").to_numpy()
    place = pc.index_in(coded.dictionary.cast(pa.binary()), value_set=known).to_numpy(
        zero_copy_only=False).astype(np.int64)
    seen = value[place][coded.indices.to_numpy()] if len(words) else np.zeros(0)
    end = float(value[pc.index(known, pa.scalar(END_TOKEN, pa.binary())).as_py()])
    owner = np.repeat(np.arange(len(texts)), sizes)
    logs = np.bincount(owner, np.log10(seen + 0.5), len(texts)) + math.log10(end + 0.5)
    return sizes, logs, np.bincount(owner, seen > 0, len(texts)) + (end > 0)


def _score_block():
    """``_key, n_tokens, n_known, token_log, score`` of the rows of a block."""
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: docs.column(c) for c in ("_key", *KEY)} | {
                "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()),
                "token_log": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        texts = _lowered(docs)
        is_token = pc.is_valid(found.column("token"))
        sizes, logs, n_known = _base(texts, found.filter(is_token))
        grams = found.filter(pc.invert(is_token)).select(["gram", "value"]).sort_by("gram")
        lengths = Lengths(grams.column("gram").to_numpy(), grams.column("value").to_numpy())
        raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
        raw = raw.to_pylist()
        scores = []
        for chunk in _chunks(raw):
            # a text's first gram ends ORDER places after its padding starts
            starts = np.cumsum([0] + [len(t) + ORDER + 1 for t in chunk[:-1]])
            scores.append(np.add.reduceat(lengths.of(_buffer(chunk)), starts))
        scores = np.concatenate(scores)
        return pa.table({c: docs.column(c) for c in ("_key", *KEY)} | {
            "n_tokens": pa.array((sizes + 1).astype(np.int64)),
            "n_known": pa.array(n_known.astype(np.int64)),
            "token_log": pa.array(logs), "score": pa.array(scores)})
    return run


_FOUND = "block long, token binary, gram long, value double, first boolean"


def _write_found(dealt: DataFrame, path: str) -> None:
    """Writes the counts of the tokens and the code lengths of the grams of each block."""
    counted = written(dealt.select("block", "text", "weight").groupBy("block").applyInArrow(
        _count_block, "block long, token binary, gram long, n long"), "counts")

    # tokens: a token has one row per block at most
    of_token = Window.partitionBy("token")
    tokens = counted.filter("token IS NOT NULL").select(
        "block", "token", F.sum("n").over(of_token).alias("value"),
        (F.min("block").over(of_token) == F.col("block")).alias("first"))

    # grams: code lengths by branch
    grams = counted.filter("token IS NULL")
    sums = written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    pairs = np.zeros((256, 256), np.int64)
    by_pair = sums.groupBy(F.expr("gram & 65535").alias("pair")).agg(F.sum("n").alias("n"))
    for pair, n in by_pair.collect():  # 65,536 rows at most
        pairs[pair >> 8, pair & 255] = n
    lengths = sums.withColumn("branch", F.expr("shiftright(gram, 8) & 65535")).groupBy(
        "branch").applyInArrow(_branch(pairs), "gram long, value double")
    of_grams = grams.select("block", "gram").join(lengths, "gram").select(
        "block", F.lit(None).cast("binary").alias("token"), "gram", "value",
        F.lit(False).alias("first"))

    tokens.select("block", "token", F.lit(-1).cast("long").alias("gram"), F.col("value").cast("double"),
                  "first").union(of_grams).write.parquet(path)


def score(docs: DataFrame, keys: list[str], train: str,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_key`` (a struct of the keys), ``n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    ``docs`` has the keys, whatever their names, ``text`` and the boolean ``train``; a null there is false. ``score`` is
    the log10 probability of the whole text, ``base_score`` that of its tokens one by one.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = total // block_bytes + 1
    weight = F.coalesce((F.col(train) if isinstance(train, str) else train).cast("long"), F.lit(0))
    whole = [x for c in [*map(F.col, keys), F.col("text")] for x in (c.isNull(), c)] + [weight]
    rows = docs.select(*[F.xxhash64(F.lit(n), *whole).alias(k) for n, k in enumerate(KEY)],
                       F.struct(*keys).alias("_key"), "text", weight.alias("weight"))
    # rows repeated very often, as a whole, are dealt once and count as often as they come
    often = written(rows.groupBy(*KEY).agg(F.count("*").alias("copies")).filter(F.col("copies") > COPIES), "often")
    some = often.limit(1).count() > 0
    block = F.pmod(F.xxhash64(*KEY), F.lit(blocks)).alias("block")
    dealt = rows.select(block, *KEY, "_key", "text", "weight")
    if some:
        once = rows.join(small(often), KEY).dropDuplicates(KEY).withColumn("weight", F.col("weight") * F.col("copies"))
        dealt = rows.join(small(often.select(*KEY)), KEY, "left_anti").unionByName(once.drop("copies")).select(
            block, *KEY, "_key", "text", "weight")
    path = scratch_path(docs.sparkSession, "found")
    with scratch_tables(docs.sparkSession):  # counts aren't needed once the values are found
        _write_found(dealt, path)
    found = docs.sparkSession.read.schema(_FOUND).parquet(path)
    n, v = found.filter("first AND value > 0").agg(
        F.sum("value").cast("long"), F.count("*")).head()
    n = n or 0
    schema = dealt.select("_key", *KEY).schema.add("n_tokens", "long").add("n_known", "long")
    schema = schema.add("token_log", "double").add("score", "double")
    scored = dealt.select("block", *KEY, "_key", "text").groupBy("block").cogroup(
        found.select("block", "token", "gram", "value").groupBy("block")).applyInArrow(
        _score_block(), schema)
    if some:
        scored = written(scored, "scored")
        own = scored.join(small(often.select(*KEY)), KEY, "left_semi").drop("_key")
        copies = rows.select("_key", *KEY).join(small(written(own, "scored-once")), KEY)
        scored = scored.join(small(often.select(*KEY)), KEY, "left_anti").unionByName(copies)
    each = math.log10(n + 0.5 * (v + 1))
    return scored.select(
        "_key", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("token_log") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")

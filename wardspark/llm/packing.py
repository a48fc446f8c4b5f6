"""Packing of tokenized documents into sequences of a fixed length by exact complements.

A document's ids and an end id make one piece, or several if it is longer than a sequence. How to
combine pieces depends on their lengths alone, of which there are no more than a sequence has tokens; so
only the counts by length (``LENGTH`` rows at most) go to the driver, which makes a plan of patterns: the lengths in a
sequence, and how many sequences are filled alike. The pieces are then numbered within their length, and a
piece's number tells its pattern, its sequence and its place.

The plan fills the longest lengths first. A gap is closed exactly by a single length, a pair or a triple, of
as many sequences at once as the counts allow; the sums of available pairs are kept as the bits of an integer.
Where no combination fits, the gap takes the longest length that fits in (best fit) and is tried again; it is
left open only when every remaining piece is longer. Each step uses up a length or
a group of like sequences, so the plan grows with the lengths and not with the documents.

Words are found, and told apart, by Arrow; the tokenizer library sees each new word once. This holds for a tokenizer
that drops white space and marks the ends of words. Texts with an added token (``<|``) go to the library whole.

A null text is empty: one piece, the end id. A text of any length is cut into pieces. Equal rows are packed as often
as they come; of combinations that tie the one with the longest piece is taken. An empty table gives an empty result.
Columns beside ``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.columns import LONG, runs, slices
from wardspark.llm.common import BROADCAST_ROWS, written

LENGTH = 4096
# Words that a task remembers at most; then it forgets all and goes on.
REMEMBERED = 200_000
# Texts of about so many bytes are encoded at once.
SLICE_BYTES = 4 << 20
# New words are given to the library in lines of so many.
LINE = 200
PIECE = "piece int, start long, length int, ids_crc32 long"

_CODERS: dict[str, "WordCoder"] = {}


class WordCoder:
    """A tokenizer that drops white space, and the ids of short words that came more than once among texts at
    hand."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core; threads of the library would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        # an added token is found before anything else and cuts a line between two words
        self.cut, self.cut_id = added[0]["content"], added[0]["id"]
        self.mark = os.path.commonprefix([token["content"] for token in added])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and how many each has."""
        lines = [self.cut.join(words[i:i + LINE]) + self.cut for i in range(0, len(words), LINE)]
        found = [np.array(x, np.int32) for n in range(0, len(lines), LINE) for x in self._library(lines[n:n + LINE])]
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        cuts = np.flatnonzero(ids == self.cut_id)
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1).astype(np.int32) - 1

    def _remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        words, sizes = words[:REMEMBERED], sizes[:REMEMBERED]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids = np.concatenate((self.ids, ids[:sizes.sum()]))
        self.sizes = np.concatenate((self.sizes, sizes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has."""
        odd = pc.match_substring(texts, self.mark)
        plain = texts.filter(pc.invert(odd))
        # case is dropped by the tokenizer anyway, and a stop or comma behind a letter is a word of its own
        lowered = pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z])([.,])", r"\1 \2")
        lists = pc.ascii_split_whitespace(lowered)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        get = self.known.get
        place = np.fromiter((get(word, -1) for word in words), np.int64, len(words))
        fresh = np.flatnonzero(place < 0)
        new = [words[n] for n in fresh.tolist()]
        new_ids, new_sizes = self._new(new)
        place[fresh] = len(self.sizes) + np.arange(len(fresh))
        pool, word_sizes = np.concatenate((self.ids, new_ids)), np.concatenate((self.sizes, new_sizes))
        begins = np.cumsum(word_sizes, dtype=np.int64) - word_sizes
        place = place[codes]
        sizes = word_sizes[place]
        bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[lists.offsets.to_numpy()]
        ids = pool[runs(begins[place], sizes)]
        often = np.bincount(codes, minlength=len(words))[fresh] > 1
        often &= np.fromiter((len(word) <= LONG for word in new), bool, len(new))
        self._remember([new[n] for n in np.flatnonzero(often).tolist()], new_ids[np.repeat(often, new_sizes)],
                       new_sizes[often])
        if len(plain) == len(texts):
            return ids, np.diff(bounds)
        odd = odd.to_numpy(zero_copy_only=False)
        parts = iter(np.split(ids, bounds[1:-1]) if len(plain) else [])
        others = iter(self._library(texts.filter(pa.array(odd)).to_pylist()))
        found = [np.array(next(others), np.int32) if o else next(parts) for o in odd]
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)


def _coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def _cut(tokenizer: str, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _coder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            for rows in slices(batch, SLICE_BYTES):
                ids, sizes = coder.encode(rows.column("text").fill_null(""))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id).astype("<u4", copy=False)
                sizes = sizes + 1
                pieces = -(-sizes // length)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                number = runs(np.zeros(len(sizes), np.int64), pieces)
                start = number * length
                own = np.minimum(length, sizes[owner] - start)
                begin = (np.cumsum(sizes) - sizes)[owner] + start
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + own).tolist())]
                # the number of each piece among those of its length in this partition
                order = np.argsort(own, kind="stable")
                counts = np.bincount(own, minlength=length + 1)
                rank = np.empty(len(own), np.int64)
                rank[order] = runs(seen, counts)
                seen += counts
                columns = {
                    "doc_id": rows.column("doc_id").take(pa.array(owner)),
                    "piece": pa.array(number.astype(np.int32)), "start": pa.array(start),
                    "length": pa.array(own.astype(np.int32)), "ids_crc32": pa.array(sums, pa.int64()),
                    "part": pa.array(np.full(len(own), part, np.int32)), "rank": pa.array(rank)}
                if with_ids:
                    bounds = np.append(begin, len(ids)).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_pydict(columns)
    return run


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH,
        with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, rank`` of the pieces of ``docs``, and their ``ids`` if asked
    for; ``rank`` counts the pieces of a length in one part. Written, as the ranks must not change."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECE}, part int, rank long" + (", ids array<int>" if with_ids else "")
    return written(docs.select("doc_id", "text").mapInArrow(
        _cut(tokenizer, end_id, length, with_ids), schema), "pieces")


class Stock:
    """How many pieces of each length are left, and which sums two or three of them have."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        self._index()

    def _index(self) -> None:
        """Bit n of ``single``: a piece of length n is left; of ``pair``: two pieces of n together."""
        left = np.flatnonzero(self.counts).tolist()
        self.single = sum(1 << n for n in left)
        self.pair = 0
        for n in left:
            # the longer partners are found from their own side
            shorter = self.single & ((1 << n) - 1 | (1 << n if self.counts[n] > 1 else 0))
            self.pair |= shorter << n
        self.stale = False

    def longest(self, at_most: int) -> int:
        return (self.single & ((1 << at_most + 1) - 1)).bit_length() - 1 if at_most > 0 else -1

    def take(self, length: int, times: int) -> None:
        self.counts[length] -= times
        left = int(self.counts[length])
        if not left:
            self.single &= ~(1 << length)
        if left < 3:  # a pair or triple of it may be gone
            self.stale = True

    def _pair(self, total: int) -> list[int] | None:
        half = total // 2
        low = max(1, total - len(self.counts) + 1)
        if low > half:
            return None
        own = np.arange(low, half + 1)
        fits = (self.counts[own] > 0) & (self.counts[total - own] > np.where(2 * own == total, 1, 0))
        at = np.flatnonzero(fits)
        return [total - int(own[at[0]]), int(own[at[0]])] if len(at) else None

    def _triple(self, total: int) -> list[int] | None:
        longest = self.longest(total - 2)
        while longest > 0 and 3 * longest >= total:
            if self.pair >> (total - longest) & 1:
                self.counts[longest] -= 1
                rest = self._pair(total - longest)
                self.counts[longest] += 1
                if rest and rest[0] <= longest:
                    return [longest, *rest]
            longest = self.longest(longest - 1)
        return None

    def filling(self, gap: int) -> list[int] | None:
        """One, two or three lengths left that fill the gap, those with the longest first."""
        if gap < len(self.counts) and self.counts[gap]:
            return [gap]
        if self.stale:
            self._index()
        if self.pair >> gap & 1:
            found = self._pair(gap)
            if found:
                return found
        return self._triple(gap)


def plan(counts: np.ndarray, length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(sequences, [(length, times), ...])``: patterns that use up ``counts`` (pieces by length)."""
    stock, patterns = Stock(counts), []
    while (first := stock.longest(length)) > 0:
        # no more sequences than could hold all pieces of this length alone; the rest may fill gaps
        many = -(-int(stock.counts[first]) // (length // first))
        stock.take(first, many)
        groups = [(many, length - first, [(first, 1)])]
        while groups:
            many, gap, held = groups.pop()
            found = stock.filling(gap) if gap else []
            if found is None and 0 < (fit := stock.longest(gap)):
                # far from full, several of the best fit at once
                times = max(1, min((gap - 3 * fit) // fit, int(stock.counts[fit]) // many))
                found = [fit] * times
            if not found:
                patterns.append((many, held))
                continue
            need = {n: found.count(n) for n in found}
            now = min([many, *[int(stock.counts[n]) // times for n, times in need.items()]])
            for n, times in need.items():
                stock.take(n, now * times)
            if now < many:
                groups.append((many - now, gap, held))
            groups.append((now, gap - sum(found), held + list(need.items())))
    return patterns


def _places(patterns, length: int) -> dict[str, np.ndarray]:
    """Per run of pieces of one length: the key of its first (``length`` and number), how many of them a sequence
    takes, the number of its first sequence and the offset there."""
    used, rows, sequence = defaultdict(int), [], 0
    for many, held in patterns:
        offset = 0
        for own, times in held:
            rows.append(((own << 48) + used[own], times, sequence, offset, own))
            used[own] += many * times
            offset += own * times
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "times", "sequence", "offset", "own"), table.T))


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (as ``cut`` gives them) with ``sequence_id`` and ``offset`` in place of ``part`` and ``rank``."""
    own = pieces.groupBy("length", "part").count()
    counts, rows = np.zeros(length + 1, np.int64), 0
    for n, many, parts in own.groupBy("length").agg(F.sum("count"), F.count("*")).collect():  # ``length`` rows at most
        counts[n] = many
        rows += parts
    runs_of = _places(plan(counts, length), length)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = own.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if rows <= BROADCAST_ROWS else bases
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("length").to_numpy().astype(np.int64) << 48 | batch.column("rank").to_numpy()
            run = np.searchsorted(runs_of["key"], key, side="right") - 1
            nth, at = np.divmod(key - runs_of["key"][run], runs_of["times"][run])
            columns = {name: batch.column(name) for name in kept}
            columns["sequence_id"] = pa.array(runs_of["sequence"][run] + nth)
            columns["offset"] = pa.array(runs_of["offset"][run] + at * runs_of["own"][run])
            yield pa.RecordBatch.from_pydict(columns)

    kept = [c for c in pieces.columns if c not in ("part", "rank")]
    schema = pieces.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of pieces packed with their ids; a sequence is bounded by its length."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))

"""Byte-level BPE by dynamic programming over prefixes.

For a byte string there is one token sequence that the merges produce, and the last token of each
prefix's sequence is unique too. ``Prefixes`` stores that token for every prefix: of the tokens
that end at a place, it is the one that may follow the last token before its start, two tokens
being allowed to stand together if their joined bytes encode to just these two. The
sequence is read off backwards. So appending only adds places, and after an edit the places behind
it are recomputed until as many in a row as the longest token has bytes agree with the old ones.

Time is linear in the bytes, whatever the text and however long. A null text is empty; an empty text has no
ids and decodes to nothing. Each row is coded on its own, so repeated rows and ties give equal results; an empty
table gives an empty one. ``encode_documents`` keeps whole rows, so no column can clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from wardspark.llm.columns import LONG, ColumnCoder, runs, slices
from wardspark.llm.common import whole_row

# Parts that a task remembers; then it forgets all and goes on. Of pairs of tokens, four times as many.
REMEMBERED = 150_000
# Pieces of about so many bytes are coded side by side.
PIECE_BYTES = 64 << 10
# Texts of about so many bytes are encoded at once.
SLICE_BYTES = 4 << 20
# Texts of about so many bytes are decoded at once.
DECODED_BYTES = 1 << 20

class Vocabulary:
    """Ranks of byte strings, the pattern that cuts a text, and what has been learned on the way."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        # white space as Unicode has it, without the four separators that Python adds
        space = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        self.pattern = regex.compile(space.replace(r"\s", r"\p{White_Space}")
                                     .replace(r"\S", r"\P{White_Space}"))
        self._pairs: dict[int, bool] = {}
        # most pairs are kept as arrays, which are smaller and are asked for many at once
        self._seen, self._may = pd.Index(np.array([-1])), np.array([False])
        # the beginnings of tokens, numbered: each is known by that of its first bytes and its last byte
        number = {b"": 0}
        self.rank_at, edges = [-1], []
        for token, rank in ranks.items():
            for end in range(1, len(token) + 1):
                if token[:end] not in number:
                    edges.append(number[token[:end - 1]] << 8 | token[end - 1])
                    number[token[:end]] = len(edges)
                    self.rank_at.append(-1)
            self.rank_at[number[token]] = rank
        self.edges, self.rank_at = pd.Index(np.array(edges, np.int64)), np.array(self.rank_at, np.int64)
        self.widths = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
        self.widths[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            pairs = map(bytes.split, file)
            return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging the lowest rank again and again; for the few bytes of two tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            at = ranks.index(min(known))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        if len(self._pairs) > 4 * REMEMBERED:
            self._pairs.clear()
        joined = self.bytes_of[left] + self.bytes_of[right]
        known = self._pairs[left << 32 | right] = self.merged(joined) == [left, right]
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The token that ends the sequence of the first ``end`` bytes; ``last`` has those of all
        shorter prefixes."""
        rank, pairs = self.ranks.get, self._pairs.get
        for start in range(max(0, end - self.longest), end):
            token = rank(data[start:end])
            if token is not None:
                if not start:
                    return token
                allowed = pairs(last[start - 1] << 32 | token)
                if allowed is None:
                    allowed = self.may_follow(last[start - 1], token)
                if allowed:
                    return token
        raise ValueError(f"byte {data[end - 1]} isn't in the vocabulary")

    def read_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def tokens_in(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and rank of every token found in ``data``; ``left``: bytes from a place to its piece's end."""
        at, node = np.flatnonzero(left), np.zeros(np.count_nonzero(left), np.int64)
        begins, tokens, width = [at[:0]], [at[:0]], 0
        while len(at):
            node = self.edges.get_indexer(node << 8 | data[at + width]) + 1
            width += 1
            rank = self.rank_at[node]
            begins.append(at[rank >= 0])
            tokens.append(rank[rank >= 0])
            more = (node > 0) & (left[at] > width)
            at, node = at[more], node[more]
        return np.concatenate(begins), np.concatenate(tokens)

    def all_may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._seen.get_indexer(keys)
        out, new = self._may[at], np.flatnonzero(at < 0)
        codes, fresh = pd.factorize(keys[new])
        found = [(self._pairs.get(key), key) for key in fresh.tolist()]
        out[new] = np.array([self.may_follow(key >> 32, key & 0xFFFFFFFF) if known is None else known
                             for known, key in found], bool)[codes]
        if len(self._pairs) > 1000 + len(self._may) // 4:
            if len(self._may) > 4 * REMEMBERED:
                self._seen, self._may = self._seen[:1], self._may[:1]
            keys, may = np.array(list(self._pairs)), np.array(list(self._pairs.values()), bool)
            new = self._seen.get_indexer(keys) < 0
            self._seen, self._may = self._seen.append(pd.Index(keys[new])), np.append(self._may, may[new])
            self._pairs.clear()
        return out

    def side_by_side(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one behind the other, and how many each has.

        The prefixes of all pieces grow together. Tokens are tried by where they begin, so a
        prefix meets the longest token that may end it first.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        left = np.repeat(ends, sizes) - np.arange(len(data))
        begins, tokens = self.tokens_in(data, left)
        before = (np.repeat(sizes, sizes) - left)[begins]
        order = np.argsort(before.astype(np.uint16), kind="stable")  # pieces have at most LONG bytes
        begins, tokens = begins[order], tokens[order]
        places = begins + self.widths[tokens] - 1
        last = np.full(len(data), -1)
        bounds = np.append(0, np.cumsum(np.bincount(before)))
        for start, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            tried = a + np.flatnonzero(last[places[a:b]] < 0)
            if start:
                tried = tried[last[begins[tried] - 1] >= 0]
                tried = tried[self.all_may_follow(last[begins[tried] - 1], tokens[tried])]
            last[places[tried]] = tokens[tried]
        at, first = (ends - 1)[sizes > 0], (ends - sizes)[sizes > 0]
        whole = (last[at] >= 0) & (self.widths[last[at]] == at + 1 - first)
        lost = np.flatnonzero((last < 0) & ~np.repeat(whole, at + 1 - first))
        if len(lost):
            raise ValueError(f"byte {data[lost[0]]} isn't in the vocabulary")
        chosen = np.zeros(len(data) + 1, np.int64)
        while len(at):
            chosen[at + 1] = 1
            at = at - self.widths[last[at]]
            at, first = at[at >= first], first[at >= first]
        counts = np.cumsum(chosen)
        return last[chosen[1:] > 0].astype("<i4"), counts[ends] - counts[ends - sizes]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern, one behind the other, and how many each has."""
        found, held, size = [(np.zeros(0, "<i4"), np.zeros(0, np.int64))], [], 0
        for data in map(str.encode, texts):
            if size and size + len(data) > PIECE_BYTES or held and len(data) > LONG:
                found.append(self.side_by_side(held))
                held, size = [], 0
            rank = self.ranks.get(data)
            if len(data) > LONG:
                ids = [rank] if rank is not None else Prefixes(self, data).ids()
                found.append((np.array(ids, "<i4"), np.array([len(ids)])))
            else:
                held.append(data)
                size += len(data)
        found.append(self.side_by_side(held))
        return tuple(map(np.concatenate, zip(*found)))

    def piece(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of one match of the pattern."""
        return self.pieces([text])[0].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return self.pieces(self.pattern.findall(text))[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Prefixes:
    """The last token of every prefix of one piece of text."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, end, self.last))

    def edit(self, start: int, stop: int, data: bytes) -> int:
        """Replaces the bytes from start to stop; gives the number of places computed anew."""
        tail, old = self.data[stop:], self.last[stop:]
        self.data = self.data[:start] + data + tail
        del self.last[start:]
        done = start + len(data)
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, end, self.last))
            if end > done:
                same = same + 1 if self.last[-1] == old[end - done - 1] else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - done:]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.vocabulary.read_back(self.last)


class Coder(ColumnCoder):
    """Whole columns of texts to ids and back; each distinct part is coded once by its prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(REMEMBERED)
        self.vocabulary = vocabulary
        tokens = [vocabulary.bytes_of.get(n, b"") for n in range(max(vocabulary.bytes_of, default=-1) + 1)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.widths = np.array([len(token) for token in tokens], np.int64)
        self.begins = np.cumsum(self.widths) - self.widths

    def new(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = self.vocabulary.pattern.findall
        found = [cut(key[1:] if key[:1] == " " else " " + key) for key in keys]
        number: dict[str, int] = {}
        codes = np.array([number.setdefault(piece, len(number)) for pieces in found for piece in pieces], np.int64)
        ids, sizes = self.vocabulary.pieces(list(number))
        own = np.append(0, np.cumsum(sizes[codes]))
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
        ids = ids[runs((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
        return ids, own[bounds[:-1]], np.diff(own[bounds])

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the tokens, one behind the other, and the place behind each token's."""
        widths = self.widths[ids]
        return self.data[runs(self.begins[ids], widths)].tobytes(), np.cumsum(widths)


_CODERS: dict[tuple[str, str], Coder] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    return coder(path, pattern).vocabulary


def coder(path: str, pattern: str) -> Coder:
    """Read once per Python process; every executor has the file at this path."""
    key = path, pattern
    if key not in _CODERS:
        _CODERS[key] = Coder(Vocabulary.read(path, pattern))
    return _CODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``_row`` (the whole row of ``docs``) and ``ids`` ARRAY<INT> of its ``text``."""
    @F.pandas_udf("array<int>")
    def ids(texts):
        found = coder(path, pattern).encode([t if isinstance(t, str) else "" for t in texts])
        return pd.Series([np.frombuffer(x, "<i4") for x in found])

    return docs.select(whole_row(docs).alias("_row"), ids("text").alias("ids"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded`` BINARY, the bytes of its ``ids``."""
    @F.pandas_udf("binary")
    def decoded(lists):
        return lists.map(lambda x: coder(path, pattern).decode(np.asarray(x, np.int64))[0])

    return encoded.withColumn("decoded", decoded("ids"))


def _digests(data: bytes, bounds: np.ndarray) -> list[str]:
    view, at = memoryview(data), bounds.tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])]


def digests(docs: DataFrame, path: str, pattern: str, keys: list[str],
            with_ids: bool = False) -> DataFrame:
    """``keys`` with ``n_tokens, ids_sha256, decoded_sha256`` of each text, and ``ids`` if asked
    for; else the ids stay in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for rows in slices(batch, SLICE_BYTES):
                ids = own.encode_column(rows.column("text").fill_null(""))
                ids_sha, text_sha, done = [], [], 0
                for part in slices(rows, DECODED_BYTES):
                    own_ids = ids.slice(done, part.num_rows)
                    done += part.num_rows
                    flat, ends = own_ids.flatten().to_numpy(), own_ids.offsets.to_numpy() - own_ids.offsets[0].as_py()
                    text, places = own.decode(flat)
                    ids_sha += _digests(flat.astype("<u4").tobytes(), 4 * ends.astype(np.int64))
                    text_sha += _digests(text, np.append(0, places)[ends])
                sizes = pc.list_value_length(ids).cast(pa.int64())
                columns = [*[rows.column(k) for k in keys], sizes, pa.array(ids_sha, pa.string()),
                           pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [ids] * with_ids, schema.names)
                # what Arrow has freed goes back to the machine, on which other tasks run
                pa.default_memory_pool().release_unused()

    schema = docs.select(*keys).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"),
                       ("decoded_sha256", "string")):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    return docs.select(*keys, "text").mapInArrow(run, schema)

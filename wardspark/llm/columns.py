"""Texts to ids column by column: parts of texts are found by Arrow, coded once, and put together by numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Parts that a task remembers; then it forgets all and goes on.
REMEMBERED = 600_000
# Longer parts (in characters) are not remembered.
LONG = 64
# Texts of about so many bytes are encoded at once.
SLICE_BYTES = 8 << 20
# A space beside white space; the pattern language of Arrow needs the characters spelt out.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
UNEVEN = f" [{_WHITE}]|[{_WHITE}] "
_UNEVEN = re.compile(r" \s|\s ")
_GAP = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> list[str]:
    """The text cut before each single space between two characters that aren't white space.

    A byte-level pattern always cuts there, so the parts can be encoded apart.
    """
    if not _UNEVEN.search(text):
        first, *rest = text.split(" ")
        return [first, *[" " + word for word in rest]]
    cuts = [0, *[gap.start() for gap in _GAP.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...``, as many as the size says, of one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def slices(batch: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``size`` bytes; a longer text alone or with few others."""
    at = np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy()) // (size or SLICE_BYTES)
    bounds = [*np.unique(at, return_index=True)[1].tolist(), batch.num_rows]
    for begin, end in zip(bounds, bounds[1:]):
        yield batch.slice(begin, end - begin)


class ColumnCoder:
    """Ids of whole columns of texts, and of the short parts that came more than once.

    A part that is a space and a word is known by the word, any other by a space and itself.
    """

    def __init__(self, remembered: int | None = None):
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def new(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, where in them each part's begin, and how many these are."""
        raise NotImplementedError

    def _ids(self, keys: list[str], codes: np.ndarray, starts: np.ndarray) -> pa.ListArray:
        """Lists of ids of texts whose parts are ``codes``, places in ``keys``; a text's parts begin at
        its place in ``starts``."""
        found = list(map(self.known.get, keys))
        missing = np.array([n for n, ids in enumerate(found) if ids is None], np.int64)
        new = [keys[n] for n in missing.tolist()]
        old = b"".join([ids for ids in found if ids is not None])
        sizes = np.array([len(ids or b"") for ids in found], np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        new_ids, new_begins, sizes[missing] = self.new(new)
        begins[missing] = len(old) // 4 + new_begins
        ids = np.concatenate((np.frombuffer(old, "<i4"), new_ids))
        places = runs(begins[codes], sizes[codes])
        ends = np.cumsum(np.add.reduceat(sizes[codes], starts)) if len(starts) else starts
        if len(self.known) > (self.remembered or REMEMBERED):  # the words of the texts at hand are the likeliest to come
            self.known = {k: ids for k, ids in zip(keys, found) if ids is not None}
        often = missing[np.bincount(codes, minlength=len(keys))[missing] > 1]
        data = ids.tobytes()
        for n, begin, size in zip(*(x.tolist() for x in (often, begins[often], sizes[often]))):
            if len(keys[n]) <= LONG:
                self.known[keys[n]] = data[4 * begin:4 * (begin + size)]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                        pa.array(ids[places], pa.int32()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        found = self.encode_column(pa.array(texts, pa.string()))
        data, ends = found.flatten().to_numpy().astype("<i4").tobytes(), found.offsets.to_pylist()
        return [data[4 * a:4 * b] for a, b in zip(ends, ends[1:])]

    def encode_column(self, texts: pa.StringArray) -> pa.ListArray:
        """A list of ids for each text."""
        uneven = pc.match_substring_regex(texts, UNEVEN)
        plain = texts.filter(pc.invert(uneven))
        words = pc.split_pattern(plain, " ")
        starts = words.offsets.to_numpy()[:-1].astype(np.int64)
        coded = words.flatten().dictionary_encode()
        # no space before a text's first word
        first = pc.take(words.flatten(), pa.array(starts)).to_pylist()
        codes = coded.indices.to_numpy().copy()
        codes[starts] = len(coded.dictionary) + np.arange(len(starts))
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        out = self._ids(keys + [" " + word for word in first], codes, starts)
        if len(plain) == len(texts):
            return out
        parted = [[part[1:] if part[:1] == " " and " " not in part[1:] else " " + part
                   for part in parts(text)] for text in texts.filter(uneven).to_pylist()]
        places = {key: n for n, key in enumerate(set().union(*parted))}
        codes = np.array([places[key] for found in parted for key in found], np.int64)
        starts = np.cumsum([0, *[len(found) for found in parted[:-1]]])
        rest = self._ids(list(places), codes, starts)
        return merged(uneven, rest, out)


def merged(which: pa.BooleanArray, chosen: pa.Array, others: pa.Array) -> pa.Array:
    """``chosen`` where ``which`` is true and ``others`` elsewhere, each in its own order."""
    order = np.argsort(np.argsort(which.to_numpy(zero_copy_only=False), kind="stable"))
    return pa.concat_arrays([others, chosen]).take(pa.array(order))

"""Digests: text hashes, pair keys, evaluation ids, HMAC signatures."""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # bytes in a SHA-256 block


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def pair_key(prompt: Column, response: Column) -> Column:
    """Digest of the pair joined by the fixed separator ``|||``."""
    blank = F.lit("")
    return F.sha2(F.concat(F.coalesce(prompt, blank), F.lit("|||"), F.coalesce(response, blank)),
                  256)


def evaluation_id(row_id: Column, key: Column) -> Column:
    """``eval_`` and 24 hex digits (96 bits), the same on every run."""
    digest = F.sha2(F.concat(row_id.cast("string"), F.lit("|"), key), 256)
    return F.concat(F.lit("eval_"), F.substring(digest, 1, 24))


def hmac_pads(secret: str) -> tuple[str, str]:
    """Hex of the secret's inner and outer HMAC pads."""
    key = secret.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of ``body``, in two built-in digests."""
    inner, outer = (F.unhex(F.lit(p)) for p in hmac_pads(secret))
    first = F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def word_buckets(text: Column, buckets: int) -> Column:
    """Lower-cased words of a text as numbers of hash buckets, written as strings: the first seven hex
    digits of each word's MD5, modulo ``buckets``. A null text has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10)
                                         .cast("long") % buckets).cast("string"))


def bucket_counter(buckets: int, words: str, counts: str) -> CountVectorizerModel:
    """Counts ``word_buckets`` into a vector with one place per bucket; nothing is fitted."""
    model = CountVectorizerModel.from_vocabulary([str(n) for n in range(buckets)], words, counts)
    return model.setMinTF(1.0)

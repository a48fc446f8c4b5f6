"""Plain versions of the operators, one text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(key, folds):
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds


def rules(text):
    text, words = text or "", spaced(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1
              for k in range(3)}
    lines, seen, twice = [x for x in text.split("\n") if spaced(x)], set(), 0
    for line in lines:
        twice += line in seen
        seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(inside),
            n < 50 or 100 * len(inside) > 50 * n)


def kept(text):
    """All rules of the second policy."""
    n, chars, symbols, twice, inside, bad = rules(text)
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    upper = len(re.findall("[A-Z]", text or ""))
    return not (bad or 10 * symbols > n or 100 * twice > 30 * len(lines) or chars < 2 * n
                or chars > 25 * n or 100 * upper > 50 * chars)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def item_windows(items, width=10):
    found = defaultdict(set)
    for key, text in items:
        words = terms(text)
        for s in range(max(len(words) - width, 0) + 1 if words else 0):
            found[tuple(words[s:s + width])].add(key)
    return found


def overlap(text, windows):
    words, hit, items = terms(text), set(), set()
    for size in {len(w) for w in windows}:
        for s in range(len(words) - size + 1):
            owners = windows.get(tuple(words[s:s + size]))
            if owners:
                hit |= set(range(s, s + size))
                items |= owners
    named = sorted(str(i) for i in items if i is not None)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest()


def near(texts, phrases, span):
    """(text number, phrase, place) of a phrase's rarest term with each other one near it."""
    words = [terms(t) for t in texts]
    counts, found = Counter(w for own in words for w in own), []
    for name, phrase in phrases:
        wanted = list(dict.fromkeys(terms(phrase)))
        if not wanted:
            continue
        rarest = min(wanted, key=lambda w: counts[w])
        for n, own in enumerate(words):
            for p, word in enumerate(own):
                if word == rarest and set(wanted) <= set(own[max(p - span, 0):p + span + 1]):
                    found.append((n, name, p))
    return found


def simhash(text):
    words = spaced(lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=3):
    """Smallest id of each component; prints is a list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            root[find(int(j))] = find(i)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(prints))]


class Ppm:
    """The trie as dictionaries, walked byte by byte."""

    def __init__(self, texts, order=4):
        self.order, self.after = order, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.steps(text):
                for k in range(order + 1):
                    self.after[context[order - k:]][symbol] += 1

    def steps(self, text):
        data = b"\xfe" * self.order + lower(text).encode() + b"\xff"
        for i in range(self.order, len(data)):
            yield data[i - self.order:i], data[i]

    def chance(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = self.after.get(context[self.order - k:], {})
            left = {s: n for s, n in counts.items() if s not in excluded}
            mass = sum(left.values())
            if symbol in left:
                return p * (left[symbol] - 0.5) / mass
            if mass:
                p *= len(left) / (2 * mass)
            excluded |= set(counts)
        return p / (256 - len(excluded))

    def score(self, text):
        return sum(math.log10(self.chance(c, s)) for c, s in self.steps(text))


def base(texts, train):
    counts = Counter()
    for text, own in zip(texts, train):
        if own:
            counts.update([*spaced(lower(text)), " "])
    n, v = sum(counts.values()), len(counts)
    out = []
    for text in texts:
        tokens = [*spaced(lower(text)), " "]
        out.append((len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(
            math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    return out


def licence_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def word_pairs(words):
    return list(zip(words, words[1:]))


def licences(text, templates, least=0.8):
    """For each template the best (score, not a window, unit); windows are scored one by one."""
    def dice(a, b):
        return 2 * len(a & b) / (len(a) + len(b))

    found, text = {}, text or ""
    lines, own = text.split("\n"), word_pairs(licence_words(text))
    for name, notice in templates.items():
        wanted = word_pairs(licence_words(notice))
        if not wanted:
            continue
        units = [(n, word_pairs(licence_words(x))) for n, x in enumerate(lines)]
        units += [(-1, own)] if len(lines) > 1 else []
        units += [(-2, own[max(s, 0):s + len(wanted)])
                  for s in range(1 - len(wanted), len(own))]
        score, whole, unit = max(((dice(set(u), set(wanted)), n != -2, -n) for n, u in units),
                                 default=(0, True, 0))
        if score >= least:
            found[name] = score, whole, -unit
    return found

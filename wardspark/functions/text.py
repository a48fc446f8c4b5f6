"""Text helpers whose answers agree with Python's ``str`` and ``re``.

Spark's regex functions run on ``java.util.regex``, whose shorthand classes are ASCII by
default and, with the Unicode flag, still differ from Python's (combining marks count as
word characters, the four ASCII separator controls are not white space).  The shorthand
is therefore spelt out as explicit classes.
"""

from __future__ import annotations

import bisect
import operator
import re
import unicodedata
from functools import reduce
from itertools import groupby, takewhile
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"
_SHORTHAND = {"w": WORD, "s": SPACE, "d": DIGIT}
_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NO_EDGE = rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"


# A word character that must come right after, or came right before, a word edge.
_WORD_AFTER = re.compile(r"(\\[dw]|[A-Za-z0-9_])(?![?*{]|$)|([A-Za-z0-9_])$")
_WORD_BEFORE = re.compile(r"(?:\\[dw]|(?<!\\)[A-Za-z0-9_])$")


_OCTAL = re.compile(r"\\(0[0-7]{0,2}|[1-3][0-7]{2})")
_WIDE = re.compile(r"\\U([0-9A-Fa-f]{8})")
_REPEAT = re.compile(r"\{(?:\d+(?:,\d*)?|,\d*)\}")


def _edge(pattern: str, at: int) -> str:
    """The word edge at position ``at``, as the cheapest test its neighbours allow."""
    after = _WORD_AFTER.match(pattern, at + 2)
    if after:
        first = after.group(1) or after.group(2)
        first = f"[{_SHORTHAND[first[1]]}]" if first[0] == "\\" else first
        return f"(?={first})(?<![{WORD}])"
    if _WORD_BEFORE.search(pattern[:at]):
        return f"(?![{WORD}])"
    return _EDGE


_NAMED = re.compile(r"\\N\{([^}]*)\}")
_REFERENCE = re.compile(r"\\([1-9]\d?)")
_CONDITION = re.compile(r"\(\?\((\w+)\)")


class _Groups:
    """Groups of a Python pattern while it is rewritten.

    Java's group names know no underscore, so named groups are called by their numbers. Java has no
    conditions on a group; a group that one asks about gets an empty group of its own at its end, and a
    reference to that succeeds, on nothing, exactly if the group has matched.
    """

    def __init__(self, pattern: str):
        self.asked = set(_CONDITION.findall(pattern))
        self.names: dict[str, int] = {}
        self.numbers: list[int] = [0]  # of each group in the Java pattern, by its number in Python's
        self.count = 0
        self.open: list[tuple] = []  # ("group", number), ("condition", mark, whether "|" came) or ("other",)

    def begin(self, name: str | None = None) -> str:
        self.count += 1
        self.numbers.append(self.count)
        number = len(self.numbers) - 1
        if name is not None:
            self.names[name] = number
        self.open.append(("group", number))
        return "(" if name is None else f"(?<g{number}>"

    def _number(self, reference: str) -> int:
        return int(reference) if reference.isdigit() else self.names[reference]

    def named(self, name: str) -> str:
        return rf"\k<g{self.names[name]}>"

    def numbered(self, reference: str) -> str:
        return f"\\{self.numbers[int(reference)]}"

    def condition(self, reference: str) -> str:
        mark = rf"\k<t{self._number(reference)}>"
        self.open.append(("condition", mark, False))
        return f"(?:{mark}"

    def bar(self) -> str:
        if self.open and self.open[-1][0] == "condition":
            _, mark, _ = self.open.pop()
            self.open.append(("condition", mark, True))
            return f"|(?!{mark})"
        return "|"

    def end(self) -> str:
        kind, *rest = self.open.pop() if self.open else ("other",)
        if kind == "condition":
            return ")" if rest[1] else f"|(?!{rest[0]}))"
        if kind == "group" and self.asked & {str(rest[0]), *[n for n, k in self.names.items() if k == rest[0]]}:
            self.count += 1
            return f"(?<t{rest[0]}>))"
        return ")"


def spark_regex(pattern: str, ignore_case: bool = False) -> str:
    """The ``java.util.regex`` pattern that finds what Python's ``pattern`` finds."""
    out = ["(?iud)" if ignore_case else "(?d)"]
    in_class = False
    groups = _Groups(pattern)
    i = 0
    while i < len(pattern):
        c, pair = pattern[i], pattern[i:i + 2]
        step = 1
        if c == "\\" and len(pair) == 2:
            step, k = 2, pair[1]
            octal, wide = _OCTAL.match(pattern, i), _WIDE.match(pattern, i)
            named, reference = _NAMED.match(pattern, i), _REFERENCE.match(pattern, i)
            if named:
                step = len(named[0])
                out.append(f"\\x{{{ord(unicodedata.lookup(named[1])):x}}}")
            elif reference and not in_class and not octal and int(reference[1]) < len(groups.numbers):
                step = len(reference[0])
                out.append(groups.numbered(reference[1]))
            elif octal or wide:
                code = int(octal[1], 8) if octal else int(wide[1], 16)
                step = len((octal or wide)[0])
                out.append(f"\\x{{{code:x}}}")
            elif k == "v":  # one character, not a class
                out.append(r"\x0b")
            elif k in _SHORTHAND:
                out.append(_SHORTHAND[k] if in_class else f"[{_SHORTHAND[k]}]")
            elif k.lower() in _SHORTHAND:
                out.append(f"[^{_SHORTHAND[k.lower()]}]")
            elif k in "bB" and not in_class:
                out.append(_edge(pattern, i) if k == "b" else _NO_EDGE)
            elif k == "Z":
                out.append(r"\z")
            else:
                out.append(r"\x08" if pair == r"\b" else pair)
        elif in_class:
            # "[" and "&" are ordinary inside a Python class, operators in a Java one
            out.append("\\" + c if c in "[&" else c)
            in_class = c != "]"
        elif c == "[":
            in_class = True
            step = 2 if pair == "[^" else 1
            out.append(pattern[i:i + step])
            if pattern[i + step:i + step + 1] == "]":
                out.append(r"\]")
                step += 1
        elif c == "{":
            # a repeat without a lower bound starts at none; other braces are ordinary
            repeat = _REPEAT.match(pattern, i)
            step = len(repeat[0]) if repeat else 1
            out.append("\\{" if not repeat else
                       "{0" + repeat[0][1:] if repeat[0][1] == "," else repeat[0])
        elif pattern.startswith("(?P<", i):
            step = pattern.index(">", i) + 1 - i
            out.append(groups.begin(pattern[i + 4:i + step - 1]))
        elif pattern.startswith("(?P=", i):
            step = pattern.index(")", i) + 1 - i
            out.append(groups.named(pattern[i + 4:i + step - 1]))
        elif pattern.startswith("(?#", i):
            step = pattern.index(")", i) + 1 - i
        elif condition := _CONDITION.match(pattern, i):
            step = len(condition[0])
            out.append(groups.condition(condition[1]))
        elif pair == "(?":
            groups.open.append(("other",))
            out.append(c)
        elif c == "(":
            out.append(groups.begin())
        elif c == "|":
            out.append(groups.bar())
        elif c == ")":
            out.append(groups.end())
        else:
            out.append(c)
        i += step
    return "".join(out)


def strip(text: Column) -> Column:
    """Both ends freed of white space."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return ~F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def is_empty(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) == 0


# White space that the plain ASCII class of the regex engine does not know.
_RARE_SPACE = "".join(map(chr, [
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def word_count(text: Column) -> Column:
    """Number of white-space separated words.

    Rare spaces become plain ones first: matching with the short ASCII class is about
    ten times faster than with the full one.
    """
    plain = F.translate(text, _RARE_SPACE, " " * len(_RARE_SPACE))
    return F.coalesce(F.regexp_count(plain, F.lit(r"\S+")), F.lit(0))


def fold_case(text: Column) -> Column:
    """Lower case in which two letters that only case folding equates (long s and
    dotless i) are plain, so that lower-case patterns need no ignore-case flag."""
    low = F.lower(text)
    return F.replace(F.replace(low, F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))


def fold_length(text: Column) -> Column:
    """Case-folded text with the same number of characters: the one letter whose lower
    case is two characters long becomes a plain i."""
    return fold_case(F.replace(text, F.lit("\u0130"), F.lit("i")))


# Syntax whose meaning may change when a pattern is lower-cased: escapes but for the plain class
# shorthands, back-references and escaped symbols; groups of special kinds.
_CASE_BOUND = re.compile(r"\\(?![wsdb]|[1-9](?!\d)|[^A-Za-z0-9])|\(\?(?!:)")
# Ranges are only safe within the lower-case letters, the capitals or the digits.
_RANGE = re.compile(r"(?=(.)-(.))", re.DOTALL)
_SAFE_RANGE = re.compile(r"[a-z]{2}|[A-Z]{2}|\d{2}")


def folds(pattern: str) -> bool:
    """Whether ignoring case in ``pattern`` is the same as matching its lower case on
    case-folded text, which is several times faster."""
    if not pattern.isascii() or _CASE_BOUND.search(pattern):
        return False
    return "[" not in pattern or all(_SAFE_RANGE.fullmatch(low + high)
                                     for low, high in _RANGE.findall(pattern))


def contains_any(text: Column, words) -> Column:
    out = None
    for w in words:
        out = text.contains(w) if out is None else out | text.contains(w)
    return F.lit(False) if out is None else out


SCAN_WORDS = 128  # from about so many words on, one pattern beats a search for each


class Words:
    """A set of words to look for in a text, as substrings.

    Few words are searched for one by one. Many are merged by their common beginnings into
    one pattern inside a look-ahead, so that overlapping occurrences count. At each place the
    longest word is reported; a word also occurs wherever a longer one that begins with it
    does.
    """

    def __init__(self, words):
        self.words = sorted({w for w in words if w})
        self.merged = len(self.words) > SCAN_WORDS

    def found(self, text: Column) -> Column:
        """What ``has`` asks: the distinct words reported in ``text``, or the text itself.
        To be a column of an earlier projection."""
        if not self.merged:
            return text
        pattern = f"(?=({_merged(self.words)}))"
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def has(self, found: Column, word: str) -> Column:
        """Whether ``word`` occurs, given what was ``found``."""
        if not word:
            return F.lit(True)
        if not self.merged:
            return found.contains(word)
        at = bisect.bisect_left(self.words, word)
        longer = list(takewhile(lambda w: w.startswith(word), self.words[at:]))
        if len(longer) == 1:
            return F.array_contains(found, word)
        return F.arrays_overlap(found, F.split(F.lit("\u0001".join(longer)), "\u0001"))

    def has_any(self, found: Column, words) -> Column:
        return reduce(operator.or_, [self.has(found, w) for w in words])


def _merged(words: list[str]) -> str:
    """Pattern of sorted distinct words that tries the longest first."""
    out = []
    for _, group in groupby((w for w in words if w), key=lambda w: w[0]):
        group = list(group)
        shared = commonprefix(group)  # so that the recursion is no deeper than words are nested
        rest = [w[len(shared):] for w in group]
        symbol = "".join(c if c.isalnum() else f"\\{c}" for c in shared)
        tail = _merged(rest)
        if tail and "" in rest:
            tail = f"(?:{tail})?"
        elif len([r for r in rest if r]) > 1:
            tail = f"(?:{tail})"
        out.append(symbol + tail)
    return "|".join(out)


def two_decimals(number: Column) -> Column:
    """Two decimals, ties to even on the exact binary value."""
    return F.format_number(number, 2)


def preview(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size,
                  F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def keep_present(*columns: Column) -> Column:
    """Array of the non-empty strings among ``columns``, in order, inside codegen."""
    blank = F.lit("")
    if not columns:
        return F.array().cast("array<string>")
    return F.array_remove(F.array(*[F.coalesce(c, blank) for c in columns]), "")


def total(columns: list[Column]) -> Column:
    """Number of true conditions among ``columns``."""
    out = None
    for c in columns:
        out = c.cast("int") if out is None else out + c.cast("int")
    return F.lit(0) if out is None else out

"""Tables of rules against lists of the same rules, and against Python's own matching."""

import random
import re
from dataclasses import replace as changed

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.operators import rule_index, rules
from wardspark.operators.rules import Rule

PATTERNS = [r"term\d+", r"\$\d+(\.\d{2})?", r"(?:red|green|blue) (?:fish|bird)s?", r"\d{3,}", "", ".", r"a|", "x{0,2}y",
            r"(?P<first_name>john)\s+doe", r"(?#note)foxes?", r"(a)?(?(1)bc|de)", r"\N{BULLET} item", r"[aA]bc\b",
            r"\bthe end\b", "straße", "ſpecial", "İstanbul", "(", "a++b", "(?>ab)c", r"(?i:MiXed)case", "ab(?=cd)cd",
            r"(one|two)\1", r"^start", "end$", r"\x41\x42c", "kK", "(?s)a.b", r"[^a]b{2}c"]
WORDS = ["term12", "$5.00", "red fish", "green birds", "1234", "y", "xy", "john  doe", "fox", "abc", "de", "bc",
         "• item", "Abc", "the end", "STRASSE", "straße", "special", "ſpecial", "istanbul", "İSTANBUL", "aab", "abcd",
         "mixedCASE", "oneone", "start", "end", "ABc", "kk", "KK", "a\nb", "bbc", "", " "]


def listed():
    made = [Rule(f"r{n:02}", f"N{n}", p, "regex", n / 40, "block" if n % 5 == 0 else "flag",
                 ["both", "prompt", "response"][n % 3], n != 7) for n, p in enumerate(PATTERNS)]
    made += [Rule("k0", "K0", "red, fish", "keyword", 0.3), Rule("k1", "K1", "BLUE fish,zz", "keyword", 0.9, "block"),
             Rule("k2", "K2", "a,,b", "keyword", 0.05), Rule("k3", "K3", "i̇stan", "keyword"),
             Rule("k4", "K4", "straße , x", "keyword"), Rule("s", "S", "x", "script")]
    return made


def table(spark, made):
    return spark.createDataFrame([changed(r).__dict__ for r in made],
                                 "rule_id string, name string, pattern string, rule_type string, severity double, "
                                 "action string, apply_to string, enabled boolean").repartition(3)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    rows += [None, "", "ab" * 3000 + " the end", *WORDS]
    return spark.createDataFrame(list(enumerate(rows)), "n int, t string").repartition(4)


def test_every_match_holds_a_needed_literal():
    rng, found = random.Random(3), 0
    texts = ["".join(rng.choice(WORDS + list("ab c1•ſK")) for _ in range(rng.randint(1, 6))) for _ in range(800)]
    for pattern in PATTERNS:
        try:
            own = re.compile(pattern, re.IGNORECASE)
        except re.error:
            continue
        literals = rule_index.needed_literals(pattern, "regex")
        assert all(x.isascii() and x == x.lower() for x in literals)
        for text in texts:
            if own.search(text):
                folded = text.replace("İ", "i").lower().replace("ſ", "s").replace("ı", "i")
                assert not literals or any(x in folded for x in literals), (pattern, text)
                found += 1
    assert found > 2000


@pytest.mark.parametrize("pattern,literals", [
    (r"term\d+", ["term"]), (r"\d+", []), ("(?:cat|dog)s", ["cat", "dog"]), ("(cat|.)", []), ("(ab)?c", ["c"]),
    ("(?:abc)+d", ["abc"]), (r"\bfoo\b(?=x) bar", ["foo bar"])])
def test_needed_literals(pattern, literals):
    assert rule_index.needed_literals(pattern, "regex") == literals


def test_windows_are_found(spark):
    rng = np.random.default_rng(6)
    keys = [w for x in ("a", "bc", "def", "ghij", "klmnop", "qrstuvwx") for w in rule_index._windows(x)]
    own = rule_index.Windows.of(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert own.widths == rule_index.WIDTHS
    texts = ["".join(rng.choice(["a", "bc", "def", "ghij", "klmnop", "qrstuvwx", "z", "é"], rng.integers(0, 6)))
             for _ in range(200)]
    for text, found in zip(texts, own.found([t.encode() for t in texts])):
        held = {k for k in keys if k.to_bytes((k.bit_length() + 7) // 8, "big") in text.encode()}
        assert held <= set(found.tolist()) and len(set(found.tolist())) == len(found)
    assert own.found([b""])[0].tolist() == []


@pytest.mark.filterwarnings("ignore:rule")
@pytest.mark.parametrize("target", ["both", "prompt"])
def test_a_table_equals_a_list(spark, texts, target):
    made = listed()
    wanted = {(r.n, r.rule_id, r.severity) for r in rules.rule_hits(texts, "t", made, target).collect()}
    got = rules.rule_hits(texts, "t", table(spark, made), target).collect()
    assert len(got) == len(set(got)) and {(r.n, r.rule_id, r.severity) for r in got} == wanted
    assert len({r[1] for r in wanted}) > 10
    a, b = (sorted(map(tuple, rules.rule_score(texts, "t", x, target).collect()), key=repr)
            for x in (made, table(spark, made)))
    assert a == b


@pytest.mark.filterwarnings("ignore:rule")
def test_details_and_statistics_of_a_table(spark, texts):
    made = listed()

    def detail(x):
        return {r.n: (r.custom_rules.rules_triggered, r.custom_rules.blocked, sorted(
            (h.rule_id, h.matched, tuple(h.matched_keywords or ())) for h in r.custom_rules.triggered_rules),
            sorted(r.detected_items)) for r in rules.rule_detail(texts, "t", x).collect()}

    assert detail(made) == detail(table(spark, made))
    dated = texts.withColumn("ts", F.col("n"))
    a, b = ({r.rule_id: (r.match_count, r.last_matched_at) for r in rules.rule_match_stats(
        dated, "t", "ts", x).collect()} for x in (made, table(spark, made)))
    assert a == b


def test_both_joins_give_the_same(spark, texts):
    index = rule_index.rule_index(table(spark, listed()), "both")
    assert index.small and index.every_text
    a = rule_index.indexed_hits(texts, "t", index)
    b = rule_index.indexed_hits(texts, "t", changed(index, small=False))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_problems_of_a_table(spark):
    found = {r.rule_id: r.problem for r in rules.rule_problems(spark, table(spark, listed())).collect()}
    assert set(found) == {"s"} | {f"r{n:02}" for n, p in enumerate(PATTERNS) if p == "("}
    assert found["s"] == "unknown type script"


def test_no_rules(spark, texts):
    none = table(spark, listed()).filter("false")
    assert rules.rule_hits(texts, "t", none).count() == 0
    assert {r.score for r in rules.rule_score(texts, "t", none).collect()} == {0.0}
    assert rules.rule_hits(texts.filter("false"), "t", table(spark, listed())).count() == 0


def test_all_literals():
    assert rule_index.all_literals(r"(?:cat|dog)[.,]\s+bird") == [["cat", "dog"], ["bird"]]
    assert rule_index.all_literals(r"\d+x?") == [] and rule_index.needed_literals("a\x00bc", "regex") == ["bc"]


def test_texts_are_joined_without_their_windows(spark, texts):
    """A text meets many keys; its list of windows isn't copied for each."""
    index = rule_index.rule_index(table(spark, listed()), "both")
    plan = rule_index.indexed_hits(texts, "t", index)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[:plan.index("Join Inner")]
    assert "_held" not in joined and "array_intersect" not in plan


def test_a_rule_met_under_several_keys_is_tried_once(spark):
    made = [Rule("r", "R", "(?:cat|dog|bird|\tox)s? [0-9]+", "regex", 0.7), Rule("z", "Z", "a\x00b,\x00q", "keyword", 0.2),
            Rule("n", "N", "x\x00yy", "regex", 0.3)]
    texts = spark.createDataFrame([(1, "cat dog birds \tox 7"), (2, "dog cat 1"), (3, "bird"), (4, "a\x00b q"),
                                   (5, "xx\x00yyy"), (6, "\x00q yy")], "n int, t string")
    got = sorted((r.n, r.rule_id) for r in rules.rule_hits(texts, "t", table(spark, made)).collect())
    assert got == [(1, "r"), (2, "r"), (4, "z"), (5, "n"), (6, "z")]

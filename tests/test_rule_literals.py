"""Rules that a few literals decide: against Python's own matching, and as a table against a list of the same rules."""

import random
import re
from dataclasses import replace as changed

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardspark.functions import text as T
from wardspark.operators import rule_index, rule_literals, rules
from wardspark.operators.rule_literals import FOLDED, LOW, SHAPED, Literals, Scan, shaped, whole_literals
from wardspark.operators.rules import Rule

SCHEMA = ("rule_id string, name string, pattern string, rule_type string, severity double, action string, "
          "apply_to string, enabled boolean")
PATTERNS = [r"the\s+end", "(?:red|blue)[.,]\\s+fish", "(red)+ (fish|bird)", "[0-9]{0,}x?", "[0-9]{3,}x?", r"\$[0-9]{2}",
            r"(ab)+c?\s*red", "a{2}b", "(?:x?y)+z", "fish(?:es)?$", r"fish\.", r"(?:a|b|)red", r"\s+red", r"red\s+",
            r"red\s+[0-9]+", "straße", r"red\s+blue fish", "[a-c]d", "(?:re)+d+", r"bird\s*,", "Kelvin", "special"]
WORDS = ["the", "end", "red", "blue", "fish", "bird", "fishes", "abab", "ab", "aab", "xyz", "yz", "12", "345x", "$42", "$4",
         ".", ",", " ", "  ", "\t", "\n", " ", " ", "STRASSE", "straße", "ſpecial", "İs", "Kelvin", "ad", "ı"]


def made_rules():
    made = [Rule(f"r{n:02}", f"N{n}", p, "regex", n / 30, "flag") for n, p in enumerate(PATTERNS)]
    return made + [Rule("k0", "K0", "red fish, İs", "keyword", 0.95, "block"), Rule("k1", "K1", "i̇s", "keyword", 0.2),
                   Rule("k2", "K2", "STRASSE , special", "keyword", 0.3), Rule("k3", "K3", "x,,y", "keyword", 0.01),
                   Rule("k4", "K4", "red the end of blue fish and bird", "keyword", 0.99)]


def made_texts(count=300):
    rng = random.Random(8)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(count)] + [
        None, "", " ", "\t \n", "so red the end of blue fish and birds", "red the end of blue fish and"]


def table(spark, made):
    return spark.createDataFrame([r.__dict__ for r in made], SCHEMA).repartition(3)


def texts_of(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "n int, t string").repartition(3)


@pytest.mark.parametrize("pattern,found", [
    (r"the\s+end", (SHAPED, ["the end"])), ("(ab)+ (c|d)", (FOLDED, ["ab c", "ab d"])),
    (r"(?:a|b)[.,]\s+c", (SHAPED, ["a, c", "a. c", "b, c", "b. c"])), ("[0-9]{3,}x?", (SHAPED, ["000"])),
    ("[0-9]{0,}x?", (FOLDED, [""])), ("a|", (FOLDED, ["", "a"])), (r"a\s*b", (SHAPED, ["a b", "ab"])), ("x{0,2}y", (FOLDED, ["y"])),
    ("ab{1,2}c", (FOLDED, ["abbc", "abc"])), (r"\d+", None), ("a.b", None), ("a+b+c", None), ("^a", None), (r"\ba", None),
    (r"(a)\1", None), (r"a\s+b c", None), (r"a\s+\s+b", None), (r"a\sb", None), (r"a\s+0", None), ("a{300}", None)])
def test_whole_literals(pattern, found):
    assert whole_literals(pattern) == found


def test_a_literal_is_held_exactly_where_the_pattern_is_found():
    rng, decided, hits = random.Random(2), 0, 0
    atoms = ["a", "b", "[ab]", r"\s+", r"\s*", "[0-9]", "[0-9]+", "[0-9]{2}", "(?:a|b1|)", "(ab)", " ", ",", "1", "(a+|b)"]
    texts = ["".join(rng.choice("aab1 2,\t") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    for _ in range(1500):
        pattern = "".join(rng.choice(atoms[:3] if rng.random() < 0.3 else atoms) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.5:
            pattern = f"({pattern}){rng.choice(['+', '?', '{2}', '*', '{1,2}'])}" + rng.choice(["", "a", "[0-9]"])
        found = whole_literals(pattern)
        if found is None:
            continue
        decided += 1
        for text in rng.sample(texts, 40):
            seen = re.sub("[0-9]", "0", shaped(text)) if found[0] == SHAPED else text
            held = any(x in seen for x in found[1])
            hits += held
            assert held == bool(re.search(pattern, text)), (pattern, text, found)
    assert decided > 500 and hits > 5000


def test_shaped():
    for text in made_texts():
        assert text is None or shaped(text) == re.sub(r"\s+", " ", text)


def test_scan_finds_all_literals():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "c", "é", "0", "12", "xyz "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    literals = sorted({t[i:i + n] for t in texts[::9] for n in (1, 2, 3, 5, 7, 8, 9, 16, 17, 40) for i in range(0, 9, 4)} - {""})
    row, lit = Scan([x.encode() for x in literals]).held([t.encode() for t in texts])
    assert list(zip(row.tolist(), lit.tolist())) == [(r, n) for r, t in enumerate(texts) for n, x in enumerate(literals) if x in t]
    assert [len(x) for x in Scan([]).held([b"a"])] == [0, 0]


@pytest.mark.parametrize("cells", [rule_literals.CELLS, 1])
def test_slices_and_nulls(monkeypatch, cells):
    monkeypatch.setattr(rule_literals, "CELLS", cells)
    own = Literals(pa.table({"number": [5, 1 << 40, 7], "severity": [0.5, 0.9, 0.1], "shape": [LOW, SHAPED, FOLDED],
                             "whole": [["a", "bb"], ["00 x"], [""]]}))
    low = pa.array(["a bb", None, "", "12\tx", "7 x"])
    assert [x for part in own.fired(low, low) for x in map(sorted, part.to_pylist())] == [[5, 7], [], [7], [7, 1 << 40], [7]]
    assert own.top(low, low).tolist() == [0.5, -float("inf"), 0.1, 0.9, 0.1]
    # a keyword is in the lower case, a pattern's literal in the folded text
    assert [x for part in own.fired(pa.array(["ı"]), pa.array(["a"])) for x in part.to_pylist()] == [[7]]


@pytest.mark.parametrize("piece", [rule_index.PIECE_BYTES, 200])
def test_hits_of_a_table_equal_those_of_a_list(spark, monkeypatch, piece):
    monkeypatch.setattr(rule_index, "PIECE_BYTES", piece)
    texts, made = texts_of(spark, made_texts()), made_rules()
    index = rule_index.rule_index(table(spark, made))
    assert (len(index.pieces) > 3) == (piece == 200)
    wanted = sorted(tuple(r) for r in rules.rule_hits(texts, "t", made).collect())
    for on in (index, changed(index, exact_small=False)):
        got = rule_index.indexed_hits(texts, "t", on).drop("matched", "matched_keywords").collect()
        assert sorted(tuple(r) for r in got) == wanted
    assert len({r[1] for r in wanted}) > 20


def test_a_rule_listed_twice_fires_twice(spark):
    made = [Rule("a", "A", "red"), Rule("a", "A", "red"), Rule("a", "A", "fish"), Rule(None, "B", "red,x", "keyword")]
    texts = texts_of(spark, ["red", "red fish", "none"])
    assert sorted((r.n, r.name) for r in rules.rule_hits(texts, "t", table(spark, made)).collect()) == [
        (0, "A"), (0, "A"), (0, "B"), (1, "A"), (1, "A"), (1, "A"), (1, "B")]


def test_no_exact_rule_is_tried_on_a_text(spark):
    """before, each rule met was matched as a pattern, and its plan had the patterns' matching."""
    made = [r for r in made_rules() if r.rule_type == "keyword" or T.folds(r.pattern) and whole_literals(r.pattern.lower())]
    hits = rules.rule_hits(texts_of(spark, made_texts()), "t", table(spark, made))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "contains" not in plan and plan.count("ArrowEvalPython") == 1
    assert hits.count() > 500


def test_tables_with_few_kinds_of_rules(spark):
    texts = texts_of(spark, made_texts(50))
    for made in ([r for r in made_rules() if r.rule_id in ("r09", "r15")], [Rule("z", "Z", "red")], []):
        got = rules.rule_hits(texts, "t", table(spark, made)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, rules.rule_hits(texts, "t", made).collect())) if made else not got
        on_empty = rule_index.indexed_hits(texts, "t", rule_index.rule_index(table(spark, made)), True)
        assert on_empty.count() == len(got)


@pytest.mark.parametrize("kind", ["long", "double", "string", "timestamp", "timestamp_ntz", "date", "decimal(9,2)", "boolean",
                                  "binary", "struct<a:int,b:string>"])
def test_statistics_of_a_table_equal_those_of_a_list(spark, monkeypatch, kind):
    monkeypatch.setattr(rule_index, "PIECE_BYTES", 900)
    n = F.col("n").cast("long")
    at = {"boolean": n % 2 == 0, "struct<a:int,b:string>": F.struct((n % 7).cast("int").alias("a"), F.lit("x").alias("b")),
          "timestamp": F.timestamp_seconds(n * 7919 % 5000), "binary": F.encode(n.cast("string"), "utf-8"),
          "timestamp_ntz": F.timestamp_seconds(n * 7919 % 5000).cast("timestamp_ntz"),
          "date": F.date_add(F.lit("2020-02-27").cast("date"), (n % 90).cast("int")),
          "double": F.when(n % 11 == 0, float("nan")).otherwise(n * 7 % 300 - 150)}.get(kind, (n * 7919 % 500).cast(kind))
    dated = texts_of(spark, made_texts()).withColumn("at", F.when(n % 4 != 0, at)).drop("n")
    made = made_rules() + [Rule("once", "O", "red the", "keyword", 0.1, apply_to="prompt", enabled=False)]
    a, b = (sorted(map(str, rules.rule_match_stats(dated, "t", "at", x).collect())) for x in (made, table(spark, made)))
    assert a == b and any("count=0" in x for x in a)


def test_statistics_without_a_time(spark):
    dated = spark.createDataFrame([("red", None), ("fish", 3), ("red fish", None)], "t string, at int")
    made = [Rule("a", "A", "red"), Rule("a", "B", "fish"), Rule("b", "B", "red,x", "keyword"), Rule("c", "C", "none")]
    assert sorted(map(tuple, rules.rule_match_stats(dated, "t", "at", table(spark, made)).collect())) == [
        ("a", 4, 3), ("a", 4, 3), ("b", 2, None), ("c", 0, None)]


def test_statistics_make_no_row_for_each_hit(spark):
    """before, every hit was a row, and matched as a pattern."""
    dated = texts_of(spark, made_texts(50))
    made = [r for r in made_rules() if r.rule_type == "keyword"]
    plan = rules.rule_match_stats(dated, "t", "n", table(spark, made))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("piece", [rule_index.PIECE_BYTES, 300])
def test_scores_of_a_table_equal_those_of_a_list(spark, monkeypatch, piece):
    monkeypatch.setattr(rule_index, "PIECE_BYTES", piece)
    texts = texts_of(spark, made_texts())
    odd = [Rule("neg", "N", "end", "keyword", -3.0), Rule("zero", "Z", "[0-9]{0,}", "regex", 0.0)]
    for made in (made_rules() + odd, [r for r in made_rules() + odd if r.rule_type == "keyword"]):
        a, b = (sorted(map(tuple, rules.rule_score(texts, "t", x, threshold=0.3).collect()), key=repr)
                for x in (made, table(spark, made)))
        assert a == b and len({r[2] for r in a}) > 4
    odd += [Rule("nan", "A", "red", "keyword", float("nan"))]
    got = {r.n: str(r.score) for r in rules.rule_score(texts, "t", table(spark, odd)).collect()}
    assert all((got[n] == "nan") == ("red" in (t or "")) for n, t in enumerate(made_texts()))


def test_scores_make_no_row_for_each_hit(spark):
    """before, every hit was a row, matched as a pattern, and joined back with its text."""
    made = [r for r in made_rules() if r.rule_type == "keyword"]
    scored = rules.rule_score(texts_of(spark, made_texts(50)), "t", table(spark, made)).filter("score > 0.1")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("RLIKE", "Generate", "Join")) and plan.count("ArrowEvalPython") == 1

"""Many rules by their literals, the dialect of patterns, and the best finding of a span as the state of a stream."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions.catalog import PATTERN_RULES
from siftwell.functions.dialect import to_java
from siftwell.operators import detect
from siftwell.operators.indexed import index, indexed_findings
from siftwell.plans import fixtures
from siftwell.plans.queries import large_pack
from siftwell.plans.scan import scan
from siftwell.sources import rule_pack
from siftwell.sources.config import IgnoreSpec, ScanConfig, custom_rules
from siftwell.streaming.stream import best_findings, read_latest, write_latest

PAIRS = [
    ("a", "a"), (r"[\s,]x", " x"), (r"\d+", "12"), (r"(?i)key\b", "KEY"), (r"x$", "x"), (r"^x", "x"), (r".", "é"), (r"[^\W\d]+", "ab"), (r"(a|bc)+d", "abcd"), (r"(?<=a)b(?!c)", "ab"),
    (r"(?P<q>['\"])x(?P=q)", "'x'"), (r"(?i:ab)C", "aBC"), (r"[\]\\^-]+", "]^-\\"), (r"a{2,3}?b", "aab"), (r"\Bb", "ab"), (r"(?>a+)b", "aab"), (r"é[à-ü]", "éé"), (r"#\{\}&&\[", "#{}&&["),
]


def found_by_spark(spark, patterns, texts):
    rows = spark.createDataFrame([(i, p, j, t) for i, p in enumerate(patterns) for j, t in enumerate(texts)], "i int, p string, j int, t string")
    got = rows.select("i", "j", F.regexp_extract_all("t", F.col("p"), F.lit(0)).alias("m")).collect()
    return {(r["i"], r["j"]): r["m"] for r in got}


def test_patterns_mean_the_same(spark):
    texts = [t for _, t in PAIRS] + ["", "abc key KEY_x x", "a b,c", "x1 y22 ", "ab aab aaab bcbcd", "\\]^-", "it's 'x' \"x' x", "Éé éà"]
    got = found_by_spark(spark, [to_java(p) for p, _ in PAIRS], texts)
    for i, (p, own) in enumerate(PAIRS):
        assert got[i, i], p
        for j, t in enumerate(texts):
            assert got[i, j] == [m[0] for m in re.finditer(p, t, re.ASCII)], (p, t)
    java = found_by_spark(spark, [to_java(p) for p in (r"a\sb", r"a.b", r"b$", r"\bé")], ["a\xa0b", "a b", "a\rb", "b\n", "é"])
    assert [bool(java[k]) for k in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (3, 4))] == [True, True, False, False, False, False]


_atoms = st.sampled_from(["a", "b", "_", "-", r"\.", ".", r"\d", r"\w", r"\W", "[ab]", "[^a]", r"[\d-]", r"\b", "(?:ab|b)", "(a)", "(?!b)", "(?=a)", "$", "^"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(_atoms, st.sampled_from(["", "", "", "?", "+", "{1,2}", "*"])), min_size=1, max_size=5), min_size=8, max_size=8), st.lists(st.text(alphabet="ab_-.1 ", max_size=12), min_size=3, max_size=3))
def test_any_pattern_means_the_same(spark, shapes, texts):
    patterns, java = [], []
    for shape in shapes:
        p = "".join(a + ("" if a in (r"\b", "$", "^") or a.startswith("(?!") or a.startswith("(?=") else q) for a, q in shape)
        try:
            java.append(to_java(p))
            patterns.append(p)
        except ValueError:
            assert re.compile(p, re.ASCII).match("") or re.compile(p, re.ASCII).search("") is not None or "^" in p or "$" in p or re._parser.parse(p).getwidth()[0] == 0
    if patterns:
        got = found_by_spark(spark, java, texts)
        for i, p in enumerate(patterns):
            for j, t in enumerate(texts):
                assert got[i, j] == [m[0] for m in re.finditer(p, t, re.ASCII)], (p, java[i], t)


@pytest.mark.parametrize("pattern", ["", "a*", "(a+)+b", "(?:a|b+)*c", r"(\w+\d)+x", "(", "a{5000000000}", "(?:x*)+y", "(?m)^a", "(?:(?:a+)b?)+c"])
def test_patterns_that_are_refused(pattern):
    with pytest.raises(ValueError):
        to_java(pattern)
    rules, wrong = custom_rules([{"id": "a", "pattern": pattern}, {"id": "b", "pattern": "fine"}])
    assert [r.id for r in rules] == ["b"] and len(wrong) == 1
    assert all(to_java(r.pattern) for r in PATTERN_RULES if "m" not in r.flags)


def test_a_rule_that_java_has_not_is_a_warning_and_no_dead_job(spark):
    rules, wrong = custom_rules([{"id": "named", "pattern": r"(?P<k>tok)=(?P=k)"}, {"id": "cond", "pattern": r"(a)?b(?(1)c|d)"}])
    assert len(wrong) == 1 and "cond" in wrong[0]
    files = spark.createDataFrame([("a", "x tok=tok y")], "file string, content string")
    assert [(r["rule_id"], r["secret"]) for r in scan(files, ScanConfig(rules=rules)).collect()] == [("named", "tok")]


def test_many_rules_find_what_brute_force_finds(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcXY_-") for _ in range(rng.randint(2, 5))) for _ in range(300)]
    rows = [{"id": f"r{i}", "pattern": p} for i, w in enumerate(words) for p in [rng.choice([re.escape(w) + "[0-9]+", f"(?:{re.escape(w)}|{re.escape(w[::-1])}q)=(\\w+)", f"[a-c]{{2}}{re.escape(w)}", f"(?i){re.escape(w)}\\b"])]]
    pack, warnings = rule_pack.load(__import__("json").dumps(rows))
    assert len(pack) == 300 and warnings == ["the pack is not signed"]
    rows, always = index(pack)
    assert always and all(len(x) >= 3 for _, _, x, _ in rows)
    lines = [" ".join(rng.choice([*words, "x1", "=", "q=abc", "İé日"]) + rng.choice(["", "7", "=zz"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_number long, line string").withColumn("shift", F.lit(3))
    tidy = lambda found: sorted(map(repr, found.select("line_number", "rule_id", "match", "secret", "match_start", "emit_match").collect()))
    got = tidy(indexed_findings(df, pack))
    assert got == tidy(detect.pattern_findings(df, pack)) and len(got) > 100
    want = sum(len([m for m in re.finditer(r.pattern, x, re.ASCII) if True]) for r in pack for x in lines)
    assert len(got) == want


def test_a_pack_is_a_part_of_the_scan(spark):
    plan = scan(spark.createDataFrame([("a", "the end.")], "file string, content string"), ScanConfig(packs=large_pack()))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert len(text) < 2_000_000 and "BroadcastHashJoin" in text and "Python" not in text
    ids = {r.id for r in large_pack() if r.pattern.startswith("end")}
    assert {r["rule_id"] for r in plan.collect()} == ids


CONFIG = ScanConfig(severity={"npm-token": "low", "env-var-secret": "ignore"}, ignore=IgnoreSpec.parse("[rule:jwt-token] b*"), entropy_threshold=3.8)


def test_streamed_equals_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(1)
    samples = [line for _, line in fixtures.rule_lines()]
    key = fixtures.sample(r"AKIA[0-9A-Z]{16}")
    texts = ["\n".join(rng.choice(samples) for _ in range(8)) + f'\nk = "{key[:7]}" + "{key[7:]}"\n`{key} in a template`\nx = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ"' for _ in range(30)]
    schema = "file string, content string, at timestamp"
    rows = spark.createDataFrame([(f"{'ab'[i % 2]}{i}.env", t, None) for i, t in enumerate(texts)], schema).withColumn("at", F.to_timestamp(F.lit("2024-01-01 01:00:00")))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows.filter("substring(file, 1, 1) = 'a'").write.parquet(source)
    stream = lambda: best_findings(spark.readStream.schema(schema).parquet(source), CONFIG, at="at")
    write_latest(stream(), out, state).awaitTermination()
    rows.filter("substring(file, 1, 1) = 'b'").write.mode("append").parquet(source)
    # a file comes again, with a more severe finding on a span that had one
    write_latest(stream(), out, state).awaitTermination()
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream().schema)
    tidy = lambda df: sorted(map(repr, df.select("file", *detect.FOUND).collect()))
    assert tidy(read_latest(spark, out, ddl)) == tidy(scan(rows.drop("at"), CONFIG))
    kinds = {r["type"] for r in read_latest(spark, out, ddl).collect()}
    assert kinds >= {"pattern", "entropy", "multiline-pattern"}


def test_a_more_severe_finding_replaces_an_earlier_one(spark, tmp_path):
    schema = "file string, content string"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rules = custom_rules([{"id": "low-one", "pattern": "zzz[0-9]{4}", "severity": "low"}, {"id": "high-one", "pattern": "zz[yz]9[0-9]{3}", "severity": "high"}])[0]
    stream = lambda: best_findings(spark.readStream.schema(schema).parquet(source), ScanConfig(rules=rules))
    said = []
    for text in ("zzz1234", "zzz9234", "zzz1111"):
        spark.createDataFrame([("a", text)], schema).write.mode("append").parquet(source)
        write_latest(stream(), out, state).awaitTermination()
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream().schema)
        said.append([(r["rule_id"], r["secret"]) for r in read_latest(spark, out, ddl).collect()])
    assert said == [[("low-one", "zzz1234")], [("high-one", "zzz9234")], [("high-one", "zzz9234")]]

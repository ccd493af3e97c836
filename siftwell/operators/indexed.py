"""Detection by many rules: what a line holds decides which rules it meets.

Every match of a rule holds one of its necessary literals, and that literal its rarest run of three characters. A line's runs, cut by one pass of a pattern,
are looked up in the index of runs; the few pairs of line and rule that are left are held against the whole literal and then against the pattern. So a line
costs the same whatever the number of rules, and the plan has one pattern column instead of thousands of expressions. Rules without a literal are held against every line.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.catalog import REFERENCE_CASE, Rule, necessary_literals
from siftwell.operators import detect

RUN = 3
#: The index is sent to every task; beyond so many rules it would be large.
MOST_RULES = 100_000


def index(rules: tuple[Rule, ...]) -> tuple[list[tuple[str, int, str, list[str]]], list[Rule]]:
    """(run, place of the rule, literal, the rule's literals before) and the rules that have no literal of three characters."""
    found: dict[int, list[str]] = {}
    always = []
    for i, rule in enumerate(rules):
        literals = sorted({x.lower() for x in necessary_literals(rule.pattern) or ()})
        if literals and min(map(len, literals)) >= RUN:
            found[i] = literals
        else:
            always.append(rule)
    runs = lambda x: {x[j : j + RUN] for j in range(len(x) - RUN + 1)}
    often = Counter(r for literals in found.values() for x in literals for r in runs(x))
    rarest = lambda x: min(runs(x), key=lambda r: (sum(c.isalpha() for c in r), often[r], r))
    return [(rarest(x), i, x, literals[:j]) for i, literals in found.items() for j, x in enumerate(literals)], always


def indexed_findings(lines: DataFrame, rules: tuple[Rule, ...], case_mode: str = REFERENCE_CASE, emit_pass: int = detect.PASS_PATTERN) -> DataFrame:
    """Of windows (key columns, line_number, line, shift): every match of every rule, as ``detect.pattern_findings`` gives them."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in one pack")
    rows, always = index(rules)
    spark = lines.sparkSession
    keys = [c for c in lines.columns if c not in ("line", "shift")]
    own = [(run, x, before, r.ord, r.id, r.name, r.severity, r.java(case_mode), r.group) for run, i, x, before in rows for r in (rules[i],)]
    table = spark.createDataFrame(own, "_run string, _literal string, _before array<string>, _ord int, rule_id string, rule_name string, severity string, _pattern string, _group int")
    low = F.lower("line")
    run = F.array_distinct(F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{RUN}}}))"), F.lit(1)))
    met = lines.withColumn("_low", low).select(*keys, "line", "shift", "_low", F.explode(run).alias("_run"))
    met = met.join(F.broadcast(table), "_run")
    met = met.filter(F.col("_low").contains(F.col("_literal")) & ~F.exists("_before", lambda x: F.contains(F.col("_low"), x)))
    met = met.filter(F.rlike(F.col("line"), F.col("_pattern"))).withColumn("m", F.explode(detect.occurrences(F.col("line"), F.col("_pattern"), F.col("_group"))))
    found = met.select(
        *keys, "rule_id", "rule_name", "severity", F.lit("pattern").alias("type"), F.col("m.match"), F.col("m.secret"), (F.col("m.start") + F.col("shift")).alias("match_start"),
        F.length("m.match").alias("match_length"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("multiline"),
        F.lit(emit_pass).alias("emit_pass"), F.col("shift").alias("emit_shift"), F.col("_ord").alias("emit_rule"), F.col("m.number").alias("emit_match"),
    )
    return found.unionByName(detect.pattern_findings(lines, tuple(always), case_mode, emit_pass)) if always else found

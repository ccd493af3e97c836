"""Detection: patterns and entropy over lines.

Lines x patterns is no join. A search for necessary literals lets through the few lines that any
pattern can match; those are held against the patterns whose literals they hold, and only (line, rule) pairs that hit are extracted,
with offsets summed from the pieces between matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text as T
from siftwell.functions.catalog import DECLARED_CASE, ENTROPY_RULE, PATTERN_RULES, REFERENCE_CASE, Rule, necessary_literals

QUOTED = "\"[^'\"`\\n]{20,}\"|'[^'\"`\\n]{20,}'|`[^'\"`\\n]{20,}`"
PASS_MULTILINE, PASS_PATTERN, PASS_CUSTOM, PASS_ENTROPY = 0, 1, 2, 3
FOUND = ("rule_id", "rule_name", "severity", "type", "line_number", "match", "secret", "match_start", "match_length", "entropy", "multiline")
ORDER = ("emit_shift", "emit_pass", "emit_rule", "emit_match")


def constants(values: Sequence[tuple[int, object]], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values for x in pair]), key)


def occurrences(line: Column, pattern: Column, group: Column | None = None) -> Column:
    """Array of (number, match, secret, start) of the non-overlapping matches; without a group the secret is the match. One pass over the matches, each with the piece before it."""
    whole = F.regexp_extract_all(line, pattern, F.lit(0))
    inner = [F.regexp_extract_all(line, pattern, group).alias("inner")] if group is not None else []
    pieces = F.arrays_zip(whole.alias("whole"), *inner, F.split(line, pattern, -1).alias("gap"))  # the last gap has no match behind it

    def add(so_far: Column, x: Column) -> Column:
        start, match = so_far["at"] + F.length(x["gap"]), x["whole"]
        secret = match if group is None else F.when(x["inner"] == "", match).otherwise(x["inner"])
        one = F.struct(F.size(so_far["found"]).alias("number"), match.alias("match"), secret.alias("secret"), start.alias("start"))
        return F.when(match.isNull(), so_far).otherwise(F.struct((start + F.length(match)).alias("at"), F.array_append(so_far["found"], one).alias("found")))

    none = F.array().cast("array<struct<number:int,match:string,secret:string,start:int>>")
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda x: x["found"])


def holds_any(line: Column, literals: Iterable[str]) -> Column:
    """Whether a line holds one of the literals. Those with a sign (the rarest that they share) are only looked for in lines with that sign."""
    least = [x for x in set(literals) if not any(y != x and y in x for y in literals)]
    signs = Counter(c for x in least for c in set(x) if not c.isalnum())
    by_sign: dict[str, list[str]] = {}
    for x in sorted(least):
        by_sign.setdefault(max((c for c in set(x) if c in signs), key=lambda c: (signs[c], c), default=""), []).append(x)
    any_of = lambda xs: reduce(or_, (F.contains(line, F.lit(x)) for x in xs))
    return reduce(or_, (any_of(xs) if sign in ("", *xs) else F.contains(line, F.lit(sign)) & any_of(xs) for sign, xs in sorted(by_sign.items())))


def pattern_findings(lines: DataFrame, rules: tuple[Rule, ...] = PATTERN_RULES, case_mode: str = REFERENCE_CASE, emit_pass: int = PASS_PATTERN) -> DataFrame:
    """Of windows (key columns, line_number, line, shift): every match of every rule."""
    if not rules:
        return pattern_findings(lines.filter(F.lit(False)), PATTERN_RULES[:1])
    keys = [c for c in lines.columns if c not in ("line", "shift")]
    own = lambda f: constants([(r.ord, f(r)) for r in rules], F.col("rule_ord"))
    literals = {r: necessary_literals(r.pattern) for r in rules}
    # with declared flags a rule may take either case; what has the literal in lower case is then enough to look at
    fold = case_mode == DECLARED_CASE
    line = F.lower("line") if fold else F.col("line")
    pairs = sorted({(x.lower() if fold else x, r.ord) for r, found in literals.items() for x in found or ()})
    always = [r for r in rules if not literals[r]]
    if not always:
        lines = lines.filter(holds_any(line, {x for x, _ in pairs}))
    held = F.filter(F.array(*(F.struct(F.lit(x).alias("literal"), F.lit(o).alias("ord")) for x, o in pairs)), lambda p: F.contains(line, p["literal"])) if pairs else None
    ords = [F.array_distinct(F.transform(held, lambda p: p["ord"]))] if pairs else []
    ords += [F.array_compact(F.array(*(F.when(F.col("line").rlike(r.java(case_mode)), F.lit(r.ord)) for r in always)))] if always else []
    rows = lines.withColumn("rule_ord", F.explode(F.concat(*ords))).filter(F.rlike(F.col("line"), own(lambda r: r.java(case_mode))))
    found = occurrences(F.col("line"), own(lambda r: r.java(case_mode)), own(lambda r: r.group))
    rows = rows.withColumn("m", F.explode(found))
    return rows.select(
        *keys, own(lambda r: r.id).alias("rule_id"), own(lambda r: r.name).alias("rule_name"), own(lambda r: r.severity).alias("severity"),
        F.lit("pattern").alias("type"), F.col("m.match"), F.col("m.secret"), (F.col("m.start") + F.col("shift")).alias("match_start"),
        F.length("m.match").alias("match_length"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("multiline"),
        F.lit(emit_pass).alias("emit_pass"), F.col("shift").alias("emit_shift"), F.col("rule_ord").alias("emit_rule"), F.col("m.number").alias("emit_match"),
    )


def entropy_candidates(lines: DataFrame) -> DataFrame:
    """Quoted strings of at least 20 characters: text (inside the quotes), start and chars (with them)."""
    keys = [c for c in lines.columns if c not in ("line",)]
    rows = lines.filter(F.col("line").rlike(QUOTED)).withColumn("m", F.explode(occurrences(F.col("line"), F.lit(QUOTED))))
    n = F.length("m.match")
    return rows.select(*keys, F.substring(F.col("m.match"), F.lit(2), n - 2).alias("text"), F.col("m.start").alias("start"), n.alias("chars"), F.col("m.number").alias("number"))


def entropy_findings(lines: DataFrame, threshold: Column) -> DataFrame:
    keys = [c for c in lines.columns if c not in ("line", "shift")]
    rows = entropy_candidates(lines).filter(T.should_scan_for_entropy(F.col("text")))
    rows = rows.withColumn("h", T.shannon_entropy(F.col("text"))).filter(F.col("h") >= threshold)
    r = ENTROPY_RULE
    return rows.select(
        *keys, F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.lit("entropy").alias("type"),
        F.col("text").alias("match"), F.col("text").alias("secret"), (F.col("start") + F.col("shift")).alias("match_start"), F.col("chars").alias("match_length"),
        F.col("h").alias("entropy"), F.lit(False).alias("multiline"), F.lit(PASS_ENTROPY).alias("emit_pass"), F.col("shift").alias("emit_shift"),
        F.lit(r.ord).alias("emit_rule"), F.col("number").alias("emit_match"),
    )


def dedup(findings: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Of findings on the same span, the most severe; of equals, the first emitted. Findings across lines have no span and so leave
    one a line."""
    span = Window.partitionBy(*keys, "line_number", "match_start", "match_length").orderBy(T.severity_rank(F.col("severity")).desc(), *ORDER)
    return findings.withColumn("rank", F.row_number().over(span)).filter("rank = 1").drop("rank")

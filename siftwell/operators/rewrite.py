"""Rewrite plans: what each line would become if its secret moved to the environment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text as T
from siftwell.operators.enrich import dimension

REMOVED = "# REMOVED"


def _splice(line: Column, old: Column, new: Column) -> Column:
    """The first occurrence only, with no meaning of special characters."""
    at = F.instr(line, old)
    return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), new, F.substring(line, at + F.length(old), F.length(line))))


def enclosing(line: Column, secret: Column, quote: str) -> Column:
    """The whole quoted literal that the secret is a part of."""
    plain = F.replace(secret, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit(f"{quote}([^{quote}]*\\Q"), plain, F.lit(f"\\E[^{quote}]*){quote}"))
    return F.regexp_substr(line, pattern)


def rewrite_line(line: Column, secret: Column, language: Column, ref: Column) -> Column:
    new = F.when(language == "yaml", F.concat(F.lit('"'), ref, F.lit('"'))).otherwise(ref)
    whole = [_splice(line, F.concat(F.lit(q), secret, F.lit(q)), new) for q in ('"', "'")]
    part = [_splice(line, enclosing(line, secret, q), new) for q in ('"', "'")]
    return F.coalesce(*whole, *part, _splice(line, secret, ref))


def rewrite_dockerfile(line: Column, secret: Column) -> Column:
    name = r"^(\s*)ENV\s+(\w+)[= ].*"
    return F.when(line.rlike(r"^\s*ENV\s+\w+[= ]"), F.regexp_replace(line, name, "$1ARG $2")).otherwise(_splice(line, secret, F.lit(REMOVED)))


def rewritten(line: Column, secret: Column, language: Column, ref: Column) -> Column:
    """The line with its secret moved to the environment; null if nothing is to be done. JSON is taken out, not rewritten."""
    return F.when(language == "json", line).when(language == "dockerfile", rewrite_dockerfile(line, secret)).otherwise(rewrite_line(line, secret, language, ref))


def fix_plan(findings: DataFrame) -> DataFrame:
    """findings: file, line_number, line, secret, rule_id. One row each: language, var_name, before, after (as if it were alone in its line),
    step: lines of a file from the bottom up; and what rewrite_files takes besides."""
    known = dimension(findings.sparkSession).select("rule_id", F.col("env_var").alias("known"))
    rows = findings.join(F.broadcast(known), "rule_id", "left")
    rows = rows.withColumn("language", T.detect_language(F.col("file")))
    rows = rows.withColumn("var_name", T.env_var_name(F.col("known"), F.col("line"), F.col("rule_id")))
    rows = rows.withColumn("ref", T.env_var_ref(F.col("language"), F.col("var_name")))
    order = Window.partitionBy("file").orderBy(F.col("line_number").desc(), "rule_id", "secret")
    rows = rows.withColumn("step", F.row_number().over(order))
    after = rewritten(F.col("line"), F.col("secret"), F.col("language"), F.col("ref"))
    return rows.select("file", "line_number", "rule_id", "language", "var_name", F.col("line").alias("before"), after.alias("after"), "step", "secret", "ref")


def env_upserts(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted and existing: name, value. action: existing, conflict (under a new name) or added, and the line to write."""
    old = existing.select("name", F.regexp_replace(F.trim("value"), "^(?:\"(.*)\"|'(.*)')$", "$1$2").alias("old"))
    rows = wanted.select("name", "value").distinct().join(old, "name", "left")
    same, clash = F.col("old") == F.col("value"), F.col("old").isNotNull()
    escaped = F.col("value")
    for a in ("\\", '"', "$"):
        escaped = F.replace(escaped, F.lit(a), F.lit("\\" + a))
    quoted = F.when(F.col("value").rlike(r"[\s#\"'$\\`]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.col("value"))
    name = F.when(clash & ~same, F.concat("name", F.lit("_NEW"))).otherwise(F.col("name"))
    return rows.select(
        F.when(same, "existing").when(clash, "conflict").otherwise("added").alias("action"), name.alias("name"),
        F.when(same, None).when(clash, F.concat(name, F.lit("="), F.col("value"))).otherwise(F.concat(name, F.lit("="), quoted)).alias("line"),
    )


def _insert(lines: Column, at: Column, *new: str) -> Column:
    """``new`` after the first ``at`` lines."""
    rest = F.slice(lines, at + 1, F.size(lines))
    return F.concat(F.slice(lines, F.lit(1), at), F.array(*map(F.lit, new)), rest)


def _first(lines: Column, pattern: str) -> Column:
    """Number of the first line that the pattern finds, 0 if none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True), F.lit(0)).cast("int")


def _head(lines: Column, second: str) -> Column:
    """Lines that stay on top: an interpreter line, then one that ``second`` finds."""
    line = lambda at: F.coalesce(F.get(lines, at), F.lit(""))
    shebang = line(F.lit(0)).startswith("#!").cast("int")
    return shebang + line(shebang).rlike(second).cast("int")


def ensure_import(lines: Column, language: Column, dotenv: Column) -> Column:
    """``lines`` with the import that reading the environment takes, if it isn't there. ``dotenv``: whether the package's modules are
    ``module`` or ``commonjs``; null if dotenv is no dependency, then scripts stay as they are."""
    python = F.when(_first(lines, r"^(import|from)\s+os(?![A-Za-z0-9_])") > 0, lines).otherwise(_insert(lines, _head(lines, "^#.*coding"), "import os"))
    block, single, package = _first(lines, r"^import\s*\("), _first(lines, r'^import\s+"[^"]+"'), _first(lines, r"^package\s+")
    old = F.regexp_extract(F.get(lines, single - 1), r'"([^"]+)"', 1)
    grown = F.array(F.lit("import ("), F.concat(F.lit('\t"'), old, F.lit('"')), F.lit('\t"os"'), F.lit(")"))
    go = (
        F.when(_first(lines, '"os"') > 0, lines).when(block > 0, _insert(lines, block, '\t"os"'))
        .when(single > 0, F.concat(F.slice(lines, F.lit(1), single - 1), grown, F.slice(lines, single + 1, F.size(lines))))
        .otherwise(_insert(lines, package, "", 'import "os"'))
    )
    head = _head(lines, "['\"]use strict['\"]")
    loads = F.when(dotenv == "module", _insert(lines, head, "import 'dotenv/config';")).otherwise(_insert(lines, head, "require('dotenv').config();"))
    script = F.when(dotenv.isNull() | (_first(lines, r"(require\s*\(|import)\s*['\"]dotenv") > 0), lines).otherwise(loads)
    return F.when(language == "python", python).when(language == "go", go).when(language == "javascript", script).otherwise(lines)


def rewrite_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """file and content of the files in ``plan`` (see fix_plan), with its lines rewritten and imports added. ``files``: file, content,
    dotenv (see ensure_import). The secrets of one line are moved one after another, each in what the one before has left."""
    done = F.aggregate(
        F.array_sort(F.collect_list(F.struct("step", "secret", "ref"))), F.first("before"),
        lambda line, s: F.coalesce(rewritten(line, s["secret"], F.col("language"), s["ref"]), line),
    )
    lines = plan.groupBy("file", "language", "line_number").agg(done.alias("after"), F.bool_or(F.col("after").isNotNull()).alias("any"))
    change = F.struct(F.col("line_number").cast("int").alias("line_number"), "after")
    changes = lines.filter("any").groupBy("file", "language").agg(F.map_from_entries(F.collect_list(change)).alias("changes"))
    rows = files.join(changes, "file")
    new = F.transform(F.split("content", "\n", -1), lambda x, i: F.coalesce(F.col("changes")[i + 1], x))
    return rows.select("file", F.array_join(ensure_import(new, F.col("language"), F.col("dotenv")), "\n").alias("content"))


def env_example(existing: str | None, names: list[str]) -> str:
    """The example file with a placeholder for each name that it lacks; a name that a conflict gave ``_NEW`` counts without it."""
    text = "# Copy to .env and fill in real values\n\n" if existing is None else existing
    text += "\n" if text and not text.endswith("\n") else ""
    held = set(re.findall(r"^([A-Z0-9_]+)=", text, re.MULTILINE))
    return text + "".join(f"{n}=\n" for n in dict.fromkeys(n.removesuffix("_NEW") for n in names) if n not in held)


def gitignore(existing: str) -> str:
    """The ignore file with a line for .env."""
    if any(line.strip() == ".env" for line in existing.split("\n")):
        return existing
    return existing + ("\n" if existing and not existing.endswith("\n") else "") + ".env\n"

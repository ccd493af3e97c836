"""Small fixed tables for queries that the driver's tables don't exercise. Secret-shaped strings are made at run time
from the patterns, so none stands in the code."""

from __future__ import annotations

import hashlib
import json
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions.catalog import PATTERN_RULES
from siftwell.sources import audit_log


def sample(pattern: str) -> str:
    """A string that the pattern matches."""

    def member(items: list) -> str:
        op, arg = items[0]
        if op is sre.NEGATE:
            return "x"
        if op is sre.RANGE:
            return chr(arg[0] + 1)
        if op is sre.CATEGORY:
            return {sre.CATEGORY_DIGIT: "7", sre.CATEGORY_SPACE: " "}.get(arg, "x")
        return chr(arg)

    def of(tree) -> str:
        out = ""
        for op, arg in tree:
            if op is sre.LITERAL:
                out += chr(arg)
            elif op is sre.IN:
                out += member(arg)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                out += of(arg[2]) * max(arg[0], 1)
            elif op is sre.BRANCH:
                out += of(arg[1][0])
            elif op is sre.SUBPATTERN:
                out += of(arg[3])
            elif op in (sre.ANY, sre.NOT_LITERAL):
                out += "x"
        return out

    return of(parser.parse(pattern))


def rule_lines() -> list[tuple[int, str]]:
    """(line_number, line): each rule's sample bare, twice in a line, and quoted."""
    out = []
    for rule in PATTERN_RULES:
        s = sample(rule.pattern)
        out += [s, f"a {s} b {s} c", f"x = '{s}'"]
    return list(enumerate(out, 1))


_aws = sample(r"AKIA[0-9A-Z]{16}")
_pat = sample(r"ghp_[A-Za-z0-9_]{20,}")
_blob = "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MEFCQ0RFRkdISUpLTE1OT1BR"

def _chain() -> list[str]:
    """Lines of a log: sound ones, one of an earlier version, a malformed one, a count and a link that were tampered with."""
    lines, last = [], None
    for i in range(12):
        at = f"2024-01-{i + 1:02}T00:00:00.000Z"
        findings = [{"ruleId": "npm-token", "severity": "high", "file": f"f{i}.js", "match": "npm_abcdefghijkl"}] * (i % 3)
        line = audit_log.chained({"timestamp": at, "version": "1.0.0" if i % 2 else None, "filesScanned": [f"f{i}.js"], "findings": findings, "userDecision": 'said "so"', "exposure": {"a": 1} if i == 4 else None}, last)
        if i == 5:  # as earlier versions wrote it
            old = {k: v for k, v in json.loads(line).items() if k in audit_log.HASHED_BEFORE}
            text = json.dumps(old, separators=(",", ":"))
            line = f'{text[:-1]},"hash":"{hashlib.sha256(text.encode()).hexdigest()}"}}'
        last = json.loads(line)["hash"]
        if i == 7:
            line = line.replace('"findingCount":1', '"findingCount":0')
        if i == 9:
            last = "0" * 64
        lines.append(line)
        if i == 3:
            lines.append('{"timestamp":"2024-01-04T12:00')
    return lines


FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "paths": ("id bigint, path string", list(enumerate([
        "src/app.js", "src/app.min.js", ".env", ".env.local", "config/app.yml", "a/b/c.properties", "web/site.bundle.css", "Dockerfile", "x/Dockerfile.dev",
        "main.py", "cmd/main.go", "test/fixture.js", "test/keep.js", "node_modules/a/b.js", "top.min.js", "deep/top.min.js", "infra/main.tf", "data.json", "README", ".hidden",
    ]))),
    "files": ("file string, content string, size bigint", [
        ("src/a.js", "let a = 1", 9), ("big.txt", "x", 3 << 20), ("bin.dat", "ab\x1ac", 4), ("test/fixture.js", "y", 1), ("test/keep.js", "", 0),
    ]),
    "findings": ("file string, line_number int, rule_id string, severity string, match_start int, match_length int, emit int", [
        ("a", 1, "clerk-secret-key", "high", 4, 38, 2), ("a", 1, "stripe-live-secret", "critical", 4, 38, 1), ("a", 1, "secret-assignment", "high", 0, 42, 3),
        ("a", 2, "jwt-token", "high", 0, 90, 1), ("a", 2, "supabase-key", "critical", 0, 90, 2), ("b", 1, "aws-access-key-id", "critical", None, None, 1),
        ("b", 1, "github-pat", "critical", None, None, 2), ("b", 3, "docker-token", "medium", 5, 20, 1), ("b", 3, "npm-token", "medium", 5, 20, 2),
    ]),
    "comments": ("id bigint, line string", list(enumerate([
        "k = 1 // scan-ignore", "k = 1 /* scan-ignore */", "k = 1 // scan-ignore: test value", "k = 1 # scan-ignore", "// scan-ignore k = 1", "k = 1 //scan-ignore  ", "plain",
        "get https://host/scan-ignore", "x * scan-ignore", "k = 1 // scan-ignore: takes a*b", "k = 1 /* scan-ignore: why */ ", "k = 1 // scan-ignore:", "k = 1 /*scan-ignore", "k = 1 // scan-ignored",
    ]))),
    "sources": ("file string, content string", [
        ("a.js", f'const k = "{_aws[:6]}" + "{_aws[6:]}";\nlet t = `{_pat} ${{x}}`;\nnone'), ("b.pem", "secret =\n" + f"{_blob}\n" * 3 + "end"),
        ("c.js", "const s = 'hello there ' + 'general audience';\nlet u = `plain words in a template`;"), ("d.txt", f"{_blob}\n{_blob}\nshort\n  {_blob}\n{_blob}  \n{_blob}"),
        ("e.js", f"let a = `{_pat[:9]}\n{_pat[9:]} and more`; let b = `{_aws} padded to length`;\nsecret:\n{_blob}\n{_blob}\n{_blob}\n"),
        ("f.env", f"A_TOKEN={_blob[:30]}\n// scan-ignore\nB = '{_aws}' // scan-ignore: a test\nC = '{_aws}'"), ("skip/g.js", f"k = '{_aws}'"),
    ]),
    "commits": ("commit_hash string, committed_at string, diff string, author string, subject string, is_remote boolean", [
        ("c1", "2024-01-03T00:00:00Z", "\n".join([
            "diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -1,2 +1,3 @@", " keep", f'+key = "{_aws}"', "-old", "+plain", "@@ -10,1 +11,2 @@", " ctx", f"+{_pat}", "\\ No newline at end of file",
        ]), "a@h", "Add x", False),
        ("c2", "2024-01-02T00:00:00Z", "\n".join([
            "diff --git a/img.png b/img.png", "Binary files a/img.png and b/img.png differ", "diff --git a/y.js b/y.js", "--- /dev/null", "+++ b/y.js", "@@ -0,0 +1,2 @@", "+one", f"+let k = '{_aws}'",
        ]), "b@h", "Add y", True),
        ("c3", "2024-01-01T00:00:00Z", "\n".join(["diff --git a/z b/z", "--- a/z", "+++ /dev/null", "@@ -1,1 +0,0 @@", "-gone"]), "a@h", "Drop z", True),
    ]),
    "audit": ("idx bigint, timestamp string, commitHash string, files string, findingCount bigint, critical bigint, high bigint, medium bigint, low bigint, userDecision string, action string, previousHash string, hash string", [
        (1, "2024-01-01T00:00:00Z", "aaa", "x.js;y.js", 2, 1, 1, 0, 0, "blocked", "none", None, "h1"), (2, "2024-01-02T00:00:00Z", "bbb", "a,b.js", 0, 0, 0, 0, 0, "passed", "none", "h1", "h2"),
        (3, "2024-01-03T00:00:00Z", "=cmd", "z.js", 3, 0, 1, 1, 1, "bypassed", "fixed", "h2", "h3"), (4, "2024-02-03T00:00:00Z", "ddd", "z.js", 1, 1, 0, 0, 0, "bypassed", "ignored", "hX", "h4"),
    ]),
    "exposure": ("id bigint, is_repo boolean, staged boolean, in_any_commit boolean, in_remote boolean, secret string, secret_in_any boolean, secret_in_remote boolean", [
        (1, False, False, False, False, "abcdefghij", False, False), (2, True, True, False, False, "abcdefghij", False, False), (3, True, False, True, False, "abcdefghij", True, False),
        (4, True, False, True, True, "abcdefghij", True, True), (5, True, True, False, False, "short", False, False), (6, True, False, True, True, "short", True, True), (7, True, False, True, False, "short", False, False),
    ]),
    "verified": ("id bigint, rule_id string, secret string, severity string, status string, age_minutes bigint", [
        (1, "github-pat", "s1", "high", "live", 5), (2, "github-pat", "s2", "critical", "inactive", 5), (3, "github-pat", "s3", "high", "live", 90), (4, "npm-token", "s4", "high", "unknown", 1), (5, "npm-token", "s5", "medium", None, None),
    ]),
    "fixes": ("file string, line_number bigint, line string, secret string, rule_id string", [
        ("a.js", 3, 'const apiKey = "s3cretValue";', "s3cretValue", "api-key-assignment"), ("a.js", 9, "x('s3cretValue', 's3cretValue')", "s3cretValue", "github-pat"), ("m.py", 1, 'URL = "postgres://u:pw@h/db"', "postgres://u:pw@h", "postgres-uri"),
        ("c.yml", 2, 'token: "abc$&def"', "abc$&def", "token-assignment"), ("c.yaml", 5, "key: bareword123", "bareword123", "npm-token"), ("main.tf", 4, 'k = "zzz"', "zzz", "aws-access-key-id"), ("Dockerfile", 1, "ENV TOKEN=abcabcabc", "abcabcabc", "token-assignment"),
        ("Dockerfile", 2, "RUN login abcabcabc", "abcabcabc", "token-assignment"), ("p.json", 1, '{"k": "zzz"}', "zzz", "npm-token"), ("s.go", 7, 'k := "zzz"', "zzz", "cursor-api-key"), ("r.rb", 1, "K = 'zzz'", "zzz", "npm-token"), ("J.java", 1, 'String k = "zzz";', "zzz", "npm-token"),
    ]),
    "wanted": ("name string, value string", [("A", "1"), ("B", "two"), ("C", 'needs "quotes" $x'), ("D", "plain")]),
    "existing": ("name string, value string", [("A", "1"), ("B", '"other"'), ("Z", "9")]),
    "scalars": ("id bigint, n bigint, slug string, version string, other string, seconds bigint, cell string", [
        (1, 512, "secrets-aws_cloud", "1.2.10", "1.2.9", 5, "=1+1"), (2, 2048, "pii-us", "2.0.0", "10.0.0", 125, "a,b"), (3, 1572864, "x", "1.0.0", "1.0.0", 7200, "plain"), (4, 3 << 30, "api-KEY-v2", "0.9", "0.8.9", 86400, "-3,4"), (5, 1024, "", "3.1.4", "3.1.3", 259200, "<a & \"b\">"),
    ]),
    "modules": ("id bigint, language string, dotenv string, content string", list((i, *m) for i, m in enumerate([
        ("python", None, "import sys\nx = 1"), ("python", None, "#!/usr/bin/env python\n# -*- coding: utf-8 -*-\nx = 1"), ("python", None, "import sys\nfrom os import path"), ("python", None, "import oslo"),
        ("go", None, 'package main\n\nimport (\n\t"fmt"\n)\nfunc f() {}'), ("go", None, 'package main\nimport "fmt"\nvar x = 1'), ("go", None, "package main\nvar x = 1"), ("go", None, 'package a\nimport "os"'),
        ("javascript", "commonjs", "'use strict';\nlet a = 1"), ("javascript", "module", "#!/usr/bin/env node\nlet a = 1"), ("javascript", "module", "import 'dotenv/config';\nlet a"), ("javascript", None, "let a = 1"), ("ruby", None, "x = 1"),
    ]))),
    "leaks": ("id bigint, file string, secret string", [
        (1, "x.py", _aws), (2, "y.js", _aws), (3, "x.py", "plain"), (4, "x.py", "not in there"), (5, "none.js", "abcdefghij"), (6, "none.js", "short"), (7, "y.js", "one"), (8, "x.py", _pat), (9, "y.js", _pat), (10, "y.js", "one" * 80),
    ]),
    "pack_rules": ("position bigint, id string, severity string, category string, confidence double, detection_rate double, false_positive_rate double", [
        (i, f"rule-{i:02}", ("critical", "high", "low")[i % 3], f"c{i % 5}", 0.5 + (i * 7 % 12) / 25, 0.9 - (i * 5 % 11) / 50, (i * 3 % 10) / 100) for i in range(24)
    ]),
    "fix_findings": ("file string, line_number bigint, line string, secret string, rule_id string", [
        (f"f{i}.js", i + 1, f"use('first{i}$1secret', 'second.{i}.secret') // {i}", s, r) for i in range(12) for s, r in ((f"first{i}$1secret", "cursor-api-key"), (f"second.{i}.secret", "onepassword-token"))
    ]),
    "fix_files": ("file string, content string, dotenv string", [(f"f{i}.js", "// line\n" * i + f"use('first{i}$1secret', 'second.{i}.secret') // {i}\nend", None) for i in range(12)]),
    "audit_lines": ("position bigint, value string", list(enumerate(_chain()))),
    "changes": ("file string, change_type string", [("a", "M"), ("b", "D"), ("zz", "A")]),
    "pack": ("id string, pattern string", [("aws-access-key-id", "zzz"), ("new-rule", "[q]{3}"), ("twin", "akia[0-9a-z]{16}"), ("other-rule", "w[0-9]{9}")]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = FIXTURES[name]
    return spark.createDataFrame(rows, ddl)


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def sql(name: str) -> str:
    """The same table as a DuckDB subquery."""
    ddl, rows = FIXTURES[name]
    columns = [c.split() for c in ddl.split(", ")]
    kinds = {"string": "varchar"}
    typed = ", ".join(f"{c}::{kinds.get(k, k)} as {c}" for c, k in columns)
    listed = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(select {typed} from (values {listed}) as v({', '.join(c for c, _ in columns)}))"

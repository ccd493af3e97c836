"""Scan settings and the ignore language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.catalog import REFERENCE_CASE, Rule
from siftwell.functions.dialect import to_java

DEFAULT_MAX_FILE_SIZE = 2 << 20
# Units of size literals; marker files of stacks; paths that a stack ignores.
SIZE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
STACK_MARKERS = {
    "package.json": "node", "requirements.txt": "python", "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "Gemfile": "ruby",
    "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", ".sln": "dotnet", ".csproj": "dotnet",
}
STACK_IGNORES = {
    "node": ("node_modules/**", "*.min.js", "*.bundle.js", "dist/**", "build/**", "coverage/**"),
    "python": ("venv/**", "__pycache__/**", ".tox/**", "*.pyc", ".eggs/**"),
    "go": ("vendor/**",), "ruby": ("vendor/bundle/**",), "rust": ("target/**",), "java": ("target/**", "build/**", "*.class"), "dotnet": ("bin/**", "obj/**"),
}


def parse_size(text: str | int | None) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]*)\s*", str(text if text is not None else "").lower())
    return int(float(m[1]) * SIZE_UNITS[m[2]]) if m and m[2] in SIZE_UNITS else DEFAULT_MAX_FILE_SIZE


def detect_stacks(names: list[str]) -> list[str]:
    """Stacks of a folder with files of these names."""
    return list(dict.fromkeys(stack for mark, stack in STACK_MARKERS.items() if any(n == mark or mark[0] == "." and n.endswith(mark) for n in names)))


def default_ignores(stacks: list[str]) -> list[str]:
    return [*dict.fromkeys(p for s in stacks for p in STACK_IGNORES.get(s, ())), ".git/**"]


def glob_to_regex(glob: str) -> str:
    """Anchored on the whole relative path; brackets are literal."""
    out, i, in_braces = "", 0, False
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.+/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "/" and i == len(glob) - 1:
            out, i = out + "(?:/.*)?", i + 1
        else:
            if c == "{" and "}" in glob[i:]:
                out, in_braces = out + "(?:", True
            elif c == "}" and in_braces:
                out, in_braces = out + ")", False
            elif c == "," and in_braces:
                out += "|"
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", c)
            i += 1
    return f"^{out}$"


@dataclass(frozen=True)
class IgnoreSpec:
    files: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, text: str) -> IgnoreSpec:
        files, negations, rules = [], [], []
        for line in (x.strip() for x in text.splitlines()):
            if not line or line.startswith("#"):
                continue
            if m := re.fullmatch(r"\[rule:([^\]]+)\]\s*(.+)", line):
                rules.append((m[1].strip(), glob_to_regex(m[2].strip())))
            elif line.startswith("!"):
                negations.append(glob_to_regex(line[1:].strip()))
            else:
                files.append(glob_to_regex(line))
        return cls(tuple(files), tuple(negations), tuple(rules))

    def ignores_file(self, path: Column) -> Column:
        """Order doesn't matter: a negation always keeps."""
        hit = lambda patterns: path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
        return hit(self.files) & ~hit(self.negations)

    def ignores_tree(self, path: Column) -> Column:
        """Whether a file or one of the folders that hold it is ignored: what is in an ignored folder isn't visited."""
        parts = F.split(path, "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        return F.exists(folders, self.ignores_file)

    def ignores_finding(self, rule_id: Column, path: Column) -> Column:
        out = F.lit(False)
        for own, pattern in self.rules:
            out = out | ((rule_id == own) & path.rlike(pattern))
        return out


@dataclass(frozen=True)
class ScanConfig:
    """``packs``: rules of packs (``rule_pack.load``), any number. ``ignore_marker``: the word of a trailing comment (``// word`` or ``/* word: reason */``) that silences its line; set
    it to the word that the files already use."""

    entropy_threshold: float | None = None
    max_file_size: int = DEFAULT_MAX_FILE_SIZE
    severity: dict[str, str] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    packs: tuple[Rule, ...] = ()
    ignore: IgnoreSpec = IgnoreSpec()
    ignore_marker: str = "scan-ignore"
    case_mode: str = REFERENCE_CASE
    multiline: bool = True

    def merge(self, other: dict) -> ScanConfig:
        """Shallow, but for severity, whose entries are joined. Values may be strings, as a config file has them."""
        new = dict(other)
        if "severity" in new:
            new["severity"] = {**self.severity, **new["severity"]}
        if "max_file_size" in new:
            new["max_file_size"] = parse_size(new["max_file_size"])
        if "entropy_threshold" in new:
            try:
                new["entropy_threshold"] = float(new["entropy_threshold"])
            except (TypeError, ValueError):
                del new["entropy_threshold"]
        if "rules" in new:
            new["rules"] = custom_rules(new["rules"])[0]
        known = {k: v for k, v in new.items() if k in self.__dataclass_fields__}
        return replace(self, **known)

    @property
    def inline_ignore(self) -> str:
        return rf"/[/*]\s*{re.escape(self.ignore_marker)}(?::\s*.+?)?\s*(?:\*/)?\s*\z"


def custom_rules(rows: list[dict]) -> tuple[tuple[Rule, ...], list[str]]:
    """Rules and what is wrong with those left out: no id or pattern, or a pattern that ``functions.dialect`` refuses."""
    out, wrong, seen = [], [], {}
    for row in rows:
        rule_id, pattern = row.get("id"), row.get("pattern")
        try:
            if not rule_id or not pattern:
                raise ValueError("id and pattern are needed")
            pattern = seen.setdefault(rule_id, pattern)  # a repeated id keeps the first pattern
            java, groups = to_java(pattern), re.compile(pattern).groups
        except ValueError as e:
            wrong.append(f"{rule_id or '?'}: {e}")
            continue
        out.append(Rule(1000 + len(out), rule_id, row.get("name") or rule_id, row.get("severity") or "medium", "Custom", "Custom", "-", min(1, groups), pattern, "custom", spark_pattern=java))
    return tuple(out), wrong

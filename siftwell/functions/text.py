"""Scalar functions as Column expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds by kind of file, and what makes a file of a kind.
THRESHOLD_CONFIG, THRESHOLD_SOURCE, THRESHOLD_MINIFIED, THRESHOLD_DIRECT = 4.5, 4.8, 5.0, 3.8
CONFIG_EXTENSIONS = (".env", ".yml", ".yaml", ".ini", ".cfg", ".conf", ".toml", ".properties", ".json", ".xml")
MINIFIED_ENDS = (".min.js", ".min.css", ".bundle.js", ".bundle.css")
SEVERITIES = ("critical", "high", "medium", "low")
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "javascript", ".tsx": "javascript",
    ".py": "python", ".go": "go", ".rb": "ruby", ".java": "java", ".yml": "yaml", ".yaml": "yaml", ".tf": "terraform", ".json": "json",
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot on; none if the name only starts with it."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1)


def shannon_entropy(text: Column) -> Column:
    """Bits a character, over distinct code points."""
    chars, n = F.split(text, ""), F.length(text).cast("double")

    def add(total: Column, ch: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == ch)) / n
        return total - p * F.log2(p)

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), add))


def entropy_rejections(s: Column) -> dict[str, Column]:
    """Reasons not to look at a string's entropy, by name."""
    slashes = F.length(s) - F.length(F.replace(s, F.lit("/"), F.lit("")))
    spaces = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    random_part = F.exists(
        F.split(s, "/"), lambda x: (F.length(x) >= 16) & x.rlike("[0-9]") & x.rlike(r"^[A-Za-z0-9+=._-]+\z")
    )
    lower_runs = F.length(F.array_join(F.regexp_extract_all(s, F.lit("[a-z]{3,}"), F.lit(0)), ""))
    return {
        "short": F.length(s) < 20,
        "url": s.startswith("http://") | s.startswith("https://"),
        "tag": s.startswith("<") & s.endswith(">"),
        "markup": s.contains("<!DOCTYPE") | s.contains("<?xml"),
        "code": s.contains("function ") | s.contains("class "),
        "interpolation": s.contains("${"),
        "uuid": s.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"),
        "path": (s.startswith("/") | s.contains("://")) & (slashes >= 2),
        "segments": (slashes >= 2) & ~random_part,
        "prose": spaces.cast("double") / F.length(s) > 0.15,
        "words": lower_runs > F.length(s) * F.lit(0.6).cast("double"),
    }


def should_scan_for_entropy(s: Column) -> Column:
    out = F.lit(True)
    for reason in entropy_rejections(s).values():
        out = out & ~F.coalesce(reason, F.lit(False))
    return out


def entropy_threshold(path: Column, configured: float | None = None) -> Column:
    name = basename(path)
    minified = F.lit(False)
    for end in MINIFIED_ENDS:
        minified = minified | name.endswith(end)
    config = extension(path).isin(*CONFIG_EXTENSIONS) | (name == ".env") | name.startswith(".env.")
    return F.when(minified, THRESHOLD_MINIFIED).when(config, THRESHOLD_CONFIG).otherwise(F.lit(float(configured or THRESHOLD_SOURCE)))


def redact(s: Column) -> Column:
    return F.when(F.length(s) <= 8, F.lit("****")).otherwise(F.concat(F.substring(s, 1, 4), F.lit("****"), F.right(s, F.lit(4))))


def redact_for_audit(s: Column) -> Column:
    return F.when(F.length(s) > 8, F.concat(F.substring(s, 1, 4), F.lit("****"))).otherwise("***")


def secret_hash(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 12)


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        scaled = F.regexp_replace(F.format_string("%.1f", n / float(1024**k)), r"\.0$", "")
        out = F.when(n >= 1024**k, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def title_case(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "[-_]"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), " ")


def detect_language(path: Column) -> Column:
    name, ext = basename(path), extension(path)
    out = F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile")
    for language in dict.fromkeys(LANGUAGES.values()):
        out = out.when(ext.isin(*(e for e, x in LANGUAGES.items() if x == language)), language)
    return out.otherwise("unknown")


def env_var_name(known: Column, line: Column, rule_id: Column) -> Column:
    named = F.regexp_extract(line, r"(?:const|let|var|export)\s+(\w+)\s*=", 1)
    snake = F.upper(F.regexp_replace(named, "([a-z])([A-Z])", "$1_$2"))
    return F.coalesce(known, F.when(named != "", snake), F.replace(F.upper(rule_id), F.lit("-"), F.lit("_")))


def env_var_ref(language: Column, name: Column) -> Column:
    form = lambda f: F.format_string(f, name)
    return (
        F.when(language == "python", form('os.environ["%s"]')).when(language == "go", form('os.Getenv("%s")'))
        .when(language == "ruby", form('ENV["%s"]')).when(language == "java", form('System.getenv("%s")'))
        .when(language == "yaml", form("${%s}")).when(language == "terraform", F.concat(F.lit("var."), F.lower(name)))
        .otherwise(form("process.env.%s"))
    )


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "low", "note").otherwise("warning")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def csv_cell(value: Column) -> Column:
    """Guarded against formulas, quoted if it holds a comma."""
    guarded = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(guarded.contains(","), F.concat(F.lit('"'), guarded, F.lit('"'))).otherwise(guarded)


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def days_ago(then: Column, now: Column) -> Column:
    return F.floor((F.unix_millis(now) - F.unix_millis(then)) / 86_400_000)


def relative_time(then: Column, now: Column) -> Column:
    sec = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 1000)
    minutes, hours = F.floor(sec / 60), F.floor(F.floor(sec / 60) / 60)
    days = F.floor(hours / 24)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(sec < 60, said(sec, " sec ago")).when(minutes < 60, said(minutes, " min ago")).when(hours < 24, said(hours, " hr ago"))
        .otherwise(F.concat(days.cast("string"), F.when(days == 1, " day ago").otherwise(" days ago")))
    )


def since(spec: str, now: Column) -> Column:
    """``7d``, ``2w`` or ``3m`` (calendar months) before ``now``."""
    n, unit = int(spec[:-1]), spec[-1]
    if unit == "m":
        return F.add_months(now, -n).cast("timestamp")
    return now - F.make_interval(days=F.lit(n if unit == "d" else 7 * n))


def is_newer(a: Column, b: Column) -> Column:
    parts = lambda v: F.transform(F.slice(F.split(v, r"\."), 1, 3), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return parts(a) > parts(b)


def jwt_project_ref(token: Column) -> Column:
    body = F.translate(F.element_at(F.split(token, r"\."), 2), "-_", "+/")
    padded = F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, F.lit("="))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.ref")


def seal(value: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def unseal(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")

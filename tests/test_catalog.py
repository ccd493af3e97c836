import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.functions.catalog import ENRICHMENT, PATTERN_RULES, RULES, necessary_literals, prefilter
from siftwell.plans.fixtures import sample
from siftwell.sources import rule_pack
from siftwell.sources.config import IgnoreSpec, ScanConfig, custom_rules, default_ignores, detect_stacks, glob_to_regex, parse_size


def test_counts():
    assert len(RULES) == 80 == len({r.id for r in RULES}) == len(ENRICHMENT)
    by = [sum(r.severity == s for r in RULES) for s in ("critical", "high", "medium", "low")]
    assert by == [38, 36, 4, 2]


def test_every_sample_matches_and_passes_the_prefilter():
    literals = re.compile(prefilter(PATTERN_RULES))
    for rule in PATTERN_RULES:
        s = sample(rule.pattern)
        assert re.search(rule.pattern, s), rule.id
        assert literals.search(s), rule.id
        assert any(x in s for x in necessary_literals(rule.pattern))


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(PATTERN_RULES), st.text(alphabet="aAkKsS-_=:. 'x\"0", max_size=12), st.text(alphabet="aA =", max_size=5))
def test_prefilter_never_loses_a_match(rule, before, after):
    text = before + sample(rule.pattern) + after
    if any(re.search(r.pattern, text) for r in PATTERN_RULES):
        assert re.search(prefilter(PATTERN_RULES), text)


def test_literals_that_cannot_be_proved():
    assert necessary_literals("[a-z]+") is None
    assert necessary_literals("(?:ab|[c-d])x?") is None
    assert necessary_literals("(?:abc|def)x?") == {"abc", "def"}


def test_globs():
    hit = lambda g, p: re.match(glob_to_regex(g), p) is not None
    assert hit("*.min.js", "a.min.js") and not hit("*.min.js", "d/a.min.js")
    assert hit("**/x.js", "x.js") and hit("**/x.js", "a/b/x.js")
    assert hit("test/**", "test/a/b") and not hit("test/**", "tests/a")
    assert hit("{a,b}.txt", "a.txt") and not hit("{a,b}.txt", "c.txt")
    assert hit("a?c", "abc") and not hit("a?c", "a/c") and hit("a[1].js", "a[1].js") and not hit("a.b", "axb")
    assert hit("dir/", "dir") and hit("dir/", "dir/x/y")


def test_ignore_file_parsing():
    spec = IgnoreSpec.parse("# c\n\ntest/**\n!test/a\n[rule:npm-token] src/**")
    assert len(spec.files) == len(spec.negations) == 1 and spec.rules[0][0] == "npm-token"


def test_config():
    assert [parse_size(x) for x in ("5MB", "1k", "10", "2 gb", "x", None)] == [5 << 20, 1024, 10, 2 << 30, 2 << 20, 2 << 20]
    c = ScanConfig(severity={"a": "low"}).merge({"severity": {"b": "high"}, "entropy_threshold": "4.2", "max_file_size": "1MB", "unknown": 1})
    assert c.severity == {"a": "low", "b": "high"} and c.entropy_threshold == 4.2 and c.max_file_size == 1 << 20
    good, wrong = custom_rules([{"id": "x", "pattern": "x{3}"}, {"id": "y"}, {"id": "z", "pattern": "("}, {"id": "e", "pattern": "a*"}])
    assert [r.id for r in good] == ["x"] and len(wrong) == 3 and good[0].severity == "medium"
    assert detect_stacks(["package.json", "a.csproj"]) == ["node", "dotnet"] and default_ignores(["go"]) == ["vendor/**", ".git/**"]


def test_packs():
    text = '[{"id": "npm-token", "pattern": "x"}, {"id": "n", "pattern": "AKIA[0-9A-Z]{16}"}, {"id": "new", "pattern": "q(w{4})", "category": "secrets-aws"}]'
    rules, said = rule_pack.load(text)
    assert [r.id for r in rules] == ["new"] and rules[0].group == 1 and rules[0].provider == "AWS" and said
    assert rule_pack.load(text, "bad", b"k")[0] == ()

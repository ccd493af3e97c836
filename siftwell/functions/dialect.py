"""Patterns of rules in the dialect that Spark's regular expressions have.

A rule is written for an engine in which ``\\s`` takes Unicode's blanks, ``\\d``, ``\\w`` and ``\\b`` take ASCII, ``$`` is the end of the text only and ``.`` leaves out line ends.
What would mean something else, or nothing, to Java is spelt out, so that a rule means the same wherever it runs.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

# What the classes hold.
SPACE = r"\t\n\x0B\f\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
DIGIT, WORD, LINE_ENDS = "0-9", "A-Za-z0-9_", r"\n\r\x{2028}\x{2029}"
_CATEGORIES = {
    sre.CATEGORY_DIGIT: (DIGIT, False), sre.CATEGORY_NOT_DIGIT: (DIGIT, True), sre.CATEGORY_SPACE: (SPACE, False), sre.CATEGORY_NOT_SPACE: (SPACE, True),
    sre.CATEGORY_WORD: (WORD, False), sre.CATEGORY_NOT_WORD: (WORD, True),
}
_BORDER = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
_NO_BORDER = f"(?:(?<![{WORD}])(?![{WORD}])|(?<=[{WORD}])(?=[{WORD}]))"
_ASCII = frozenset(map(chr, range(128)))
_OTHER = "\x80"  # stands for all that isn't ASCII


def _char(code: int) -> str:
    c = chr(code)
    if c.isascii() and (c.isalnum() or c == " "):
        return c
    return f"\\{c}" if c.isascii() and c.isprintable() else f"\\x{{{code:X}}}"


def _class(items: list) -> str:
    negated, parts, taken_out = False, "", []
    for op, arg in items:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            parts += _char(arg)
        elif op is sre.RANGE:
            parts += f"{_char(arg[0])}-{_char(arg[1])}"
        else:
            own, opposite = _CATEGORIES[arg]
            if opposite:
                taken_out.append(f"[^{own}]")
            else:
                parts += own
    choices = "|".join(([f"[{parts}]"] if parts else []) + taken_out)
    if not negated:
        return choices if len(taken_out) + bool(parts) == 1 else f"(?:{choices})"
    return f"[^{parts}]" if not taken_out else rf"(?:(?!{choices})[\x{{0}}-\x{{10FFFF}}])"


def _chars(op: object, arg: object) -> frozenset[str] | None:
    """The characters of an element that takes one character."""
    members: set[str] = set()
    if op is sre.LITERAL:
        return frozenset([chr(arg) if arg < 128 else _OTHER])
    if op is sre.NOT_LITERAL:
        return (_ASCII | {_OTHER}) - {chr(arg)}
    if op is sre.ANY:
        return (_ASCII | {_OTHER}) - {"\n", "\r"}
    if op is not sre.IN:
        return None
    for kind, x in arg:
        if kind is sre.LITERAL:
            members.add(chr(x) if x < 128 else _OTHER)
        elif kind is sre.RANGE:
            members |= {chr(c) for c in range(x[0], min(x[1], 127) + 1)} | ({_OTHER} if x[1] > 127 else set())
        elif kind is sre.CATEGORY:
            own, opposite = _CATEGORIES[x]
            found = {c for c in _ASCII if re.match(f"[{own.split(chr(92) + 'xA0')[0]}]", c)} | ({_OTHER} if own is SPACE else set())
            members |= (_ASCII | {_OTHER}) - found if opposite else found
    return frozenset((_ASCII | {_OTHER}) - members if arg[0][0] is sre.NEGATE else members)


_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT)


def _endless(tree: object) -> list[frozenset[str] | None]:
    """The characters of the repeats without an end within a tree."""
    out = []
    for op, arg in tree:
        if op in _REPEATS:
            if arg[1] is sre.MAXREPEAT:
                out.append(_chars(*arg[2][0]) if len(arg[2]) == 1 else None)
            out += _endless(arg[2])
        elif op is sre.SUBPATTERN:
            out += _endless(arg[3])
        elif op is sre.BRANCH:
            out += [x for branch in arg[1] for x in _endless(branch)]
    return out


def _flat(tree: object) -> list:
    return [y for op, arg in tree for y in (_flat(arg[3]) if op is sre.SUBPATTERN else [(op, arg)])]


def _refuse_blow_up(tree: object) -> None:
    """A repeat within a repeat is allowed if each round takes a character that the inner ones can't."""
    for op, arg in tree:
        if op in _REPEATS:
            inner = _endless(arg[2])
            if arg[1] is sre.MAXREPEAT and inner:
                marks = [c for x in _flat(arg[2]) if (c := _chars(*x)) is not None]
                if not any(all(r is not None and not (r & m) for r in inner) for m in marks):
                    raise ValueError("repeats within a repeat can go back without bound")
            _refuse_blow_up(arg[2])
        elif op is sre.SUBPATTERN:
            _refuse_blow_up(arg[3])
        elif op is sre.BRANCH:
            for branch in arg[1]:
                _refuse_blow_up(branch)
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            _refuse_blow_up(arg[1])


def _java(tree: object) -> str:
    out = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            out += _char(arg)
        elif op is sre.NOT_LITERAL:
            out += f"[^{_char(arg)}]"
        elif op is sre.ANY:
            out += f"[^{LINE_ENDS}]"
        elif op is sre.IN:
            out += _class(arg)
        elif op is sre.BRANCH:
            out += f"(?:{'|'.join(map(_java, arg[1]))})"
        elif op is sre.SUBPATTERN:
            number, on, off, inner = arg
            letters = lambda f: "".join(c for c, bit in (("i", re.I), ("s", re.S), ("m", re.M)) if f & bit)
            if (on | off) & ~re.I:
                raise ValueError("only the flag i can be set for a group")
            flags = letters(on) + (f"-{letters(off)}" if off else "")
            inner = _java(inner)
            out += f"({inner})" if number and not flags else f"((?{flags}:{inner}))" if number else f"(?{flags}:{inner})"
        elif op in (*_REPEATS, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            body = _java(inner)
            simple = len(inner) == 1 and inner[0][0] in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.SUBPATTERN) or body.startswith("[") and len(inner) == 1 and "|" not in body
            times = {(0, 1): "?", (0, sre.MAXREPEAT): "*", (1, sre.MAXREPEAT): "+"}.get((least, most)) or ("{%d}" % least if least == most else "{%d,%s}" % (least, "" if most is sre.MAXREPEAT else int(most)))
            out += (body if simple else f"(?:{body})") + times + {sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}.get(op, "")
        elif op is sre.AT:
            at = {sre.AT_BEGINNING: r"\A", sre.AT_BEGINNING_STRING: r"\A", sre.AT_END: r"\z", sre.AT_END_STRING: r"\z", sre.AT_BOUNDARY: _BORDER, sre.AT_NON_BOUNDARY: _NO_BORDER}
            out += at[arg]
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            out += f"(?{'<' if arg[0] < 0 else ''}{'=' if op is sre.ASSERT else '!'}{_java(arg[1])})"
        elif op is sre.GROUPREF:
            out += f"(?:\\{arg})"
        elif op is sre.ATOMIC_GROUP:
            out += f"(?>{_java(arg)})"
        else:
            raise ValueError(f"{str(op).lower()} isn't known to Spark's expressions")
    return out


def to_java(pattern: str) -> str:
    """The pattern for Spark. A ValueError says why it can't be used: it is malformed, can match nothing, can go back without bound, or has no counterpart."""
    try:
        tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError) as e:
        raise ValueError(str(e)) from e
    if tree.getwidth()[0] == 0:
        raise ValueError("it can match the empty string")
    flags = tree.state.flags & ~re.UNICODE
    if flags & ~(re.I | re.A):
        raise ValueError("of the flags only i can be set")
    _refuse_blow_up(tree)
    return ("(?i)" if flags & re.I else "") + _java(tree)

"""Text helpers that keep ECMAScript semantics inside Spark's Java regexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What `\s` covers in ECMAScript beyond Java's six ASCII characters.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
DOT = r"[^\n\r\u2028\u2029]"
_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def _is_word(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalnum())


def ecma(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    """Java regex that matches what `pattern` matches in ECMAScript.

    `\\s`, `\\b` and `.` differ: Java's `\\s` is ASCII only, its `\\b` looks at Unicode letters
    before JDK 19, and its `.` also stops at U+0085. A pattern that needs the end of the text
    writes `\\z`, because `$` would also match before a last line break.
    """
    out: list[str] = ["(?i)" if ignore_case else ""]
    in_class = False
    i = 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
            i += 2
        elif two == r"\b" and not in_class:
            follows, then = pattern[i + 2 : i + 3], pattern[i + 3 : i + 4]
            before = pattern[i - 1 : i] if pattern[i - 2 : i - 1] != "\\" else ""
            if _is_word(follows) and then not in ("*", "+", "?", "{"):
                # The letter comes first, so that a scan tests it and not two look-arounds.
                out.append(f"{follows}(?<!{_WORD}{follows})")
                i += 3
            else:
                out.append(f"(?!{_WORD})" if _is_word(before) else _EDGE)
                i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            c = pattern[i]
            if c == "[" and not in_class:
                in_class = True
            elif c == "]":
                in_class = False
            out.append(DOT if c == "." and not in_class and not dot_all else c)
            i += 1
    return "".join(out)


def split_lines(content: Column) -> Column:
    """Lines of a file: split at `\\n`, a trailing empty line stays, `\\r` stays on its line."""
    return F.split(content, "\n", -1)


def js_trim(text: Column) -> Column:
    """Strip Unicode white space from both ends; linear in the length of the text."""
    return F.regexp_replace(text, f"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\\z", "")


def js_trim_end(text: Column) -> Column:
    return F.regexp_replace(text, f"(?<![{SPACE}])[{SPACE}]++\\z", "")


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only (`pattern` without groups; `replacement` is plain text)."""
    plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"(?s)\\A(.*?)(?:{ecma(pattern)})", "$1" + plain)


def redact(line: Column) -> Column:
    """Blank out every quoted run of ten or more token characters."""
    return F.regexp_replace(line, r"""['"][A-Za-z0-9+/=_\-]{10,}['"]""", '"[REDACTED]"')


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out

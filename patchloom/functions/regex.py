"""Pattern text in the dialect Spark runs.

Patterns are written with ``\\w`` and ``\\s`` for one line of code.  Java reads
those two as ASCII only, rejects a bare ``{`` and lets a negated class run over
a line end.  ``spark_pattern`` spells the classes out (letters, digits and
blanks of all scripts), escapes braces and keeps every class inside its line,
so one text serves both a single line and a whole block of lines.
"""

from __future__ import annotations

import re
import warnings
from functools import cache

WORD = r"\p{L}\p{N}_"
BLANK = r" \t\x0b\f\r\x1c-\x1f\x85\p{Z}"  # every blank except the line feed


QUANTIFIER = re.compile(r"\{\d+(,\d*)?\}")


@cache
def spark_pattern(pattern: str) -> str:
    out, in_class, pos = [], False, 0
    while pos < len(pattern):
        pair = pattern[pos : pos + 2]
        if pair in (r"\p", r"\P") and pattern[pos + 2 : pos + 3] == "{":
            end = pattern.index("}", pos) + 1
            out.append(pattern[pos:end])
            pos = end
        elif not in_class and (counted := QUANTIFIER.match(pattern, pos)):
            out.append(counted.group())
            pos = counted.end()
        elif pair in (r"\w", r"\s"):
            members = WORD if pair == r"\w" else BLANK
            out.append(members if in_class else f"[{members}]")
            pos += 2
        elif pair[0] == "\\":
            out.append(pair)
            pos += 2
        elif not in_class and pair == "[^":
            out.append(r"[^\n")
            in_class, pos = True, pos + 2
        else:
            if not in_class and pair[0] in "{}":
                out.append("\\")
            in_class = pair[0] == "[" or (in_class and pair[0] != "]")
            out.append(pair[0])
            pos += 1
    return "".join(out)


@cache
def group_count(pattern: str) -> int:
    return re.compile(_SOURCES.get(pattern, pattern)).groups


class PatternError(ValueError):
    """A user pattern that Python's ``re`` rejects or that the engine's dialect can't express."""


#: Python constructs without a counterpart in the engine's dialect, and what they are.
REFUSED = {"(?(": "a conditional group", "(?a": "the ASCII flag", "(?L": "the locale flag", "\\N{": "a named character"}
#: Translated patterns and their Python sources, for counting groups.
_SOURCES: dict[str, str] = {}


def to_engine(pattern: str) -> str:
    """A Python ``re`` pattern in the dialect Spark runs, or ``PatternError`` saying why not.

    Named groups ``(?P<n>...)`` and ``(?P=n)`` become ``(?<n>...)`` and ``\\k<n>``;
    ``\\Z`` becomes ``\\z``; ``\\d`` and ``\\D`` take digits of all scripts, as in
    Python; ``{,n}`` becomes ``{0,n}``; inside a class a ``[`` and ``&&`` are plain
    characters, as in Python, and a leading ``]`` too.  ``\\w``, ``\\s`` and braces
    are then dealt with by ``spark_pattern``.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(pattern)
    except re.error as error:
        raise PatternError(f"{pattern!r} is no pattern: {error}") from None
    out, pos, in_class, class_start = [], 0, False, 0
    while pos < len(pattern):
        rest = pattern[pos:]
        if not in_class:
            for start, what in REFUSED.items():
                if rest.startswith(start):
                    raise PatternError(f"{pattern!r} holds {what}, which the engine can't run")
        if rest.startswith("\\"):
            pair = rest[:2]
            out.append({"\\Z": "\\z", "\\d": "\\p{Nd}", "\\D": "\\P{Nd}"}.get(pair, pair))
            pos += 2
        elif in_class:
            if rest[0] == "]" and pos > class_start:
                in_class = False
                out.append("]")
            elif rest[0] in "[]":
                out.append("\\" + rest[0])
            elif rest.startswith("&&"):
                out.append("\\&\\&")
                pos += 1
            else:
                out.append(rest[0])
            pos += 1
        elif rest.startswith("(?P<"):
            out.append("(?<")
            pos += 4
        elif rest.startswith("(?P="):
            end = pattern.index(")", pos)
            out.append(f"\\k<{pattern[pos + 4 : end]}>")
            pos = end + 1
        elif (upto := re.match(r"\{,(\d+)\}", rest)) is not None:
            out.append(f"{{0,{upto.group(1)}}}")
            pos += upto.end()
        elif rest[0] == "[":
            in_class = True
            negated = rest.startswith("[^")
            out.append(rest[: 2 if negated else 1])
            pos += 2 if negated else 1
            class_start = pos
        else:
            out.append(rest[0])
            pos += 1
    text = "".join(out)
    _SOURCES[text] = pattern
    return text


def whole_line_pattern(pattern: str) -> str:
    """Matches, inside a block of lines, each whole line the pattern starts on."""
    return "(?dm)" + spark_pattern(pattern) + r"[^\n]*"


def checked_patterns(patterns, spark) -> tuple[dict, dict]:
    """(patterns in the engine's dialect, {language: reason}) of user patterns.

    A language whose pattern Python rejects, that ``to_engine`` refuses, or that
    the JVM's regular expressions can't compile in the forms the plan uses is
    left out with its reason, so its files can be marked failed and all other
    files go on.
    """
    compile_java = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    good, refused = {}, {}
    for language, by_type in patterns.items():
        try:
            runnable = {}
            for element_type, pattern in by_type.items():
                text = to_engine(pattern)
                for form in (spark_pattern(text), whole_line_pattern(text)):
                    try:
                        compile_java(form)
                    except Exception as error:  # the JVM's message says what is wrong
                        raise PatternError(f"{pattern!r} does not compile: {str(error).splitlines()[0]}") from None
                runnable[element_type] = text
            good[language] = runnable
        except PatternError as error:
            refused[language] = str(error)
    return good, refused

"""The rules' regex dialect, checked and written as a Java pattern.

The dialect has no look-around, back-references, atomic groups or possessive
repetition, and its classes are Unicode.  A pattern outside it is invalid; a rule with
an invalid pattern never matches.

The dialect matches in linear time.  Java backtracks: on ``(a+)+b`` its time is exponential in
the text, and ``(a|b)*`` can exhaust a task's stack.  Patterns that may do so
(:func:`may_backtrack`) are matched by Arrow's automaton in batches (:func:`linear_pattern`);
all others stay in the JVM, where the time is at most polynomial.
"""

from __future__ import annotations

import re
import warnings

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Escapes of letters that mean the same in Java (with Unicode classes), and those written otherwise there.
_SAME = frozenset("dDsSwWbBAzafntrxpP")
_OTHER = {"v": r"\x0B"}
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}",
          "punct": r"\p{Punct}", "space": r"\s", "word": r"\w", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}",
          "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "ascii": r"\p{ASCII}"}


class InvalidPattern(ValueError):
    """A construct that the dialect does not have."""


def to_java(pattern: str, case_sensitive: bool = True) -> str:
    """The Java pattern; :class:`InvalidPattern` for what only Java knows.  Plain syntax errors are left to
    :func:`compiles`."""
    out, i, n = [], 0, len(pattern)
    quantified = False      # the last item was a repetition (a further one would be possessive in Java)
    depth = 0               # of character classes
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                raise InvalidPattern("escape at the end")
            e = pattern[i + 1]
            if e in "uU":
                width = 4 if e == "u" else 8
                if pattern[i + 2:i + 3] == "{":
                    end = pattern.find("}", i)
                    digits, step = pattern[i + 3:end], end + 1 - i
                else:
                    digits, step = pattern[i + 2:i + 2 + width], 2 + width
                if not digits or any(d not in "0123456789abcdefABCDEF" for d in digits):
                    raise InvalidPattern("bad code point")
                out.append(f"\\x{{{digits}}}")
                i += step
            elif e.isalnum() and e.isascii():
                if e in _OTHER:
                    out.append(_OTHER[e])
                elif e in _SAME:
                    out.append("\\" + e)
                else:
                    raise InvalidPattern(f"escape \\{e}")
                i += 2
            else:
                out.append("\\" + e)
                i += 2
            quantified = False
            continue
        if depth:
            if pattern.startswith("[:", i):
                end = pattern.find(":]", i)
                name = pattern[i + 2:end].lstrip("^") if end > 0 else ""
                if name in _POSIX:
                    out.append(f"[^{_POSIX[name]}]" if pattern[i + 2] == "^" else _POSIX[name])
                    i = end + 2
                    continue
            if pattern.startswith(("--", "~~"), i):
                raise InvalidPattern("class difference")
            if c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
            out.append(c)
            i += 1
            if c == "[" and pattern[i:i + 1] == "^":
                out.append("^")
                i += 1
            if c == "[" and pattern[i:i + 1] == "]":     # a bracket at the start of a class is itself
                out.append("\\]")
                i += 1
            continue
        if c == "[":
            depth = 1
            out.append(c)
            i += 1
            if pattern[i:i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i:i + 1] == "]":
                out.append("\\]")
                i += 1
            quantified = False
            continue
        if c == "(" and pattern[i + 1:i + 2] == "?":
            if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>", "(?#"), i):
                raise InvalidPattern("look-around or atomic group")
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
            elif pattern.startswith("(?<", i):
                out.append("(?<")
                i += 3
            else:
                end = next((k for k in range(i + 2, n) if pattern[k] in ":)"), n)
                flags = pattern[i + 2:end]
                if end == n or any(f not in "imsxu-" for f in flags):
                    raise InvalidPattern("group flags")
                flags = flags.replace("u", "")
                out.append("(?" + (flags if flags != "-" else "") + pattern[end])
                i = end + 1
            quantified = False
            continue
        if c in "*+?" or (c == "{" and (end := pattern.find("}", i)) > i
                          and pattern[i + 1:end].replace(",", "", 1).strip().isdigit()):
            if quantified:
                raise InvalidPattern("repetition of a repetition")
            stop = i + 1 if c in "*+?" else end + 1
            out.append(pattern[i:stop].replace(" ", ""))
            if pattern[stop:stop + 1] == "?":
                out.append("?")
                stop += 1
            i, quantified = stop, True
            continue
        out.append(c)
        quantified = False
        i += 1
    # d: a line ends at a line feed only, as in the dialect
    return ("(?dU)" if case_sensitive else "(?diU)") + "".join(out)


def compiles(java: str) -> bool:
    """Whether the driver's JVM accepts the pattern; anything but a syntax error is raised."""
    from pyspark.errors import IllegalArgumentException

    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a regex rule needs an active Spark session")
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
        return True
    except IllegalArgumentException:    # what the JVM's pattern syntax error is
        return False


def java_pattern(pattern: str, case_sensitive: bool = True) -> str | None:
    """The Java pattern, or None if the pattern is invalid in the dialect."""
    try:
        java = to_java(pattern, case_sensitive)
    except InvalidPattern:
        return None
    return java if compiles(java) else None


# ---------------------------------------------------------------- linear time

#: One item of a Java pattern as :func:`to_java` writes it, outside classes.
_ITEM = re.compile(r"""\\x\{[0-9A-Fa-f]+\} | \\x[0-9A-Fa-f]{2} | \\[pP]\{\^?[^}]*\} | \\[pP]. | \\. |
                       \(\?<[^>]*> | \(\?[dimsxU-]*[:)] | \{[0-9]+(?:,[0-9]*)?\}\?? | [*+?]\?? | .""", re.X | re.S)
_FLAGS = re.compile(r"\(\?([dimsxU-]*)([:)])")

# The Unicode properties White_Space and (besides letters, marks, decimal digits and
# connectors) Alphabetic and Join_Control, as members of a class.
_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = (r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}"
         r"\x{1f170}-\x{1f189}\x{200c}\x{200d}")
_CLASSES = {"d": r"\p{Nd}", "s": _SPACE, "w": _WORD}


def _items(java: str) -> list[str]:
    """The pattern's items; a class is one item."""
    out, i = [], 0
    while i < len(java):
        if java[i] != "[":
            item = _ITEM.match(java, i).group()
        else:
            k, depth = i, 0
            while True:
                depth += {"[": 1, "]": -1}.get(java[k], 0)
                k += 2 if java[k] == "\\" else 1
                if depth == 0 or k >= len(java):
                    break
            item = java[i:k]
        out.append(item)
        i += len(item)
    return out


def _times(item: str) -> tuple[int, float] | None:
    """(least, greatest) of a repetition."""
    if item[0] in "*+?":
        return (int(item[0] == "+"), 1 if item[0] == "?" else float("inf"))
    if item[0] == "{" and len(item) > 1:
        low, comma, high = item.rstrip("?")[1:-1].partition(",")
        return int(low), int(high) if high else float("inf") if comma else int(low)
    return None


def may_backtrack(java: str) -> bool:
    """Whether a part that can match in more than one way (it holds a repetition of varying length or an
    alternation) is itself repeated.  Only then can a backtracking matcher take exponential time; not every
    such pattern does."""
    open_groups, varied, last = [], False, False    # ``varied``: of the group so far, ``last``: of its last item
    for item in _items(java):
        times = _times(item)
        if times is not None:
            if last and times[1] > 1:
                return True
            last = last or times[0] != times[1]
            varied = varied or last
        elif item == ")":
            last = varied
            varied = (open_groups.pop() if open_groups else False) or last
        elif item[0] == "(" and not item.endswith("?)") and not (item.startswith("(?") and item.endswith(")")):
            open_groups.append(varied)
            varied = last = False
        else:
            varied, last = varied or item == "|", False
    return False


def _property(item: str) -> str:
    """A general category, the only kind of property that both engines spell alike."""
    name = item[3:-1] if item[2] == "{" else item[2]
    if not re.fullmatch(r"[A-Z][a-z]?", name):
        raise InvalidPattern(f"property {name}")
    return f"\\{item[1]}{{{name}}}"


def _escaped(item: str, in_class: bool) -> str:
    e = item[1]
    if e in "pP":
        return _property(item)
    if e.lower() in _CLASSES:
        if e == "D":
            return r"\P{Nd}"
        if in_class and e.isupper():
            raise InvalidPattern("negated class in a class")
        return _CLASSES[e] if in_class else f"[{'^' if e.isupper() else ''}{_CLASSES[e.lower()]}]"
    if e in "bBZG":
        raise InvalidPattern("the automaton's word borders are ASCII")
    return item


def _class(item: str) -> str:
    body = item[1:-1]
    if "&&" in body or re.search(r"(?<!\\)\[", body):
        raise InvalidPattern("class in a class")
    parts = re.findall(r"\\x\{[0-9A-Fa-f]+\}|\\[pP]\{\^?[^}]*\}|\\[pP].|\\.|.", body, re.S)
    return "[" + "".join(_escaped(p, True) if p[0] == "\\" else p for p in parts) + "]"


def linear_pattern(java: str) -> str | None:
    """The same pattern for Arrow's automaton, which never backtracks; None if it cannot be said there (word
    borders, classes in classes, properties other than general categories, free spacing, over 1,000 repetitions)."""
    out = []
    try:
        for item in _items(java):
            flags = _FLAGS.fullmatch(item)
            if flags:
                on = flags[1].replace("U", "").replace("d", "")
                if "x" in on:
                    raise InvalidPattern("free spacing")
                out.append(f"(?{on}{flags[2]}" if on.strip("-") or flags[2] == ":" else "")
            elif item.startswith("(?<"):
                out.append("(")
            elif item[0] == "[":
                out.append(_class(item))
            else:
                out.append(_escaped(item, False) if item[0] == "\\" else item)
        found = "".join(out)
        pc.match_substring_regex(pa.array([""]), found)
        return found
    except (InvalidPattern, pa.ArrowInvalid):
        return None


def matches(text: Column, java: str) -> Column:
    """Whether the pattern is found in ``text`` (null: null): by the JVM, or by the automaton in Arrow batches where
    the JVM might take exponential time."""
    if not may_backtrack(java):
        return text.rlike(java)
    linear = linear_pattern(java)
    if linear is None:
        warnings.warn(f"{java!r} may take exponential time and has no linear form")
        return text.rlike(java)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, linear)

    return found(text)

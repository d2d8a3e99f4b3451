"""One pattern text, two regex engines.

Java treats ``\\b`` as Unicode aware (before Java 19) and ``\\s`` as ASCII only; RE2 has no look-around.
The fixed patterns assume ASCII word characters and the wider Unicode white space, so both dialects are
derived from the same text here.

Java 17 tests a class that unites three or more ranges or characters of the first 65,536 several times slower than a predefined
one (measured with 8 threads; the cause was not looked into), so its dialect is written with predefined classes.
"""

from __future__ import annotations

_WORD = "A-Za-z0-9_"
# Unicode white space and line ends, written so that Java and RE2 both accept it inside a class
_SPACE = (r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}")
# the same two as Java's predefined classes: ASCII word characters; ASCII white space and the separators of Unicode
_JAVA_WORD, _JAVA_SPACE = r"\w", r"\s\p{Z}\x{FEFF}"
_JAVA_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _expand(pattern: str, boundary: str, word: str, space: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif two == r"\S" and not in_class:
            out.append(f"[^{space}]")
        elif two == r"\w":
            out.append(word if in_class else f"[{word}]")
        elif two == r"\b" and not in_class:
            out.append(boundary)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = (two[0] == "[") or (in_class and two[0] != "]")
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def java(pattern: str) -> str:
    """Pattern text for Spark."""
    return _expand(pattern, _JAVA_BOUNDARY, _JAVA_WORD, _JAVA_SPACE)


def re2(pattern: str) -> str:
    """Pattern text for an RE2 engine (used by the SQL the results are checked against)."""
    return _expand(pattern, r"\b", _WORD, _SPACE)

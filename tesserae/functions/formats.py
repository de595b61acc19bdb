"""Translation of strftime patterns and of regular expressions to Java's."""

from __future__ import annotations

import re

from ..relation import PlanError

FIELDS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "e": "d", "I": "hh", "p": "a", "a": "EEE", "A": "EEEE", "z": "xx", "%": "%"}


def pattern(strftime: str) -> str:
    """A Java date pattern for a strftime pattern."""
    out, k = "", 0
    while k < len(strftime):
        c = strftime[k]
        if c == "%":
            k += 1
            if k == len(strftime) or strftime[k] not in FIELDS:
                raise PlanError(f"the date pattern {strftime!r} is not supported")
            out += FIELDS[strftime[k]]
        elif c == "'":
            out += "''"
        elif c.isascii() and c.isalpha() or c in "[]{}#":
            out += f"'{c}'"
        else:
            out += c
        k += 1
    return out.replace("''", "\0").replace("\0", "''") if "'" in strftime else out.replace("''", "")


def has_time(strftime: str) -> bool:
    return any(x in strftime for x in ("%H", "%M", "%S", "%T", "%I", "%f"))


def regex(text: str) -> str:
    """A linear-time pattern in Java's syntax; look-around and back-references are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<", text):
        raise PlanError("look-around and back-references are not supported")
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{group(m[1])}>", text)
    return out


def group(name: str) -> str:
    """Java's group names have letters and digits only."""
    return name.replace("_", "Z95Z")


def groups(text: str) -> list[str]:
    return re.findall(r"\(\?P?<([A-Za-z]\w*)>", text)


def replacement(text: str) -> str:
    """$1 and $name for Java; ${1} too."""
    out = re.sub(r"\$\{(\w+)\}", lambda m: "$" + m[1] if m[1].isdigit() else "${" + group(m[1]) + "}", text.replace("\\", "\\\\"))
    return re.sub(r"\$([A-Za-z]\w*)", lambda m: "${" + group(m[1]) + "}", out)

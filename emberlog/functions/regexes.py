"""RE2-style patterns on the JVM's engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_REFUSED = re.compile(r"\(\?[=!]|\(\?<[=!]|\\[1-9]|\\k<|(?<!\\)[*+?]\+")


class Pattern:
    """A pattern in the JVM's syntax, and the numbers of its named groups."""

    def __init__(self, source: str, ignore_case: bool = False):
        if not source:
            raise ValueError("a pattern is needed")
        if _REFUSED.search(source):
            raise ValueError(f"look-around, back references and possessive repeats are not supported: {source}")
        self.source = source
        self.names: dict[str, int] = {}
        out, at, group = [], 0, 0
        in_class = False
        while at < len(source):
            c = source[at]
            if c == "\\":
                out.append(source[at : at + 2])
                at += 2
                continue
            if in_class:
                in_class = c != "]"
                out.append("\\[" if c == "[" and source[at : at + 2] != "[:" else "\\&" if c == "&" else c)
            elif c == "[":
                in_class = True
                take = 2 if source[at + 1 : at + 2] == "^" else 1
                out.append(source[at : at + take])
                at += take
                if source[at : at + 1] == "]":
                    out.append("\\]")
                    at += 1
                continue
            elif named := _NAMED.match(source, at):
                group += 1
                self.names[named[1]] = group
                out.append("(")
                at = named.end()
                continue
            else:
                group += c == "(" and source[at + 1 : at + 2] != "?"
                out.append(c)
            at += 1
        self.groups = group
        self.java = ("(?i)" if ignore_case else "") + "".join(out)

    def group_of(self, name: str) -> int:
        if name not in self.names:
            raise ValueError(f"no group named {name!r}")
        return self.names[name]

    def matches(self, value: Column) -> Column:
        return F.coalesce(value.rlike(self.java), F.lit(False))

    def group(self, value: Column, name: str | int) -> Column:
        """The group's text; empty if it took no part in the match, null if nothing matched."""
        return F.when(self.matches(value), F.regexp_extract(value, self.java, name if isinstance(name, int) else self.group_of(name)))

    def replace_all(self, value: Column, replacement: str) -> Column:
        """Every match replaced; ``$1``, ``$name`` and ``${name}`` are groups, ``$$`` is a dollar, names are as long as they can be."""
        out = []
        for literal, dollar, braced, bare in re.findall(r"([^$]+)|(\$\$)|\$\{(\w+)\}|\$(\w+)", replacement):
            name = braced or bare
            if literal:
                out.append(literal.replace("\\", "\\\\"))
            elif dollar:
                out.append("\\$")
            elif name.isdigit():
                out.append(f"${int(name)}" if int(name) <= self.groups else "")
            elif name in self.names:
                out.append(f"${self.names[name]}")
        return F.regexp_replace(value, F.lit(self.java), F.lit("".join(out)))


def glob_to_regex(glob: str) -> str:
    """A pattern for the whole of a value: ``*`` any run, ``?`` one character, ``[...]`` and ``[!...]`` sets, ``{a,b}`` alternatives."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[at + 1 :]:
            end = glob.index("]", at + 2)
            inside = glob[at + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            at = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and at + 1 < len(glob):
            at += 1
            out.append(re.escape(glob[at]))
        else:
            out.append(re.escape(c))
        at += 1
    return "^(?s:" + "".join(out) + ")$"


def is_glob(value: str) -> bool:
    return any(c in "?*[]{}!-" for c in value)

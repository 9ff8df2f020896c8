"""INI-style configuration: ``[section "name"]``, ``Key=value``, keys repeat, dashes are underscores."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

_SECTION = re.compile(r'^\[\s*([\w\-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\s*\]$')
_TRUE, _FALSE = {"true", "t", "yes", "y", "1"}, {"false", "f", "no", "n", "0", ""}


class Section(dict):
    """Lists of values by key, lower case."""

    def one(self, key: str, default: str | None = None) -> str | None:
        values = self.get(key.lower().replace("-", "_"), [])
        return values[-1] if values else default

    def many(self, key: str) -> list[str]:
        return list(self.get(key.lower().replace("-", "_"), []))

    def flag(self, key: str, default: bool = False) -> bool:
        value = self.one(key)
        return default if value is None else parse_bool(value)

    def number(self, key: str, default: int | None = None) -> int | None:
        value = self.one(key)
        return default if value is None else int(value, 0)


def parse_bool(text: str) -> bool:
    t = text.strip().lower()
    if t in _TRUE:
        return True
    if t in _FALSE:
        return False
    raise ValueError(f"no truth value: {text!r}")


def parse(lines: str | Iterable[str]) -> dict[tuple[str, str], Section]:
    """(section, name) -> its keys; both in lower case but for the name."""
    out: dict[tuple[str, str], Section] = {}
    now = out.setdefault(("", ""), Section())
    for number, line in enumerate(lines.splitlines() if isinstance(lines, str) else lines, 1):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[":
            m = _SECTION.match(line)
            if not m:
                raise ValueError(f"line {number}: bad section {line!r}")
            now = out.setdefault((m[1].lower(), re.sub(r"\\(.)", r"\1", m[2] or "")), Section())
            continue
        key, sign, value = line.partition("=")
        if not sign or not key.strip():
            raise ValueError(f"line {number}: no key and value in {line!r}")
        value = value.strip()
        if value[:1] == '"':
            end = re.match(r'"((?:[^"\\]|\\.)*)"\s*(?:[#;].*)?$', value)
            if not end:
                raise ValueError(f"line {number}: quote without end")
            value = re.sub(r'\\(["\\])', r"\1", end[1])
        else:
            value = re.split(r"\s[#;]", value)[0].strip()
        now.setdefault(key.strip().lower().replace("-", "_"), []).append(value)
    return out


def overlay(base: dict[tuple[str, str], Section], more: dict[tuple[str, str], Section]) -> dict[tuple[str, str], Section]:
    """``base`` with the keys of ``more`` in the place of its own."""
    out = {k: Section(v) for k, v in base.items()}
    for k, own in more.items():
        out.setdefault(k, Section()).update(own)
    return out


def parse_time(text: str) -> datetime:
    """RFC 3339, to the microsecond."""
    t = re.sub(r"(\.\d{6})\d+", r"\1", text.strip().replace("Z", "+00:00"))
    found = datetime.fromisoformat(t)
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)

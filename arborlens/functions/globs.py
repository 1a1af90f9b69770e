"""Glob dialects as regular expressions that Java and RE2 both accept.

Three dialects occur. Exclude globs know only ``*``, ``**`` and ``?``. Shell patterns (entrypoints)
let ``*`` run across ``/`` and know ``[...]``. Tree globs (sequence leaves) work segment by segment.
Patterns are configuration, so the first two are translated on the driver and reach the executors
as one literal. Tree globs come from a table and are translated where they are.
"""

from __future__ import annotations

import re
from itertools import takewhile

NEVER = r"[^\s\S]"


def _literal(text: str) -> str:
    return re.sub(r"([^\w]|_)", lambda m: m[0] if ord(m[0]) > 127 else "\\" + m[0], text).replace("\\_", "_")


def exclude_body(pattern: str) -> str:
    """An exclude glob without anchors."""
    wild = {"**/": r"(?:[^\n]*/)?", "**": r"[^\n]*", "*": "[^/]*", "?": "[^/]"}
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)
    return "".join(wild.get(token) or _literal(token) for token in tokens)


def anchored(bodies: list[str]) -> str:
    """One expression that matches when any body covers the whole text (a final newline is free)."""
    return r"\A(?:" + "|".join(bodies) + r")\n?\z" if bodies else NEVER


def _bracket(body: str) -> str:
    """The inside of ``[...]`` as a character class. A range that runs backwards has no members."""
    negated = body.startswith("!")
    rest = body[1:] if negated else body
    members = []
    while rest:
        if len(rest) > 2 and rest[1] == "-":
            if rest[0] <= rest[2]:
                members.append(f"{_literal(rest[0])}-{_literal(rest[2])}")
            rest = rest[3:]
        else:
            members.append(_literal(rest[0]))
            rest = rest[1:]
    if not members:
        return r"[\s\S]" if negated else NEVER
    return f"[{'^' if negated else ''}{''.join(members)}]"


_TOKEN = r"\*+|\?|\[!?\]?[^\]]*\]|[^*?\[]+|\["


def _wildcards(pattern: str, star: str, one: str) -> str:
    out = []
    for token in re.findall(_TOKEN, pattern):
        if token[0] == "*":
            out.append(star)
        elif token == "?":
            out.append(one)
        elif token[0] == "[" and len(token) > 1:
            out.append(_bracket(token[1:-1]))
        else:
            out.append(_literal(token))
    return "".join(out)


def shell_regex(pattern: str) -> str:
    """A shell pattern: ``*`` also crosses ``/``."""
    return r"\A" + _wildcards(pattern, r"[\s\S]*", r"[\s\S]") + r"\z"


def tree_regex(pattern: str) -> str:
    """A tree glob: ``**`` is a whole segment and stands for folders only."""
    segments = [s for s in pattern.split("/") if s not in ("", ".")]
    if not segments or segments[-1] == "**" or any("**" in s and s != "**" for s in segments):
        return NEVER
    body = "".join(
        "(?:[^/]+/)*" if s == "**" else _wildcards(s, "[^/]*", "[^/]") + "/" for s in segments[:-1]
    )
    return r"\A" + body + _wildcards(segments[-1], "[^/]*", "[^/]") + r"\z"


def tree_shape(pattern: str) -> tuple[int, int, str, str]:
    """What all matches of a tree glob share: depth and length (-1 where they vary), literal head and tail."""
    segments = [s for s in pattern.split("/") if s not in ("", ".")]
    tokens: list[str] = []
    for n, segment in enumerate(segments):
        # The slash after ``**`` belongs to the folders it stands for.
        ends = [] if segment == "**" or n == len(segments) - 1 else ["/"]
        tokens += re.findall(_TOKEN, segment) + ends

    def literal(token: str) -> bool:
        return token[0] not in "*?" and (token[0] != "[" or len(token) == 1)

    depth = -1 if "**" in segments else len(segments) - 1
    length = -1 if any(t[0] == "*" for t in tokens) else sum(len(t) if literal(t) else 1 for t in tokens)
    head = "".join(takewhile(literal, tokens))
    tail = "".join(reversed(list(takewhile(literal, reversed(tokens)))))
    return depth, length, head, tail


def folder_name(pattern: str) -> str | None:
    """``name`` for a pattern of the form ``**/name/**``."""
    found = re.fullmatch(r"\*\*/([^/*]*)/\*\*", pattern, re.DOTALL)
    return found[1] if found else None


def may_match_probe(pattern: str) -> bool:
    """Whether a pattern can cover a probe path, whose last segment is always ``x``."""
    last = pattern.rsplit("/", 1)[-1]
    return "**" in last or re.fullmatch(exclude_body(last), "x") is not None

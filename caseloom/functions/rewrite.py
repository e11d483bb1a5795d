"""JSON texts rewritten in one pass, whatever their shape and depth.

A text is read token by token with a stack of its own, so nesting costs memory in
proportion and never a stack overflow.  What happens to a value follows from its
*mode*: a mode says what is done to texts and which mode each member has.  Members
are written as they come; of a repeated key the last one stays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([\[\]{},:]))')
_END = re.compile(r"[ \t\n\r]*")


@dataclass(frozen=True)
class Mode:
    """What is done to a value.

    ``text`` changes texts (None: kept); ``drop``: the value and its key go; ``instead`` stands for any value;
    ``members`` by key and ``each`` for the others and for the items of lists (None: this mode again)."""

    text: Callable[[str], str] | None = None
    drop: bool = False
    instead: str | None = None
    members: dict[str, Mode] = field(default_factory=dict)
    each: Mode | None = None


KEEP = Mode()
DROP = Mode(drop=True)


def _quoted(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    return out if out.isascii() or not re.search("[\ud800-\udfff]", out) else json.dumps(s)


class _Open:
    """A list or object that is being read; ``out`` is None if nothing of it is written."""

    def __init__(self, mode: Mode, close: str, out: bool):
        self.mode, self.close, self.out = mode, close, out
        self.items: list[tuple[str | None, int, int]] = []  # (key, first part, part after the last)
        self.key: str | None = None
        self.start = 0


def rewrite(text: str, mode: Mode) -> str | None:
    """The text rewritten; None if it is no JSON."""
    out: list[str] = []
    stack: list[_Open] = []
    at, state = 0, "value"  # value, first (a value or the end), key, first key, colon, next, done
    while state != "done":
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        string, plain, mark = m.groups()
        top = stack[-1] if stack else None
        if state in ("key", "first key"):
            if string is not None:
                try:
                    top.key = json.loads(string)
                except ValueError:
                    return None
                state = "colon"
                continue
            if not (mark == "}" and state == "first key"):
                return None
        elif state == "colon":
            if mark != ":":
                return None
            state = "value"
            continue
        elif state == "next":
            if mark == ",":
                state = "key" if top.close == "}" else "value"
                continue
            if mark != top.close:
                return None
        if mark in ("]", "}"):  # the end of what is open
            if top is None or mark != top.close or state == "value":
                return None
            if top.out:
                last = {k: n for n, (k, _, _) in enumerate(top.items)} if mark == "}" else {}
                comma = False
                for n, (k, a, b) in enumerate(top.items):
                    if mark == "}" and last[k] != n:
                        out[a:b] = [""] * (b - a)
                    else:
                        out[a] = ("," if comma else "") + out[a]
                        comma = True
                out.append(mark)
            stack.pop()
        else:  # a value
            if top is None:
                own, shown = mode, True
            else:
                own = top.mode.members.get(top.key, top.mode.each or top.mode) if top.close == "}" else top.mode.each or top.mode
                shown = top.out and not own.drop
                top.start = len(out)
                if shown and top.close == "}":
                    out.append(_quoted(top.key) + ":")
            if own.instead is not None and shown:
                out.append(_quoted(own.instead))
                shown = False
                if top is not None:
                    top.items.append((top.key, top.start, len(out)))
            elif shown and top is not None:
                top.items.append((top.key, top.start, -1))
            if mark in ("[", "{"):
                stack.append(_Open(own, "]" if mark == "[" else "}", shown))
                if shown:
                    out.append(mark)
                state = "first" if mark == "[" else "first key"
                continue
            if mark is not None:
                return None
            if string is not None:
                try:
                    value = json.loads(string)
                except ValueError:
                    return None
                if shown:
                    out.append(_quoted(value if own.text is None else own.text(value)))
            elif shown:
                out.append(plain)
        # a value has ended
        if stack:
            top = stack[-1]
            if top.items and top.items[-1][2] == -1:
                top.items[-1] = (*top.items[-1][:2], len(out))
            state = "next"
        else:
            state = "done"
    return "".join(out) if _END.fullmatch(text, at) else None

"""A small HOCON: comments, `=` or `:`, dotted keys, nested blocks, lists, quoted and bare values."""

from __future__ import annotations

import re
from typing import Any

_TOKEN = re.compile(r"""\s*(?:(?:\#|//)[^\n]*|(?P<quoted>"(?:[^"\\\n]|\\.)*")|(?P<mark>[{}\[\]=:,])|(?P<bare>[^\s{}\[\]=:,#"]+)|(?P<odd>.))""", re.S)


class HoconError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m["odd"]:
            raise HoconError(f"unexpected {text[at:at + 10]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    return out


def _scalar(kind: str, word: str) -> Any:
    if kind == "quoted":
        import json

        return json.loads(word)
    if word in ("true", "false"):
        return word == "true"
    if word == "null":
        return None
    for number in (int, float):
        try:
            return number(word)
        except ValueError:
            pass
    return word


def loads(text: str) -> dict:
    tokens, at = _tokens(text), 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def take(*want: str) -> tuple[str, str]:
        nonlocal at
        got = peek()
        if want and got[1] not in want:
            raise HoconError(f"expected {' or '.join(want)}, found {got[1]!r}")
        at += 1
        return got

    def value() -> Any:
        kind, word = peek()
        if word == "{" and kind == "mark":
            take()
            return block("}")
        if word == "[" and kind == "mark":
            take()
            items = []
            while peek() != ("mark", "]"):
                if peek()[0] == "end":
                    raise HoconError("a list is not closed")
                items.append(value())
                if peek() == ("mark", ","):
                    take()
            take("]")
            return items
        if kind in ("mark", "end"):
            raise HoconError(f"a value is missing before {word!r}")
        take()
        return _scalar(kind, word)

    def block(end: str) -> dict:
        out: dict[str, Any] = {}
        while True:
            kind, word = peek()
            if kind == "end" or (kind, word) == ("mark", end):
                if (kind == "end") != (end == ""):
                    raise HoconError("a block is not closed" if kind == "end" else "a block is closed twice")
                if kind != "end":
                    take()
                return out
            if (kind, word) == ("mark", ","):
                take()
                continue
            if kind == "mark":
                raise HoconError(f"a key is missing before {word!r}")
            take()
            path = [_scalar(kind, word)] if kind == "quoted" else word.split(".")
            if peek()[1] in ("=", ":") and peek()[0] == "mark":
                take()
            elif peek() != ("mark", "{"):
                raise HoconError(f"no value for {word!r}")
            put(out, path, value())

    def put(out: dict, path: list[str], v: Any) -> None:
        for p in path[:-1]:
            out = out.setdefault(p, {})
        old = out.get(path[-1])
        out[path[-1]] = old | v if isinstance(old, dict) and isinstance(v, dict) else v

    if peek() == ("mark", "{"):
        take()
        out = block("}")
        if peek()[0] != "end":
            raise HoconError("text after the last block")
        return out
    return block("")

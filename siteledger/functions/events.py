"""Reading JSON of any size and depth value by value, without building it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import types as T

from siteledger.functions.leaf import load, value_text
from siteledger.functions.plan import of_some

_OPEN, _CLOSE, _COMMA, _COLON, _STRING, _SCALAR = range(1, 7)
_TOKEN = re.compile(
    r"[ \t\n\r]*+(?:([\[{])|([\]}])|(,)|(:)"
    r'|("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)
_SPACE = re.compile(r"[ \t\n\r]*")
_LONE_SURROGATE = re.compile("[\ud800-\udfff]")
_VALUE, _FIRST, _KEY, _NEXT = range(4)


def values(text: str, depth: int) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of each value at most `depth` levels inside the document, when it ends:
    members of a container come before it, the document itself is last, with an empty path.

    Raises ValueError where the text is not one JSON value. What is open waits on a stack, so
    neither depth nor size matters."""
    # Opening sign, name or index of the member at hand, start. None of it is an object of its own
    # per level, as the garbage collector would go through those again and again.
    signs: list[str] = []
    names: list[str | int | None] = []
    starts: list[int] = []
    at, state = 0, _VALUE
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(at)
        kind, at = m.lastindex, m.end()
        start = m.start(kind)
        box = signs[-1] if signs else None
        if kind == _CLOSE:
            if box is None or state not in (_FIRST, _NEXT) or (box == "{") != (text[start] == "}"):
                raise ValueError(start)
            signs.pop(), names.pop()
            start = starts.pop()
        elif state == _NEXT:
            if kind != _COMMA:
                raise ValueError(start)
            if box == "[":
                names[-1] += 1
                state = _VALUE
            else:
                state = _KEY
            continue
        elif state == _KEY or (state == _FIRST and box == "{"):
            if kind != _STRING:
                raise ValueError(start)
            # Names matter near the top only.
            names[-1] = json.loads(text[start:at]) if len(signs) <= depth else None
            m = _TOKEN.match(text, at)
            if m is None or m.lastindex != _COLON:
                raise ValueError(at)
            at, state = m.end(), _VALUE
            continue
        elif kind == _OPEN:
            sign = text[start]
            signs.append(sign)
            names.append(0 if sign == "[" else None)
            starts.append(start)
            state = _FIRST
            continue
        elif kind not in (_STRING, _SCALAR):
            raise ValueError(start)
        if len(signs) <= depth:
            yield tuple(names), start, at
        if not signs:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError(at)
            return
        state = _NEXT


def _shown_value(value, quoted: bool = False) -> str | None:
    """A value as text, as `shown` has it; `quoted`, in canonical form."""
    if not quoted and (value is None or isinstance(value, str)):
        text = value
    else:
        text = value_text(value)
    return None if text is None else _LONE_SURROGATE.sub("?", text)


def shown(part: str) -> str | None:
    """A JSON value as text: a string is its characters, null is none, all else is printed."""
    if part[0] == '"' and "\\" not in part:
        return part[1:-1]
    return _shown_value(load(part))


def printed(part: str) -> str:
    """A JSON value in canonical form."""
    return _shown_value(load(part), quoted=True)


FALSY = ("null", '""', "0", "false")

INDEX_TYPE = (
    T.StructType()
    .add("modules", T.ArrayType(T.StringType()))
    .add("version", "string")
    .add("strategy", "string")
    .add("last_verified", "string")
    .add("merkle_root", "string")
)


def index_members(text: str) -> dict | None:
    """What a site index states; None where the text is not one JSON value. Of members that
    share a name the last counts."""
    modules, version, verification = None, None, {}
    listed: list[str] = []
    inner: dict[str, str] = {}
    try:
        for path, start, end in values(text, 2):
            top = path[0] if path else None
            if len(path) == 2 and top == "modules":
                listed.append(shown(text[start:end]) or ("null" if text[start:end] == "null" else ""))
            elif len(path) == 2 and top == "verification":
                inner[path[1]] = text[start:end]
            elif len(path) == 1 and top == "modules":
                modules, listed = listed if text[start] == "[" else None, []
            elif len(path) == 1 and top == "verification":
                verification, inner = inner if text[start] == "{" else {}, {}
            elif len(path) == 1:
                listed, inner = [], {}
                if top == "version":
                    version = shown(text[start:end])
            elif not path and text[start] != "{":
                modules, version, verification = None, None, {}
    except ValueError:
        return None
    said = lambda name: shown(verification.get(name, "null"))
    root = verification.get("merkleRoot", "null")
    return {
        "modules": modules, "version": version, "strategy": said("strategy"), "last_verified": said("lastVerified"),
        "merkle_root": None if printed(root) in FALSY else shown(root),
    }


read_index = of_some(INDEX_TYPE, index_members)


MEMBER_TYPE = T.StructType().add("json", "string").add("text", "string")


def members_named(text: str, names: list[str]) -> list[dict | None]:
    """These members of an object in canonical form, each as canonical JSON and as text; None where
    it has none. Who printed the text has built it before, so it may be built here."""
    value = load(text)
    return [{"json": _shown_value(value[n], quoted=True), "text": _shown_value(value[n])} if n in value else None for n in names]


def read_members(*names: str) -> Callable[[Column], Column]:
    """Per element of a JSON array, the named members of it; NULL for an element null."""

    def one(text: str) -> list:
        parts = [text[start:end] for path, start, end in values(text, 1) if path]
        return [None if p == "null" else members_named(p, list(names)) for p in parts]

    return of_some(T.ArrayType(T.ArrayType(MEMBER_TYPE)), one)

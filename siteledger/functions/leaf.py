"""Per-value JSON helpers behind the Arrow UDFs, for what no expression can do."""

from __future__ import annotations

import json
import re
from decimal import Decimal

_LONE_SURROGATE = re.compile("[\ud800-\udfff]")
_ARRAY_INDEX = re.compile(r"(?:0|[1-9][0-9]{0,9})\Z")


def number_text(x: float) -> str:
    """Print a double the way JSON.stringify does."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    digits_tuple = Decimal(repr(abs(x))).normalize().as_tuple()
    digits = "".join(map(str, digits_tuple.digits))
    point = len(digits) + digits_tuple.exponent
    if len(digits) <= point <= 21:
        text = digits + "0" * (point - len(digits))
    elif 0 < point <= 21:
        text = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        fraction = "." + digits[1:] if len(digits) > 1 else ""
        text = f"{digits[0]}{fraction}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + text if x < 0 else text


def string_text(s: str) -> str:
    quoted = json.dumps(s, ensure_ascii=False)
    return _LONE_SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", quoted)


def utf16_order(key: str) -> bytes:
    return key.encode("utf-16-be", "surrogatepass")


def _scalar_text(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return number_text(value) if isinstance(value, float) else string_text(value)


def value_text(value, only=None, but=None) -> str:
    """Canonical text; with `only`, object members of other names are left out, and those
    called `but` always are.

    Values nest without limit, so what is open waits on stacks: the containers, the names of
    objects in order, and the places reached. None of them is made per level, as the garbage
    collector would go through them again and again."""
    out, boxes, named, places = [], [], [], []
    while True:
        if isinstance(value, list):
            if value:
                out.append("[")
                boxes.append(value)
                named.append(None)
                places.append(0)
                value = value[0]
                continue
            out.append("[]")
        elif isinstance(value, dict):
            names = sorted((k for k in value if (only is None or k in only) and k != but), key=utf16_order)
            if names:
                out.append(f"{{{string_text(names[0])}:")
                boxes.append(value)
                named.append(names)
                places.append(0)
                value = value[names[0]]
                continue
            out.append("{}")
        else:
            out.append(_scalar_text(value))
        while boxes:
            box, names, at = boxes[-1], named[-1], places[-1] + 1
            if at < len(box if names is None else names):
                places[-1] = at
                out.append("," if names is None else f",{string_text(names[at])}:")
                value = box[at if names is None else names[at]]
                break
            out.append("]" if names is None else "}")
            boxes.pop(), named.pop(), places.pop()
        else:
            return "".join(out)


def member_order(value: dict) -> list[str]:
    """Member names in enumeration order: array indexes first, then as written."""
    indexes = sorted((k for k in value if _ARRAY_INDEX.match(k)), key=int)
    return indexes + [k for k in value if not _ARRAY_INDEX.match(k)]


def _reject(token: str):
    raise ValueError(token)


_SPACE = re.compile(r"[ \t\n\r]*")


def load(text: str):
    try:
        return json.loads(text, parse_int=float, parse_float=float, parse_constant=_reject)
    except RecursionError:
        return _load_deep(text)


def _load_deep(text: str):
    """`load` with open arrays and objects on a stack, for documents of any depth."""

    def skip(at: int) -> int:
        return _SPACE.match(text, at).end()

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(at)
        key, at = json.decoder.scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(at)
        return key, skip(at + 1)

    scalar = json.JSONDecoder(parse_int=float, parse_float=float, parse_constant=_reject).scan_once
    opened, at = [], skip(0)
    while True:
        sign = text[at : at + 1]
        if sign in ("{", "["):
            box, at = {} if sign == "{" else [], skip(at + 1)
            if text[at : at + 1] != ("}" if sign == "{" else "]"):
                key = None
                if sign == "{":
                    key, at = name(at)
                opened.append((box, key))
                continue
            value, at = box, at + 1
        else:
            try:
                value, at = scalar(text, at)
            except StopIteration as stop:
                raise ValueError(at) from stop
        while opened:
            box, key = opened[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            at = skip(at)
            sign = text[at : at + 1]
            if sign == ",":
                at = skip(at + 1)
                if isinstance(box, dict):
                    key, at = name(at)
                    opened[-1] = (box, key)
                break
            if sign != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(at)
            opened.pop()
            value, at = box, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError(at)
            return value


def as_item(value) -> dict:
    keys = None
    if isinstance(value, dict):
        keys = [_LONE_SURROGATE.sub("?", k) for k in member_order(value)]
    return {"canon": value_text(value), "keys": keys}


def kind_of(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, bool):
        return "boolean"
    if value is None:
        return "null"
    return "number" if isinstance(value, float) else "string"


def is_schema_object(value) -> bool:
    if not isinstance(value, dict):
        return False
    pending, kind = [value.get("@context")], value.get("@type")
    known = False
    while pending and not known:
        part = pending.pop()
        if isinstance(part, list):
            pending.extend(part)
        known = isinstance(part, str) and "schema.org" in part.lower()
    falsy = kind is None or kind is False or kind == "" or kind == 0
    return known and not falsy


def schema_objects_in(text: str) -> list[dict] | None:
    """Schema objects of a JSON document, depth first, not looking below a hit."""
    try:
        pending, hits = [load(text)], []
        while pending:
            value = pending.pop()
            if is_schema_object(value):
                hits.append(as_item(value))
            elif isinstance(value, dict):
                pending.extend(value[k] for k in reversed(member_order(value)))
            elif isinstance(value, list):
                pending.extend(reversed(value))
        return hits
    except ValueError:
        return None

"""A walk over JSON of any depth, without recursion."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(
    r"[ \t\r\n]*(?:"
    r'(?P<string>"(?:[^"\\\x00-\x1f]+|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(?P<mark>[\[\]{},:])"
    r"|(?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)
_END = re.compile(r"[ \t\r\n]*\Z")


class _Open:
    """A list or object whose end has not come yet."""

    def __init__(self, is_object: bool, begin: int):
        self.is_object, self.begin = is_object, begin
        self.key: str | None = None
        self.items: list[tuple[int, int]] = []  # where each item of a list is
        self.found: dict = {}  # what each member holds; a list counts its members


def listed_items(text: str, name: str) -> list[str] | None:
    """The items of every list that a member ``name`` of any object is, as they are written.

    Lists of outer objects come before those of inner ones, and members follow each other as
    written.  Nothing is looked for inside a member of that name.  Of repeated names in one object
    the last counts.  None if the text is not one JSON value to its end.
    """
    stack: list[_Open] = []
    at, whole, wants = 0, None, "value"
    while wants != "end":
        token = _TOKEN.match(text, at)
        if token is None:
            return None
        begin, at = token.start(token.lastgroup), token.end()
        kind = token["mark"] or token.lastgroup
        top = stack[-1] if stack else None
        closes = kind in ("]", "}")
        if wants in ("name", "first name") and kind == "string":
            top.key = json.loads(token["string"])
            wants = "colon"
            continue
        if wants == "colon" and kind == ":":
            wants = "value"
            continue
        if wants == "comma" and kind == ",":
            wants = "name" if top.is_object else "value"
            continue
        if wants in ("value", "first value") and kind in ("[", "{"):
            stack.append(_Open(kind == "{", begin))
            wants = "first name" if kind == "{" else "first value"
            continue
        if wants in ("value", "first value") and kind in ("string", "plain"):
            value, found, items = (begin, at), None, None
        elif closes and top and top.is_object == (kind == "}") and wants in ("comma", "first name", "first value"):
            stack.pop()
            value, items = (top.begin, at), None if top.is_object else top.items
            own = top.found.pop(name, None) if top.is_object else None
            found = [part for part in (own, *top.found.values()) if part]
            found = found[0] if len(found) == 1 else found
        else:
            return None
        # A value is complete: hand it to what it is in.
        if not stack:
            whole, wants = found, "end"
            continue
        top = stack[-1]
        wants = "comma"
        if not top.is_object:
            top.items.append(value)
            if found:
                top.found[len(top.items)] = found
        elif top.key == name:
            top.found[name] = items
        else:
            top.found[top.key] = found
    if not _END.match(text, at):
        return None
    out, todo = [], [whole] if whole else []
    while todo:
        part = todo.pop()
        if isinstance(part, tuple):
            out.append(text[part[0] : part[1]])
        else:
            todo += reversed(part)
    return out

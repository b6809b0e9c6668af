"""Where the user texts of a chat body stand: values with the place of their literals.

One walk over the body checks it and finds the texts: every value is decoded once, and a user's message once more for the
place of its parts. ``messages`` is matched exactly, the fields of a message in any case; of a repeated field the
last one counts. Numbers are not converted, so their length does not matter, and a lone half of a surrogate pair
becomes U+FFFD.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any, Iterator, NamedTuple

_SPACE = re.compile(r"[ \t\n\r]*")
_LONE = re.compile("[\ud800-\udfff]")
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
DEPTH = 10_000  # deeper nesting is no JSON to the readers of such bodies either


class UserText(NamedTuple):
    msg_idx: int
    blk_idx: int  # -1 for content that is a plain string
    is_last: bool
    text: str
    start: int  # the literal with its quotes, in code points; -1 if there is none
    end: int


def _refused(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _number(text: str) -> int:
    return 0


def _decode(body: str, at: int) -> tuple[Any, int]:
    # made anew, as this module travels to the workers and a decoder cannot
    return json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_refused).raw_decode(body, at)


def _skip(body: str, at: int) -> int:
    return _SPACE.match(body, at).end()


def _expect(body: str, at: int, marks: str) -> str:
    found = body[at : at + 1]
    if not found or found not in marks:
        raise ValueError(f"expected one of {marks} at {at}")
    return found


def _deep(body: str, at: int) -> int:
    """The end of the value at ``at``, however deep it is nested; it is checked and not decoded."""
    open_: list[str] = []
    while True:
        first = body[at : at + 1]
        if first and first in "{[":
            if len(open_) >= DEPTH:
                raise ValueError("nested too deep")
            open_.append(first)
            at = _skip(body, at + 1)
            if body[at : at + 1] != ("}" if first == "{" else "]"):
                at = _key(body, at) if first == "{" else at
                continue
        elif first == '"':
            at = scanstring(body, at + 1, True)[1]
        else:
            atom = _ATOM.match(body, at)
            if not atom:
                raise ValueError(f"no value at {at}")
            at = atom.end()
        while open_:
            at = _skip(body, at)
            if _expect(body, at, "}," if open_[-1] == "{" else "],") == ",":
                at = _skip(body, at + 1)
                at = _key(body, at) if open_[-1] == "{" else at
                break
            open_.pop()
            at += 1
        if not open_:
            return at


def _key(body: str, at: int) -> int:
    """Behind the key at ``at`` and its colon."""
    _expect(body, at, '"')
    at = _skip(body, scanstring(body, at + 1, True)[1])
    _expect(body, at, ":")
    return _skip(body, at + 1)


def _value(body: str, at: int) -> tuple[Any, int]:
    """The value at ``at`` and its end; one that is nested too deep to be decoded is its bare container."""
    try:
        return _decode(body, at)
    except RecursionError:
        return ({} if body[at] == "{" else []), _deep(body, at)


def _values(body: str, at: int, walk: str | None = None) -> Iterator[tuple[str | int, Any, int, int]]:
    """(key or position, value, start, end) of the object or array that begins at ``at``; last None, None, its place and end.

    The value of the field ``walk`` is left to the caller, who sends where it ends.
    """
    begin, keyed, n = at, body[at] == "{", 0
    closing = "}" if keyed else "]"
    at = _skip(body, at + 1)
    if body[at : at + 1] != closing:
        while True:
            key: str | int = n
            if keyed:
                _expect(body, at, '"')
                key, at = scanstring(body, at + 1, True)
                at = _skip(body, at)
                _expect(body, at, ":")
                at = _skip(body, at + 1)
            if key == walk and body[at : at + 1] == "[":
                end = yield key, None, at, -1
            else:
                value, end = _value(body, at)
                yield key, value, at, end
            at, n = _skip(body, end), n + 1
            if _expect(body, at, "," + closing) != ",":
                break
            at = _skip(body, at + 1)
    yield None, None, begin, at + 1


def _pairs(body: str, value: dict, at: int) -> list[tuple[str, Any]]:
    """The fields of an object; one that came out bare, as it is nested too deep, is walked."""
    return list(value.items()) or [(k, v) for k, v, *_ in _values(body, at) if k is not None]


def _users(body: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Position and place of the user messages of the list at ``at``, and its end."""
    found = []
    for i, message, start, end in _values(body, at):
        if i is None:
            return found, end
        if isinstance(message, dict):
            pairs = _pairs(body, message, start)
            roles = [v for k, v in pairs if k.lower() == "role" and v is not None]
            if roles and roles[-1] == "user" and all(isinstance(r, str) for r in roles):
                found.append((i, start))
    raise AssertionError


def _last(body: str, at: int, name: str) -> tuple[Any, int, int] | None:
    """Value and place of the field that reads ``name`` in any case."""
    found = None
    for key, value, start, end in _values(body, at):
        if key is not None and key.lower() == name:
            found = (value, start, end)
    return found


def _exact(body: str, at: int, name: str) -> tuple[int, int]:
    found = (-1, -1)
    for key, _, start, end in _values(body, at):
        if key == name:
            found = (start, end)
    return found


def user_texts(body: str | None) -> list[UserText] | None:
    """The texts of the user messages in order; None if the body is not JSON."""
    if body is None:
        return None
    users: list[tuple[int, int]] = []
    try:
        top = _skip(body, 0)
        if body[top : top + 1] == "{":
            fields = _values(body, top, walk="messages")
            key, _, start, end = next(fields)
            while key is not None:
                if key == "messages":  # of repeated lists the last one counts; another kind of value holds no texts
                    users, after = _users(body, start) if end < 0 else ([], end)
                    key, _, start, end = fields.send(after) if end < 0 else next(fields)
                else:
                    key, _, start, end = next(fields)
        else:
            end = _value(body, top)[1]
        if _skip(body, end) != len(body):
            return None
    except ValueError:
        return None
    out: list[UserText] = []
    for i, at in users:
        last, content = i == users[-1][0], _last(body, at, "content")
        if content is None or content[0] is None:
            out.append(UserText(i, -1, last, "", -1, -1))
        elif isinstance(content[0], str):
            out.append(UserText(i, -1, last, _LONE.sub("\ufffd", content[0]), *content[1:]))
        elif isinstance(content[0], list):
            for j, block, start, _ in _values(body, content[1]):
                fields = dict(_pairs(body, block, start)) if isinstance(block, dict) else {}
                if fields.get("type") == "text" and isinstance(fields.get("text"), str):
                    out.append(UserText(i, j, last, _LONE.sub("\ufffd", fields["text"]), *_exact(body, start, "text")))
    return out


def replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    """One pass from left to right; where several texts start, the earliest listed pair wins."""
    new = {}
    for old, name in pairs:
        new.setdefault(old, name)
    return re.sub("|".join(map(re.escape, new)), lambda m: new[m[0]], text) if new else text


def spliced(body: str, texts: list[UserText], pairs: dict[tuple[int, int], list[tuple[str, str]]]) -> str:
    """The body with the literals of changed texts written anew, all else byte for byte."""
    changes = []
    for t in texts:
        text = replaced(t.text, pairs.get((t.msg_idx, t.blk_idx), []))
        if text != t.text:
            changes.append((t.start, t.end, json.dumps(text, ensure_ascii=False)))
    out, at = [], 0
    for start, end, literal in sorted(changes):
        out += [body[at:start], literal]
        at = end
    return "".join([*out, body[at:]])

"""RFC 8259 reading of single JSON texts, without limits on depth or digits."""

from __future__ import annotations

import json
import re

_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


class RawNumber(str):
    """A number kept as its text."""


class Repeated(dict):
    """An object with repeated names: the last value of each, as elsewhere, and all of them in `pairs`."""

    pairs: list


def _all_names(pairs: list) -> dict:
    value = dict(pairs)
    if len(value) < len(pairs):
        value = Repeated(value)
        value.pairs = pairs
    return value


def _refuse(word: str):
    raise ValueError(f"{word} is no JSON")


_FAST = json.JSONDecoder(parse_constant=_refuse)
_RAW_NUMBERS = json.JSONDecoder(parse_constant=_refuse, parse_float=RawNumber, parse_int=RawNumber)
_EXACT = json.JSONDecoder(parse_constant=_refuse, parse_float=RawNumber, parse_int=RawNumber, object_pairs_hook=_all_names)


def _slow(text: str, all_names: bool = False):
    """Iterative parser for the rare texts that the recursive one gives up on (depth); numbers stay RawNumber."""
    position, length = _SPACE.match(text).end(), len(text)
    root: list = []
    stack: list = [root]
    keys: list = [None]

    def put(value):
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value
            if all_names:
                stack[-1].pairs.append((keys[-1], value))

    def read_key(at: int) -> int:
        found = _STRING.match(text, at)
        if not found:
            raise ValueError("a name is expected")
        keys[-1] = json.loads(found[0])
        at = _SPACE.match(text, found.end()).end()
        if text[at : at + 1] != ":":
            raise ValueError("a colon is expected")
        return _SPACE.match(text, at + 1).end()

    while True:  # at the start of a value
        char = text[position : position + 1]
        opened = False
        if char in ("{", "["):
            value: object = Repeated() if char == "{" and all_names else {} if char == "{" else []
            if isinstance(value, Repeated):
                value.pairs = []
            put(value)
            position = _SPACE.match(text, position + 1).end()
            if text[position : position + 1] == ("}" if char == "{" else "]"):
                position += 1
            else:
                stack.append(value)
                keys.append(None)
                opened = True
                if char == "{":
                    position = read_key(position)
        elif char == '"':
            found = _STRING.match(text, position)
            if not found:
                raise ValueError("a string is broken")
            put(json.loads(found[0]))
            position = found.end()
        elif found := _NUMBER.match(text, position):
            put(RawNumber(found[0]))
            position = found.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, position)), None)
            if word is None:
                raise ValueError("a value is expected")
            put(_WORDS[word])
            position += len(word)
        if opened:
            continue
        while True:  # after a value
            position = _SPACE.match(text, position).end()
            if len(stack) == 1:
                if position != length:
                    raise ValueError("text after the value")
                return root[0]
            char = text[position : position + 1]
            if char == ",":
                position = _SPACE.match(text, position + 1).end()
                if isinstance(stack[-1], dict):
                    position = read_key(position)
                break
            if char != ("}" if isinstance(stack[-1], dict) else "]"):
                raise ValueError("a comma or an end is expected")
            stack.pop()
            keys.pop()
            position += 1


def loads(text: str, raw_numbers: bool = False, all_names: bool = False):
    """The value of exactly one JSON text (JSON white space around it is fine); ValueError otherwise. all_names: numbers stay raw, and objects
    with repeated names are Repeated."""
    try:
        return (_EXACT if all_names else _RAW_NUMBERS if raw_numbers else _FAST).decode(text)
    except RecursionError:
        return _slow(text, all_names)
    except json.JSONDecodeError:
        raise
    except ValueError as error:
        if "integer string conversion" in str(error):
            return _RAW_NUMBERS.decode(text)
        raise


def load_object(text: str | None, raw_numbers: bool = False, all_names: bool = False) -> dict | None:
    """The object of a line, or None where the line is no single JSON object."""
    if text is None:
        return None
    try:
        value = loads(text, raw_numbers, all_names)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def type_name(value) -> str:
    """string, number, boolean, object, array or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, RawNumber)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"

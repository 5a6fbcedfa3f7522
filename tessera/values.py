"""Attribute values: tags, canonical numbers, sizes, and the tagged JSON form.

A tagged value is a dict with one key: ``{"S": text}``, ``{"N": digits}``,
``{"B": base64}``, ``{"BOOL": bool}``, ``{"NULL": True}``, ``{"M": {...}}``,
``{"L": [...]}``, ``{"SS"|"NS"|"BS": [...]}``.
"""

from __future__ import annotations

import base64
import binascii
import re
from decimal import Decimal
from typing import Any

TAGS = ("S", "N", "B", "BOOL", "NULL", "M", "L", "SS", "NS", "BS")
MAX_ITEM_BYTES, MAX_NAME_BYTES, MAX_DEPTH, MAX_DIGITS = 400_000, 255, 32, 38
_NUMBER = re.compile(r"([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?")

Tagged = dict[str, Any]
Item = dict[str, Tagged]


class ValidationError(ValueError):
    """A request or an item that the rules forbid."""


def canonical_number(text: str) -> str:
    """Plain digits without needless zeros; an exponent only where the plain
    form would need more than 40 padding zeros."""
    found = _NUMBER.fullmatch(text.strip())
    if not found or not (found[2] or found[3]):
        raise ValidationError(f"not a number: {text!r}")
    whole, part = found[2] or "", found[3] or ""
    digits, power = (whole + part).lstrip("0"), int(found[4] or 0) - len(part)
    bare = digits.rstrip("0")
    power += len(digits) - len(bare)
    if not bare:
        return "0"
    sign = "-" if found[1] == "-" else ""
    if power >= 0:
        if power <= 40:
            return sign + bare + "0" * power
    elif -power < len(bare):
        return f"{sign}{bare[:power]}.{bare[power:]}"
    elif -power - len(bare) <= 40:
        return f"{sign}0.{'0' * (-power - len(bare))}{bare}"
    shown = bare[0] + ("." + bare[1:] if len(bare) > 1 else "")
    return f"{sign}{shown}E{power + len(bare) - 1:+d}"


def number(value: int | float | Decimal | str) -> str:
    """The canonical form of a result of arithmetic: integers exact, others
    with 17 digits."""
    d = Decimal(str(value))
    return canonical_number(format(d, "f") if d == d.to_integral_value() else format(d, ".17g"))


def tag_of(value: Tagged) -> str:
    if not isinstance(value, dict) or len(value) != 1 or next(iter(value)) not in TAGS:
        raise ValidationError(f"not a tagged value: {value!r}")
    return next(iter(value))


def normalized(value: Tagged) -> Tagged:
    """The value with canonical numbers; raises on what isn't valid."""
    tag = tag_of(value)
    x = value[tag]
    if tag == "N":
        return {"N": canonical_number(str(x))}
    if tag == "S" and not isinstance(x, str) or tag == "BOOL" and not isinstance(x, bool):
        raise ValidationError(f"wrong content for {tag}")
    if tag == "B":
        _decoded(x)
    if tag == "M":
        return {"M": {k: normalized(v) for k, v in x.items()}}
    if tag == "L":
        return {"L": [normalized(v) for v in x]}
    if tag == "NS":
        return {"NS": [canonical_number(str(v)) for v in x]}
    return value


def _decoded(text: str) -> bytes:
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, TypeError, ValueError) as e:
        raise ValidationError("not base64") from e


def size_of(value: Tagged) -> int:
    tag = tag_of(value)
    x = value[tag]
    if tag in ("S", "N"):
        return len(x.encode())
    if tag == "B":
        return len(_decoded(x))
    if tag in ("BOOL", "NULL"):
        return 1
    if tag == "M":
        return 3 + sum(len(k.encode()) + size_of(v) + 1 for k, v in x.items())
    if tag == "L":
        return 3 + sum(size_of(v) + 1 for v in x)
    return 3 + sum(len(_decoded(v)) if tag == "BS" else len(v.encode()) for v in x)


def item_size(item: Item) -> int:
    return sum(len(k.encode()) + size_of(v) for k, v in item.items())


def _check(value: Tagged, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ValidationError("nesting is too deep")
    tag = tag_of(value)
    x = value[tag]
    for n in [x] if tag == "N" else x if tag == "NS" else []:
        digits = canonical_number(n).split("E")[0].replace(".", "").replace("-", "").strip("0")
        if len(digits) > MAX_DIGITS:
            raise ValidationError("a number has more than 38 digits")
    if tag in ("SS", "NS", "BS"):
        if not x:
            raise ValidationError("a set is empty")
        if len(set(x)) != len(x):
            raise ValidationError("a set has duplicates")
    for v in x.values() if tag == "M" else x if tag == "L" else []:
        _check(v, depth + 1)
    if tag == "M" and any(len(k.encode()) > MAX_NAME_BYTES for k in x):
        raise ValidationError("an attribute name is too long")


def validate(item: Item, keys: dict[str, str]) -> None:
    """Raises unless the item keeps the limits and has its keys, with their
    types and not empty."""
    for name, tag in keys.items():
        if name not in item:
            raise ValidationError(f"the key attribute {name} is missing")
        if tag_of(item[name]) != tag:
            raise ValidationError(f"the key attribute {name} isn't of type {tag}")
        if tag in ("S", "B") and not item[name][tag]:
            raise ValidationError(f"the key attribute {name} is empty")
    for name, value in item.items():
        if len(name.encode()) > MAX_NAME_BYTES:
            raise ValidationError("an attribute name is too long")
        _check(value, 1)
    if item_size(item) > MAX_ITEM_BYTES:
        raise ValidationError("the item is too large")


def plain(value: Tagged) -> Any:
    """The Python value: Decimal for numbers, bytes for binaries."""
    tag = tag_of(value)
    x = value[tag]
    if tag == "N":
        return Decimal(x)
    if tag == "B":
        return _decoded(x)
    if tag == "NULL":
        return None
    if tag == "M":
        return {k: plain(v) for k, v in x.items()}
    if tag == "L":
        return [plain(v) for v in x]
    if tag == "NS":
        return {Decimal(v) for v in x}
    return set(x) if tag in ("SS", "BS") else x


def tagged(value: Any) -> Tagged:
    """A tagged value for a Python one; tagged values pass."""
    if isinstance(value, dict):
        return value if len(value) == 1 and next(iter(value)) in TAGS else {"M": {k: tagged(v) for k, v in value.items()}}
    if value is None:
        return {"NULL": True}
    if isinstance(value, bool):
        return {"BOOL": value}
    if isinstance(value, (int, float, Decimal)):
        return {"N": canonical_number(str(value))}
    if isinstance(value, bytes):
        return {"B": base64.b64encode(value).decode()}
    if isinstance(value, str):
        return {"S": value}
    if isinstance(value, (list, tuple)):
        return {"L": [tagged(v) for v in value]}
    raise ValidationError(f"no tag for {type(value).__name__}")

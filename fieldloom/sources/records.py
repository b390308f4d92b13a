"""Typed records in five text and binary forms, and nested arrays flattened and rebuilt."""

from __future__ import annotations

import dataclasses
import json
import xml.etree.ElementTree as ET
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(x: Any) -> Any:
    if dataclasses.is_dataclass(x):
        return {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, complex):
        return {"re": x.real, "im": x.imag}
    return [_plain(v) for v in x] if isinstance(x, list | tuple) else x


def _typed(kind: Any, x: Any) -> Any:
    if dataclasses.is_dataclass(kind):
        hints = get_type_hints(kind)
        return kind(**{f.name: _typed(hints[f.name], x[f.name]) for f in dataclasses.fields(kind)})
    if get_origin(kind) is list:
        return [_typed(get_args(kind)[0], v) for v in x or []]
    if kind is complex:
        return complex(float(x["re"]), float(x["im"]))
    if kind is bool:
        return x if isinstance(x, bool) else x == "True"
    return kind(x) if x is not None else kind()


def to_json(record: Any) -> str:
    return json.dumps(_plain(record))


def from_json(kind: type, text: str) -> Any:
    return _typed(kind, json.loads(text))


def to_xml(record: Any) -> str:
    def node(name: str, x: Any) -> ET.Element:
        e = ET.Element(name)
        if isinstance(x, dict):
            e.extend(node(k, v) for k, v in x.items())
        elif isinstance(x, list):
            e.set("list", "1")
            e.extend(node("elem", v) for v in x)
        else:
            e.text = str(x)
        return e

    return ET.tostring(node("record", _plain(record)), encoding="unicode")


def from_xml(kind: type, text: str) -> Any:
    def plain(e: ET.Element) -> Any:
        if e.get("list"):
            return [plain(c) for c in e]
        return {c.tag: plain(c) for c in e} if len(e) else e.text

    return _typed(kind, plain(ET.fromstring(text)))


def to_text(record: Any) -> str:
    """One line a value: its dotted path, a tab and the value as JSON."""
    out = []

    def walk(path: str, x: Any) -> None:
        if isinstance(x, dict | list):
            out.append(f"{path}\t{'{}' if isinstance(x, dict) else '[]'}")
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                walk(f"{path}.{k}" if path else str(k), v)
        else:
            out.append(f"{path}\t{json.dumps(x)}")

    walk("", _plain(record))
    return "\n".join(out)


def from_text(kind: type, text: str) -> Any:
    root: dict[str, Any] = {}
    for line in text.splitlines():
        path, value = line.split("\t", 1)
        at, parts = root, ["", *(path.split(".") if path else [])]
        for p in parts[:-1]:
            at = at[int(p)] if isinstance(at, list) else at[p]
        v = json.loads(value)
        if isinstance(at, list):
            at.append(v)
        else:
            at[parts[-1]] = v
    return _typed(kind, root[""])


def to_binary(record: Any) -> bytes:
    return json.dumps(_plain(record)).encode()


def from_binary(kind: type, data: bytes) -> Any:
    return from_json(kind, data.decode())


def flatten(nested: Column, depth: int) -> Column:
    """A regular nested array column as one flat array."""
    for _ in range(depth - 1):
        nested = F.flatten(nested)
    return nested


def rebuild(flat: Column, inner: int) -> Column:
    """A flat array cut into rows of a fixed length."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / inner).cast("int") - 1), lambda k: F.slice(flat, k * inner + 1, F.lit(inner)))


def is_regular(nested: Column) -> Column:
    """Whether all rows of a nested array have one length."""
    sizes = F.transform(nested, F.size)
    return F.coalesce(F.array_min(sizes) == F.array_max(sizes), F.lit(True))

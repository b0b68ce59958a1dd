"""Entities and their relations from YAML front matter, in a subset of YAML outside of which a file is refused whole."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame

#: Why a file is refused; fixed values.
REFUSALS = ("no_frontmatter", "unterminated", "anchor_or_alias", "block_scalar", "flow_collection", "second_document", "tab_indent", "nesting_too_deep", "malformed_line")

DEEPEST = 32
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "path string, tags array<struct<name: string, role: string, kind: string, line: int, expression: string>>, refusal string"
_QUOTED = r""""[^"]*"|'[^']*'"""
_KEY = re.compile(rf"""((?:{_QUOTED}|[^:"'])*):(.*)\Z""", re.S)
_LINK = re.compile(r"\[\[(.*?)\]\]", re.S)
_ELEMENT = re.compile(rf"""\s*({_QUOTED}|\[\[[^\]]*\]\]|[^,:{{}}\["']+)\s*(?:,|\Z)""")
_CLOSED = re.compile(rf"""(?:{_QUOTED}|[^\]"'])*\]""")


class Refused(ValueError):
    """The file is outside the subset; the argument is one of REFUSALS."""


def _bare(value: str) -> str:
    return value[1:-1] if len(value) >= 2 and value[0] in "\"'" and value[-1] == value[0] else value


def _targets(value: str) -> list[str]:
    return [t for x in _LINK.findall(_bare(value)) if (t := x.partition("|")[0].strip())]


def _elements(value: str) -> list[str]:
    """Scalars of a flow list."""
    if not value.endswith("]"):
        raise Refused("flow_collection")
    inner, out, at = value[1:-1].strip(" "), [], 0
    while at < len(inner):
        if not (m := _ELEMENT.match(inner, at)) or not m[1].strip():
            raise Refused("flow_collection")
        out.append(m[1].strip())
        at = m.end()
    if inner.endswith(","):
        raise Refused("flow_collection")
    return out


def entity(text: str, identity: str = "name", kind: str = "template", qualified: bool = False) -> list[dict]:
    """Occurrences of a file: a def of its root `identity` (kind: the root `kind` value, or entity), a ref for each wikilink in a value.

    A ref's kind is the dotted path of the field it stands in. A link in a plain list entry has only
    the innermost key, unless `qualified`. Raises Refused for files outside the subset.
    """
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if lines[0] != "---":
        raise Refused("no_frontmatter")
    try:
        end = lines.index("---", 1)
    except ValueError:
        end = len(lines)
    named = next((m[1].strip(" ") for x in lines[1:end] if (m := re.match(rf"{re.escape(kind)} *:(.*)", x))), "")
    tags: list[dict] = []
    open_keys: list[tuple[int, str]] = []  # indent and key of the blocks that a line is in
    row = 0

    def refer(value: str, field: str, line: str) -> None:
        tags.extend({"name": t, "role": "ref", "kind": field, "line": row, "expression": line} for t in _targets(value))

    while (row := row + 1) < end:
        line = lines[row]
        if "\t" in line:
            raise Refused("tab_indent")
        content = line.strip(" ")
        if not content or content[0] == "#":
            continue
        indent = len(line) - len(line.lstrip(" "))
        while open_keys and open_keys[-1][0] >= indent:
            open_keys.pop()
        if content == "-":
            continue
        listed = content.startswith("- ")
        body = line[indent + 2 :] if listed else line[indent:]
        pair = _KEY.match(body)
        if not pair:
            if not listed or not open_keys:
                raise Refused("malformed_line")
            refer(body, ".".join(k for _, k in open_keys) if qualified else open_keys[-1][1], line)
            continue
        key, value = pair[1].strip(" "), pair[2].strip(" ")
        if not key:
            raise Refused("malformed_line")
        field = ".".join([*(k for _, k in open_keys), key])
        if not value:
            if len(open_keys) >= DEEPEST:
                raise Refused("nesting_too_deep")
            open_keys.append((indent, key))
        elif value[0] in "&*":
            raise Refused("anchor_or_alias")
        elif value[0] in "|>":
            raise Refused("block_scalar")
        elif value[0] == "{":
            if not re.fullmatch(r"\{ *\}", value):
                raise Refused("flow_collection")
        elif value[0] == "[" and not (value.startswith("[[") and value.endswith("]]")):
            first = line
            while not _CLOSED.match(value):
                row += 1
                if row >= end:
                    raise Refused("malformed_line")
                if "\t" in lines[row]:
                    raise Refused("tab_indent")
                value += " " + lines[row].strip(" ")
            for element in _elements(value):
                refer(element, field, first)
        elif not open_keys and key == identity:
            tags.append({"name": _bare(value), "role": "def", "kind": _bare(named) or "entity", "line": row, "expression": line})
        elif open_keys or key != kind:
            refer(value, field, line)
    if end == len(lines):
        raise Refused("unterminated")
    if "---" in lines[end + 1 :]:
        raise Refused("second_document")
    return tags


def _outcome(path: str, text: str | None, qualified: bool) -> dict:
    if not path.endswith(".md"):
        return {"path": path, "tags": None, "refusal": "not_a_note"}
    try:
        return {"path": path, "tags": entity(text or "", qualified=qualified), "refusal": None}
    except Refused as e:
        return {"path": path, "tags": None, "refusal": str(e)}


def extract(files: DataFrame, path: str = "path", text: str = "text", qualified: bool = False) -> DataFrame:
    """(path, tags, refusal) of Markdown files; a refused file has no tags and says why."""

    root, module = ROOT, __name__

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:  # workers that were started elsewhere
            sys.path.append(root)
        outcome = importlib.import_module(module)._outcome
        for batch in batches:
            yield pd.DataFrame([outcome(p, t, qualified) for p, t in zip(batch["p"], batch["t"], strict=True)], columns=["path", "tags", "refusal"])

    return files.selectExpr(f"`{path}` as p", f"`{text}` as t").mapInPandas(run, SCHEMA)

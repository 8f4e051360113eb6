"""Typed tables: column kinds, their text sigils, and Spark schemas with the kinds in field metadata.

A sigil is the prefix of a header cell: ``c`` and the levels parted by 0x1F for a factor, ``i`` for an
integer, ``r`` for a real, ``s`` and a length in bytes for a fixed string; a colon and the name follow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LEVEL_SEPARATOR = "\x1f"
#: Length of the fixed strings of a table without sigils.
DEFAULT_LENGTH = 256
SPARK_TYPES = {"cat": T.StringType(), "int": T.LongType(), "real": T.DoubleType(), "str": T.StringType()}


@dataclass(frozen=True)
class ColumnKind:
    name: str
    kind: str  #: cat, int, real or str
    levels: dict[str, int] = field(default_factory=dict, hash=False)
    length: int = 0


def parse_sigil(cell: str) -> ColumnKind:
    """The kind that a header cell declares; raises ValueError where it is malformed."""
    if not cell:
        raise ValueError("empty header cell")
    head, colon, name = cell.partition(":")
    if not colon:
        raise ValueError(f"no colon in header cell {cell!r}")
    kind, rest = head[:1], head[1:]
    if kind == "c":
        levels = rest.split(LEVEL_SEPARATOR)
        if "" in levels:
            raise ValueError(f"empty level in {cell!r}")
        if len(set(levels)) != len(levels):
            raise ValueError(f"repeated level in {cell!r}")
        return ColumnKind(name, "cat", {v: k for k, v in enumerate(levels)})
    if kind in ("i", "r"):
        if rest:
            raise ValueError(f"unexpected text before the colon in {cell!r}")
        return ColumnKind(name, "int" if kind == "i" else "real")
    if kind == "s":
        if not rest.isascii() or not rest.isdigit() or int(rest) == 0:
            raise ValueError(f"a fixed string needs a positive length: {cell!r}")
        return ColumnKind(name, "str", length=int(rest))
    raise ValueError(f"unknown sigil in {cell!r}")


def render_sigil(c: ColumnKind) -> str:
    """The header cell of a kind; factor levels are in the order of their codes."""
    if c.kind == "cat":
        return "c" + LEVEL_SEPARATOR.join(sorted(c.levels, key=c.levels.get)) + ":" + c.name
    return {"int": "i", "real": "r", "str": f"s{c.length}"}[c.kind] + ":" + c.name


def kinds_of_header(cells: list[str], head: bool = True, sigil: bool = True) -> list[ColumnKind]:
    """Kinds from the first row: by sigils; by names alone; or numbered names (the row is then data)."""
    if head and sigil:
        return [parse_sigil(c) for c in cells]
    names = cells if head else [f"data{i}" for i in range(len(cells))]
    return [ColumnKind(n, "str", length=DEFAULT_LENGTH) for n in names]


def to_struct(kinds: list[ColumnKind]) -> T.StructType:
    fields = []
    for c in kinds:
        meta = {"kind": c.kind}
        if c.kind == "cat":
            meta["levels"] = dict(c.levels)
        if c.kind == "str":
            meta["str_len"] = c.length
        fields.append(T.StructField(c.name, SPARK_TYPES[c.kind], True, meta))
    return T.StructType(fields)


def from_struct(schema: T.StructType) -> list[ColumnKind]:
    """Kinds of a frame's columns: from metadata, else from the Spark type (strings are then fixed strings)."""
    out = []
    for f in schema.fields:
        kind = (f.metadata or {}).get("kind")
        if kind is None:
            kind = "int" if isinstance(f.dataType, T.IntegralType) else "real" if isinstance(f.dataType, T.FractionalType) else "str"
        out.append(ColumnKind(f.name, kind, dict((f.metadata or {}).get("levels", {})), (f.metadata or {}).get("str_len", DEFAULT_LENGTH if kind == "str" else 0)))
    return out

"""Document mappings: the declaration, its YAML form, and the checks on it."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

SQL_KINDS = {"object-sql", "array-sql", "object-flat-sql", "array-flat-sql"}
KINDS = SQL_KINDS | {"array", "object", "boolean", "llm-vector", "static-method"}


class MappingError(ValueError):
    """A mapping that cannot be maintained as declared."""


@dataclass(frozen=True)
class Field:
    """A derived field. Names like parent$child address a child of a nested field."""

    name: str
    kind: str
    split: str = ","
    element_type: str = "string"
    sql: str | None = None
    on_main: str | None = None
    on_slave: str | None = None
    method: str | None = None
    params: dict = field(default_factory=dict, hash=False)

    @property
    def parent(self) -> str | None:
        return self.name.split("$")[0] if "$" in self.name else None

    @property
    def leaf(self) -> str:
        return self.name.split("$")[-1]

    @property
    def nested(self) -> bool:
        return self.kind in SQL_KINDS


@dataclass(frozen=True)
class Mapping:
    """One index: a main query with one row per document, and derived fields."""

    index: str
    sql: str
    pk: str = "id"
    fields: tuple[Field, ...] = ()
    upsert: bool = False
    write_null: bool = False
    updated_time: str | None = None
    enable: bool = True
    env: str | None = None
    destination: str = ""
    adapter_pattern: str = "*"
    target: dict = field(default_factory=dict, hash=False)

    @property
    def nested(self) -> list[Field]:
        return [f for f in self.fields if f.nested]

    @property
    def scalars(self) -> list[Field]:
        return [f for f in self.fields if not f.nested and f.parent is None]

    def children(self, parent: str) -> list[Field]:
        return [f for f in self.fields if f.parent == parent]

    def check(self) -> Mapping:
        """Raises MappingError for what the maintenance rules exclude; returns the mapping."""
        if re.search(r"\bwhere\b", _outside(self.sql), re.I):
            raise MappingError(f"{self.index}: a main query has no WHERE of its own")
        for f in self.fields:
            if f.kind not in KINDS:
                raise MappingError(f"{self.index}.{f.name}: unknown type {f.kind}")
            if not f.nested:
                continue
            if not f.sql or not f.on_main:
                raise MappingError(f"{self.index}.{f.name}: sql and onMainTableChangeWhereSql are needed")
            if re.search(r"\blimit\b", _outside(f.sql), re.I):
                raise MappingError(f"{self.index}.{f.name}: LIMIT is not allowed in nested sql")
            for fragment in (f.on_main, f.on_slave or ""):
                if re.search(r"\b(limit|group\s+by)\b", fragment, re.I):
                    raise MappingError(f"{self.index}.{f.name}: LIMIT and GROUP BY are not allowed in a fragment")
            if not variables(f.on_main):
                raise MappingError(f"{self.index}.{f.name}: the fragment needs a #{{variable}}")
        return self


def _outside(sql: str) -> str:
    """sql without what stands in parentheses or quotes."""
    sql = re.sub(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"|`[^`]*`", "x", sql)
    while (shorter := re.sub(r"\([^()]*\)", " ", sql)) != sql:
        sql = shorter
    return sql


def variables(fragment: str | None) -> list[tuple[str, str]]:
    """(column, variable) for each column = #{variable} of a fragment, on either side."""
    out = []
    for left, right in re.findall(r"([\w.`]+|#\{\w+\})\s*=\s*(#\{\w+\}|[\w.`]+)", fragment or ""):
        a, b = (left, right) if right.startswith("#{") else (right, left)
        if b.startswith("#{"):
            out.append((a.replace("`", ""), b[2:-1]))
    return out


def order_columns(fragment: str | None) -> list[tuple[str, bool]]:
    """(column, descending) of a fragment's ORDER BY."""
    m = re.search(r"\border\s+by\s+(.*)$", fragment or "", re.I | re.S)
    parts = [p.split() for p in m[1].split(",")] if m else []
    return [(p[0].replace("`", ""), len(p) > 1 and p[1].lower() == "desc") for p in parts]


def from_dict(doc: dict, properties: dict[str, str] | None = None) -> Mapping:
    """A mapping from its YAML document; keys are accepted in camel, kebab or snake case."""
    doc = _relaxed(_filled(doc, properties or {}))
    m = _relaxed(doc.get("esmapping", doc))
    fields = []
    for name, spec in (m.get("objfields") or {}).items():
        spec = _relaxed(spec)
        array, sql, method = (_relaxed(spec.get(k) or {}) for k in ("paramarray", "paramsql", "paramstaticmethod"))
        fields.append(
            Field(
                name,
                spec["type"].lower().replace("_", "-"),
                array.get("split", ","),
                {"Integer": "int", "Long": "bigint", "String": "string", "Double": "double"}.get(str(array.get("classtype", "String")).split(".")[-1], "string"),
                sql.get("sql"),
                sql.get("onmaintablechangewheresql"),
                sql.get("onslavetablechangewheresql"),
                method.get("method"),
                spec.get("paramllmvector") or {},
            )
        )
    flags = {k: bool(m.get(k.replace("_", ""), d)) for k, d in (("upsert", False), ("write_null", False), ("enable", True))}
    return Mapping(
        m["index"], m["sql"], m.get("pk") or m.get("id") or "id", tuple(fields), updated_time=m.get("indexupdatedtime"), env=m.get("env"),
        destination=doc.get("destination", ""), adapter_pattern=doc.get("adapternamepattern", "*"), **flags,
    )


def load_mappings(folder: str, env: str | None = None, properties: dict[str, str] | None = None) -> dict[str, Mapping]:
    """All enabled mappings of env under folder, by file name; a name that occurs twice is an error."""
    out: dict[str, Mapping] = {}
    seen: set[str] = set()
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yml", ".yaml")):
        if path.name in seen:
            raise MappingError(f"two mapping files are named {path.name}")
        seen.add(path.name)
        mapping = from_dict(yaml.safe_load(path.read_text("utf-8")), properties)
        if mapping.enable and (env is None or mapping.env in (None, env)):
            out[path.name] = mapping.check()
    return out


def fits_adapter(pattern: str, name: str) -> bool:
    """* fits all; otherwise * stands for any run of characters but -, and ** for any run."""
    if pattern in ("*", name):
        return True
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return bool(re.fullmatch("".join({"**": ".*", "*": "[^-]*", "?": "[^-]"}.get(p, re.escape(p)) for p in parts), name))


def digest(mapping: Mapping) -> str:
    """A fingerprint of a mapping's text, to notice changes."""
    return hashlib.md5(repr(mapping).encode()).hexdigest()


def _relaxed(doc: dict) -> dict:
    return {re.sub(r"[-_]", "", str(k)).lower(): v for k, v in (doc or {}).items()}


def _filled(value, properties: dict[str, str]):
    """${name} and ${name:default} from properties."""
    if isinstance(value, dict):
        return {k: _filled(v, properties) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, properties) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{([^}:]+)(?::([^}]*))?\}", lambda m: str(properties.get(m[1], m[0] if m[2] is None else m[2])), value)
    return value

"""Target types from an index's mapping document, and the check that documents have no other fields."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .mapping import MappingError

Target = dict[str, str | tuple[str, str] | dict]


def target_types(text: str, index: str | None = None) -> Target:
    """Field types from {index: {mappings: {properties: ...}}} or a part of it. Of several indices the one whose name starts
    with index is taken, or else the first. A date's formats stand beside its type; nested fields are mappings of their own."""
    doc = json.loads(text)
    if "mappings" not in doc and "properties" not in doc:
        names = list(doc)
        doc = doc[next((n for n in names if index and n.startswith(index)), names[0])]
    return _properties(doc.get("mappings", doc).get("properties", {}))


def _properties(properties: dict) -> Target:
    out: Target = {}
    for name, spec in properties.items():
        if "properties" in spec:
            out[name] = _properties(spec["properties"])
        elif "format" in spec:
            out[name] = (spec["type"], spec["format"])
        else:
            out[name] = spec.get("type", "object")
    return out


def check_strict(docs: DataFrame, target: Target) -> DataFrame:
    """docs, if all their fields are declared, nested ones included; otherwise MappingError names the others."""

    def unknown(kind: T.StructType, known: Target, path: str) -> list[str]:
        found = []
        for f in kind.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if f.name not in known:
                found.append(path + f.name)
            elif isinstance(inner, T.StructType) and isinstance(known[f.name], dict):
                found += unknown(inner, known[f.name], f"{path}{f.name}.")
        return found

    if extra := [x for x in unknown(docs.schema, target, "") if x != "_id"]:
        raise MappingError(f"fields that the index does not have: {', '.join(extra)}")
    return docs

"""Names: identifiers without quotes, and camel case to snake case and back."""

from __future__ import annotations

import re


def clean_identifier(name: str) -> str:
    """A quoted identifier without its quotes, part by part."""
    return ".".join(p.strip().strip("`'\"") for p in name.split("."))


def to_snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def to_camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(r[:1].upper() + r[1:] for r in rest)

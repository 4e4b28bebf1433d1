"""A gate over source text: imports, calls and attributes that stored code may not have."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Modules that may be imported, names and attributes that may not be used.
IMPORTS = ("parsel", "re", "json", "datetime", "decimal", "urllib.parse")
NAMES = frozenset("eval exec compile open __import__ getattr setattr delattr globals locals vars breakpoint input memoryview __build_class__ __builtins__".split())
ATTRIBUTES = frozenset(("format", "format_map"))
_DUNDER = re.compile(r"__\w*__\Z")


def _may_import(module: str | None) -> bool:
    return bool(module) and any(module == m or module.startswith(m + ".") for m in IMPORTS)


def violations(source: str | None) -> list[str]:
    """What the gate objects to, sorted; a text that isn't Python has one violation."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return ["syntax"]
    found = set()
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                found.update(f"import {n.name}" for n in names if not _may_import(n.name))
            case ast.ImportFrom(module=module, level=level) if level or not _may_import(module):
                found.add(f"import {'.' * level}{module or ''}")
            case ast.Name(id=name) if name in NAMES or _DUNDER.match(name):
                found.add(f"name {name}")
            case ast.Attribute(attr=name) if name in ATTRIBUTES or _DUNDER.match(name):
                found.add(f"attribute {name}")
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def ast_violations(source: pd.Series) -> pd.Series:
    return source.map(violations)

"""Predicates over routes, files and entry points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Middleware names that stand for a control, directories that no scan enters, words of names that call for a control.
CONTROLS = {
    "authenticated": ["auth", "auth.basic", "auth.session"],
    "signed": ["signed"],
    "limited": ["throttle"],
    "gated": ["can", "role", "permission"],
    "guest": ["guest"],
    "verified": ["verified"],
    "confirmed": ["password.confirm"],
}
EXCLUDED_DIRS = ["vendor", "node_modules", "storage", ".git"]


def has_control(middleware: Column, control: str) -> Column:
    """Whether any middleware of a route (``name:arguments``) is one that stands for ``control``; null names count for nothing."""
    return F.exists(middleware, lambda m: F.coalesce(F.substring_index(m, ":", 1).isin(*CONTROLS[control]), F.lit(False)))


def excluded(path: Column, dirs: list[str] = EXCLUDED_DIRS) -> Column:
    """Whether any segment of ``path`` is a directory that no scan enters."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dirs)))


def joined_uri(prefix: Column, uri: Column) -> Column:
    """Prefix and uri with one slash between and around no end; the root is ``/``."""
    joined = F.regexp_replace(F.concat_ws("/", prefix, uri), "/+", "/")
    return F.concat(F.lit("/"), F.regexp_replace(joined, "^/|/$", ""))


def singular(word: Column) -> Column:
    """A resource's parameter name: ``ies`` to ``y``, else one ``s`` less."""
    return F.when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).otherwise(F.regexp_replace(word, "s$", ""))

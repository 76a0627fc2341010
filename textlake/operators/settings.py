"""Profiles as declarative settings, and discovery of segmenters and readers by name."""

from __future__ import annotations

import importlib
import pkgutil
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from textlake.operators import segment


@dataclass(frozen=True)
class Profile:
    name: str
    segmenter: str
    settings: dict = field(default_factory=dict)


# The settings by which the profiles' block passes differ
PROFILES = {
    "json": Profile("json", "library", {"blocks": {"min_chars": 15}}),
    "prosa": Profile("prosa", "heading", {"blocks": {"min_chars": 3, "max_word": 60}, "titles": {"least_score": 3.0}}),
    "verso": Profile("verso", "verse", {"blocks": {"min_chars": 0}, "authors": {"least": 0.85}}),
}


def merged(base: dict, own: dict) -> dict:
    """``own`` over ``base``, key by key at every depth."""
    out = dict(base)
    for key, value in own.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def profile(name: str, **settings) -> Profile:
    p = PROFILES[name]
    return replace(p, settings=merged(p.settings, settings))


def segments(docs: DataFrame, key: str, text: str, p: Profile) -> DataFrame:
    """The segments of ``docs`` by a profile's segmenter."""
    options = {"least_score": p.settings["titles"]["least_score"]} if "titles" in p.settings else {}
    return segment.SEGMENTERS[p.segmenter](docs, key, text, **options)


def discover(package: str, suffix: str = "_segmenter") -> list[str]:
    """Imports the modules of ``package`` whose names end in ``suffix``; each registers what it offers."""
    found = [m.name for m in pkgutil.iter_modules(importlib.import_module(package).__path__, package + ".") if m.name.endswith(suffix)]
    for name in found:
        importlib.import_module(name)
    return found

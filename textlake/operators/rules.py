"""JSON rules compiled to Columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T


@dataclass(frozen=True)
class Rule:
    path: str
    op: str = "eq"
    value: Any = None
    exclude: bool = False


def adapt(config: dict) -> Rule:
    """From the form of profile files: {field, operator, value, negate}; an absent operator means ``eq``."""
    return Rule(config["field"], config.get("operator", "eq"), config.get("value"), bool(config.get("negate", False)))


def at(doc: Column, path: str, kind: str = "string") -> Column:
    """The value at a path like ``a.b[0].c`` of a VARIANT; absent, out of range and JSON null are null."""
    return F.try_variant_get(doc, "$." + path, kind)


# Strings over this many characters are not JSON to try_parse_json; options to read them by its grammar
LONGEST = 20_000_000
LENIENT_IN_LENGTH = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parsed(c: Column) -> Column:
    """A VARIANT from JSON text whose control characters became blanks; null where it is not JSON."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    return F.when(F.octet_length(c) > LONGEST, F.from_json(clean, "variant", LENIENT_IN_LENGTH)).otherwise(F.try_parse_json(clean))


def passes(doc: Column, rule: Rule) -> Column:
    text = at(doc, rule.path)
    value = rule.value
    kind = "double" if isinstance(value, (int, float)) and not isinstance(value, bool) else "string"
    actual = at(doc, rule.path, kind)
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(doc, "$." + rule.path, "variant")) == "STRING", F.lit(False))
    want = F.lit(value)
    tests = {
        "eq": lambda: actual.eqNullSafe(want),
        "neq": lambda: ~actual.eqNullSafe(want),
        "contains": lambda: is_text & F.contains(text, want.cast("string")),
        "not_contains": lambda: is_text & ~F.contains(text, want.cast("string")),
        "exists": lambda: text.isNotNull(),
        "not_exists": lambda: text.isNull(),
        "regex": lambda: is_text & text.rlike(str(value)),
        "gte": lambda: actual >= want,
        "lte": lambda: actual <= want,
    }
    return F.coalesce(tests.get(rule.op, tests["eq"])(), F.lit(False))


def compiled(doc: Column, rules: list[Rule]) -> Column:
    each = [~passes(doc, r) if r.exclude else passes(doc, r) for r in rules]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def deep_strings(c: Column) -> Column:
    """All strings below a JSON text's node, in order, joined by blank lines."""
    found = F.regexp_extract_all(c, F.lit(r'(?<=[:\[,{])\s*"((?:[^"\\]|\\.)*)"\s*(?=[,\]}])'), F.lit(1))
    return F.nullif(F.array_join(F.filter(F.transform(found, T.strip), lambda s: s != ""), "\n\n"), F.lit(""))


def text_at(doc: Column, paths: list[str]) -> Column:
    """The first path that gives a text that is not blank; a list or object gives its strings."""
    tried = []
    for p in paths:
        v = F.try_variant_get(doc, "$." + p, "variant")
        plain = F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
        tried.append(F.nullif(T.strip(F.when(plain, at(doc, p)).otherwise(deep_strings(F.to_json(v)))), F.lit("")))
    return F.coalesce(*tried)


def extract(objects: DataFrame, doc: str, rules: list[Rule], text_paths: list[str], pointer: str | None = None, date: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Objects that pass all rules, with their text, pointer and date; without text, or out of bounds, they go."""
    d = F.col(doc)
    out = objects.where(compiled(d, rules)).withColumn("text", text_at(d, text_paths)).where("text IS NOT NULL")
    if least is not None:
        out = out.where(F.length("text") >= least)
    if most is not None:
        out = out.where(F.length("text") <= most)
    none = F.lit(None).cast("string")
    return out.withColumn("pointer", at(d, pointer) if pointer else none).withColumn("date", at(d, date) if date else none)


def items(docs: DataFrame, doc: str, root: str | None = None, single: bool = False) -> DataFrame:
    """One row for each object of a document: the list itself, the list at ``root``, else its largest list of
    objects one or two levels down, else the document as one object."""
    v = F.col(doc)
    if single:
        return docs.withColumn("item", v)
    if root:
        return docs.withColumn("item", F.explode(F.try_variant_get(v, "$." + root, "array<variant>")))
    top = F.try_variant_get(v, "$", "array<variant>")
    fields = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    below = F.flatten(F.transform(fields, lambda f: F.coalesce(F.map_values(F.try_variant_get(f, "$", "map<string,variant>")), F.array().cast("array<variant>"))))
    lists = F.transform(F.concat(fields, below), lambda f: F.try_variant_get(f, "$", "array<variant>"))
    objects = F.filter(lists, lambda a: a.isNotNull() & (F.size(a) > 0) & F.schema_of_variant(F.get(a, 0)).startswith("OBJECT"))
    largest = F.aggregate(objects, F.lit(None).cast("array<variant>"), lambda acc, a: F.when(acc.isNull() | (F.size(a) > F.size(acc)), a).otherwise(acc))
    return docs.withColumn("item", F.explode(F.coalesce(top, largest, F.array(v))))


def structure(docs: DataFrame, doc: str) -> DataFrame:
    """Schema and number of top-level entries of each JSON document."""
    v = F.col(doc)
    n = F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.size(F.try_variant_get(v, "$", "map<string,variant>")))
    return docs.withColumn("json_schema", F.schema_of_variant(v)).withColumn("entries", n)


# Keys tried in turn for each part of a raw NDJSON record
RECORD_KEYS = {
    "text": ("texto", "text", "content"),
    "id": ("id", "_id"),
    "title": ("titulo", "title"),
    "date": ("fecha", "date", "created_at"),
    "author": ("autor", "author"),
}


def records(docs: DataFrame, doc: str) -> DataFrame:
    """Text, id, title, date and author of NDJSON records, each from the first key that has it."""
    for name, keys in RECORD_KEYS.items():
        docs = docs.withColumn(name, F.coalesce(*[F.nullif(at(F.col(doc), k), F.lit("")) for k in keys]))
    return docs

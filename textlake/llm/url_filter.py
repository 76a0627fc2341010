"""URL allow and block rules in a trie over reversed host labels, then path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.runtime import drop_extra, materialize

#: Rules in one broadcast trie and its bytes at most; more rules are matched trie by trie.
RULES_A_TRIE = 200_000
TRIE_BYTES = 128 << 20


@dataclass
class Trie:
    """Nodes are numbers, 0 the root. ``hosts`` and ``paths`` lead on by a host label or a whole path segment;
    ``below`` is the first path node of a host node; ``rests`` are the unfinished ends of rules at a path node,
    longest first, each with its rule and verdict. Flat tables: paths of any depth can be sent."""

    hosts: dict[tuple[int, str], int] = field(default_factory=dict)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    below: dict[int, int] = field(default_factory=dict)
    rests: dict[int, list[tuple[str, str, str]]] = field(default_factory=dict)


def single_rules(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Each host and path once, with its last verdict, whatever trie it will stand in."""
    return [(host, path, verdict) for (host, path), verdict in {(host.lower(), path): verdict for host, path, verdict in rules}.items()]


def build_trie(rules: list[tuple[str, str, str]]) -> Trie:
    """``rules``: (host, path, verdict). Of two equal rules the later one holds."""
    t, nodes = Trie(), 1
    for host, path, verdict in single_rules(rules):
        at = 0
        for label in reversed(host.split(".")):
            to = t.hosts.setdefault((at, label), nodes)
            nodes += to == nodes
            at = to
        node = t.below.setdefault(at, nodes)
        nodes += node == nodes
        *whole, rest = path.split("/")
        for segment in whole:
            to = t.paths.setdefault((node, segment), nodes)
            nodes += to == nodes
            node = to
        t.rests.setdefault(node, []).append((rest, host + path, verdict))
    for rests in t.rests.values():
        rests.sort(key=lambda x: -len(x[0]))
    return t


def _longest_path(t: Trie, node: int | None, path: str) -> tuple[str, str] | None:
    found, segments = None, path.split("/")
    for i, segment in enumerate(segments):
        # what is left of the path is this segment and all after it; a rest never holds a slash
        found = next((x[1:] for x in t.rests.get(node, ()) if segment.startswith(x[0])), found)
        node = t.paths.get((node, segment)) if i + 1 < len(segments) else None
        if node is None:
            break
    return found


def longest_match(t: Trie, host: str, path: str) -> tuple[str, str, int] | None:
    """(rule, verdict, host labels matched) of the longest rule: most host labels, then the longest path."""
    at, found = 0, None
    for depth, label in enumerate(reversed(host.split(".")), 1):
        at = t.hosts.get((at, label))
        if at is None:
            break
        if at in t.below and (hit := _longest_path(t, t.below[at], path)):
            found = (*hit, depth)
    return found


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _matcher(shared: Broadcast):
    @F.pandas_udf("struct<labels int, length int, rule string, verdict string>")
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = pickle.loads(shared.value)
        for hosts, paths in parts:
            hits = [longest_match(trie, h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame([(x[2], len(x[0]), x[0], x[1]) if x else (0, 0, None, None) for x in hits], columns=["labels", "length", "rule", "verdict"])

    return match


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    A rule fits its host and all subdomains where the path starts with the rule's; of several the longest
    wins (most host labels, then most of the path); of equal rules the last. No rule: rule null, verdict ``default``.
    The trie is broadcast behind a bound on its rules and bytes. More rules go into several tries, one at a
    time: the answers so far are written before the next one is sent, so a worker holds one trie, and the
    longest of the answers holds, which is what one trie would give.

    Null url or no ``://``: host and path empty, so no rule. Repeated rows: each judged. Empty table: no rows.
    Extra columns of any name are left alone.
    """
    spark = pages.sparkSession
    d = drop_extra(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    once = single_rules(rules)
    blocks = [once[i : i + RULES_A_TRIE] for i in range(0, len(once), RULES_A_TRIE)]
    best = F.struct(F.lit(0).alias("labels"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    d = d.withColumn("_best", best)
    asked = 0
    while blocks:
        block = blocks.pop(0)
        packed = pickle.dumps(build_trie(block))
        if len(packed) > TRIE_BYTES and len(block) > 1:
            blocks = [block[: len(block) // 2], block[len(block) // 2 :], *blocks]
            continue
        if asked:
            d = materialize(d)
        found = _matcher(spark.sparkContext.broadcast(packed))("host", "path")
        d = d.withColumn("_best", F.greatest("_best", found) if asked else found)
        asked += 1
    return d.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))

"""URL filters: one trie over reversed host labels, then path segments; the longest match decides.

Rules are a bounded list kept by hand (``MAX_RULES``); the trie travels to the tasks as a broadcast and
each url walks it once, in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
ALLOW, BLOCK = "allow", "block"
RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
         ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))
HOSTS, PATHS, RULE = 0, 1, 2


def build_trie(rules: tuple[tuple[str, str, str], ...]) -> list:
    """Nodes are [next host labels, next path segments, rules that end in this segment's beginning].

    Of two rules with the same host and path, the blocking one holds.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    root: list = [{}, {}, []]
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node[HOSTS].setdefault(label, [{}, {}, []])
        *whole, part = path.split("/")
        for segment in whole:
            node = node[PATHS].setdefault(segment, [{}, {}, []])
        same = next((r for r in node[RULE] if r[0] == part), None)
        if same is None:
            node[RULE].append((part, f"{host}{path}", verdict))
        elif verdict == BLOCK:
            node[RULE][node[RULE].index(same)] = (part, same[1], BLOCK)
    return root


def longest(trie: list, host: str, path: str) -> tuple[str | None, str | None]:
    """Rule and verdict of the longest match: the longest host, and under it the longest path."""
    stops, node = [trie], trie
    for label in reversed(host.split(".")):
        node = node[HOSTS].get(label)
        if node is None:
            break
        stops.append(node)
    segments = path.split("/")
    for node in reversed(stops[1:]):
        best: tuple | None = None
        for segment in segments:
            fits = [r for r in node[RULE] if segment.startswith(r[0])]
            best = max(fits, key=lambda r: len(r[0]), default=best)
            node = node[PATHS].get(segment)
            if node is None:
                break
        if best:
            return best[1], best[2]
    return None, None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id",
               url_col: str = "url", otherwise: str = ALLOW) -> DataFrame:
    """``id_col``, host, path, rule, verdict. Urls that no rule fits get a null rule and ``otherwise``.

    A null url, or one without ``://``, has an empty host and path. Repeated rows and null ids keep a
    row each; extra columns are ignored.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [longest(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v or otherwise for _, v in found], pa.string())],
                ["id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)

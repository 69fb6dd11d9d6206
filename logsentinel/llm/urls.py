"""URL filters (operator 8): a sorted digest array of rules, memory-mapped in each task.

Rules (host, path, verdict) become files of sorted 64-bit xxhash keys, of the full rule strings with their places, and of
verdicts. Spark ships them to every executor; a task maps them, probes all keys that its
urls can fit (each suffix of the host with each path length that a rule has) by one vectorised binary
search for each, and confirms hits on the stored string.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEFAULT = "allow"


def build_filter(spark: SparkSession, rules: Iterable[tuple[str, str, str]], folder: str | None = None) -> str:
    """Writes the digest array and the strings, and ships them to all executors. Returns the filter's name.

    Of rules with equal host and path the last counts. Hosts are lower-cased.
    """
    table = sorted({host.translate(_LOWER) + path: (verdict, len(path)) for host, path, verdict in rules}.items(), key=lambda r: xxhash.xxh64_intdigest(r[0]))
    digests = np.array([xxhash.xxh64_intdigest(r) for r, _ in table], "<u8")
    name = f"urlfilter-{xxhash.xxh64_hexdigest(json.dumps(table))}"
    if (spark.sparkContext.applicationId, name) in _SHIPPED:
        return name
    folder = folder or tempfile.mkdtemp(prefix="url-filter-")
    strings = [r.encode() for r, _ in table]
    ends = np.cumsum([0, *map(len, strings)]).astype("<i8")
    verdicts = sorted({v for _, (v, _) in table})
    files = {".keys": digests.tobytes(), ".text": b"".join(strings), ".ends": ends.tobytes(), ".says": np.array([verdicts.index(v) for _, (v, _) in table], "<i4").tobytes(), ".json": json.dumps({"verdicts": verdicts, "paths": sorted({n for _, (_, n) in table})}).encode()}
    for ext, data in files.items():
        with open(os.path.join(folder, name + ext), "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(os.path.join(folder, name + ext))
    _SHIPPED.add((spark.sparkContext.applicationId, name))
    return name


#: (application, filter) whose files Spark has; a file name can be added once.
_SHIPPED: set[tuple[str, str]] = set()
_LOWER = {c: c + 32 for c in range(65, 91)}


class Filter:
    """The filter in a task."""

    def __init__(self, name: str):
        def mapped(ext: str, kind: str) -> np.ndarray:
            path = SparkFiles.get(name + ext)
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

        self.keys, self.text, self.ends, self.says = mapped(".keys", "<u8"), mapped(".text", "u1"), mapped(".ends", "<i8"), mapped(".says", "<i4")
        self.size = len(self.keys)
        with open(SparkFiles.get(name + ".json")) as f:
            small = json.load(f)
        self.verdicts, self.paths = small["verdicts"], small["paths"]

    def string(self, k: int) -> str:
        return self.text[self.ends[k] : self.ends[k + 1]].tobytes().decode()

    def find(self, candidates: list[str], rows: np.ndarray, n: int) -> tuple[list, list]:
        """The longest rule among each row's candidates."""
        rule: list = [None] * n
        verdict: list = [None] * n
        if self.size and candidates:
            digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
            at = np.searchsorted(self.keys, digests)
            inside = at < self.size
            hit = np.flatnonzero(inside & (np.asarray(self.keys[np.where(inside, at, 0)]) == digests))
            for i in hit.tolist():
                k, row = int(at[i]), int(rows[i])
                while k < self.size and self.keys[k] == digests[i]:  # equal digests stand side by side
                    if self.string(k) == candidates[i] and (rule[row] is None or len(candidates[i]) > len(rule[row])):
                        rule[row], verdict[row] = candidates[i], self.verdicts[self.says[k]]
                    k += 1
        return rule, verdict


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def judge_urls(pages: DataFrame, name: str, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row; equal urls of a batch are probed once.

    A rule fits its host and all subdomains of it where the path starts with the rule's; the longest
    rule wins. Without a rule: null and ``default``. Null, empty or malformed urls have an empty host and
    path; repeated rows get a row each; null ids stay null; an empty table gives an empty result; a filter without rules fits nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Filter(name)
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(url_col))
            parts = [split_url(u) for u in coded.dictionary.to_pylist()] + [("", "")]
            candidates, rows = [], []
            for i, (host, path) in enumerate(parts):
                labels = host.split(".") if host else []
                prefixes = [path[:n] for n in rules.paths if n <= len(path)]
                for k in range(len(labels)):
                    suffix = ".".join(labels[k:])
                    candidates += [suffix + p for p in prefixes]
                    rows += [i] * len(prefixes)
            rule, verdict = rules.find(candidates, np.array(rows, np.int64), len(parts))
            at = coded.indices.fill_null(len(parts) - 1)
            columns = [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array([default if v is None else v for v in verdict], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(c.take(at) for c in columns)], names=[id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), build_filter(spark, RULES))


SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

"""Allow and block rules for urls, matched by a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are broadcast at most, and characters of them together; a longer list is an error, not a silent cut.
MOST_RULES, MOST_CHARACTERS = 1_000_000, 32_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lowered(host: str) -> str:
    """A-Z lower-cased and nothing else."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a url; both empty for null or where ``://`` is absent."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return lowered(host), path[:stop]


class Trie:
    """Nested dicts: host labels from the last to the first, then whole path segments, then beginnings of a segment.

    A rule's path of ``/en/1`` has the whole segments ``""`` and ``en`` and the
    beginning ``1`` of the next one, as it fits every path that starts so.
    """

    def __init__(self, rules: list[Rule]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules exceed the bound of {MOST_RULES}")
        if sum(len(r.text) for r in rules) > MOST_CHARACTERS:
            raise ValueError(f"the rules exceed the bound of {MOST_CHARACTERS} characters")
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(lowered(rule.host).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, start = rule.path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            kept = node.setdefault("starts", {}).get(start)
            if kept is None or (kept.verdict, rule.verdict) == ("allow", "block"):  # of two rules for one place, block holds
                node["starts"][start] = rule

    def longest(self, host: str, path: str) -> Rule | None:
        """The rule with the longest host and path among those that fit; of equally long ones, block."""
        best, size = None, -1
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                for rule in self._along(node["paths"], path.split("/")):
                    if len(rule.text) > size or len(rule.text) == size and rule.verdict == "block":
                        best, size = rule, len(rule.text)
        return best

    @staticmethod
    def _along(node: dict, segments: list[str]) -> Iterator[Rule]:
        for segment in segments:
            starts = node.get("starts", {})
            if len(starts) < len(segment):
                yield from (rule for start, rule in starts.items() if segment.startswith(start))
            elif starts:
                for n in range(len(segment) + 1):
                    if (rule := starts.get(segment[:n])) is not None:
                        yield rule
            node = node.get("segments", {}).get(segment)
            if node is None:
                return


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each input row: id, host, path, rule (null where none fits), verdict.

    The trie is broadcast; its size is that of the rules, at most MOST_RULES of
    MOST_CHARACTERS. Hosts of rules fit whatever the case of their A-Z.
    Urls without a fitting rule take ``default``. Null urls have an empty host
    and path; null ids and repeated rows stay; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.longest(h, p) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [r and r.text for r in found], [r.verdict if r else default for r in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=["id", "host", "path", "rule", "verdict"])

    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    return slim.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)

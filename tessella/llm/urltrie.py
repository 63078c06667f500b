"""URL filter: a trie over reversed host labels and path segments, broadcast to all tasks.

A rule (host, path) fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's. The host's labels are walked from the last one inwards; each node on
the way that ends a rule's host holds a trie of path segments. Of the rules that fit, the
longest host wins, then the longest path; a rule given both as allow and as block blocks. The
rule list is a parameter of bounded size (``MAX_RULES``), so it may be broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule
that has a host; urls that fit no rule get the default verdict; urls may be of any length; rows may
repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_RULES = 1_000_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

Rule = tuple[str, str, str]  # verdict, host, path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for stop in "?#":
        if (end := rest.find(stop)) >= 0:
            rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path



class UrlTrie:
    """Rules by reversed host labels, then by path segments."""

    __slots__ = ("root",)

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the rule's host ends here: its paths
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})  # beginnings of the segment that follows
            if ends.get(last, ("", "allow"))[1] == "allow":
                ends[last] = (host + path, verdict)
            lengths = node.setdefault(0, [])  # of those beginnings, longest first
            if len(last) not in lengths:
                lengths.append(len(last))
                lengths.sort(reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node = self.root
        best = self._paths(node, path)
        for label in reversed(host.split(".")) if host else ():
            if (node := node.get(label)) is None:
                break
            best = self._paths(node, path) or best
        return best

    @staticmethod
    def _paths(node: dict, path: str) -> tuple[str, str] | None:
        node, best = node.get(None), None
        for segment in path.split("/"):
            if node is None:
                break
            for n in node.get(0, ()):
                if n <= len(segment) and (found := node[None].get(segment[:n])):
                    best = found
                    break
            node = node.get(segment)
        return best


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie holds {MAX_RULES}")
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    trie = base.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    kind = dict(base.dtypes)["page_id"]

    def run(parts):
        tree = trie.value
        for part in parts:
            rows = [split_url(u) for u in part.column(1).to_pylist()]
            got = [tree.match(h, p) for h, p in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([h for h, _ in rows], pa.string()),
                    pa.array([p for _, p in rows], pa.string()),
                    pa.array([g and g[0] for g in got], pa.string()),
                    pa.array([g[1] if g else default for g in got], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return base.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")

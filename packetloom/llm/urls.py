"""URL filters: longest match in a trie over reversed host labels, then path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  #: verdict, host, path

#: A pickled trie above this is not broadcast; the rules are then joined.
MAX_TRIE_BYTES = 32 << 20


class Trie:
    """Nodes are plain dicts: labels from the right of the host, under "/" the segments of the path.

    A node holds at None the rest of a rule's path after its last slash, with the rule; the rest is
    matched as a prefix of the next segment, so a rule "host/a/" does not fit "host/ab".
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("s" + segment, {})
            node.setdefault(None, {})[rest] = (verdict, host.lower() + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule of the longest host, among those of the longest path; None if none fits."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            found = self._on_path(node.get("/"), path) or found
        return found

    @staticmethod
    def _on_path(node: dict | None, path: str) -> tuple[str, str] | None:
        found, segments, i = None, path.split("/"), 0
        while node is not None:
            here = segments[i] if i < len(segments) else ""
            fits = [rest for rest in node.get(None, ()) if here.startswith(rest)]
            if fits:
                found = node[None][max(fits, key=len)]
            # a segment is whole only if a slash follows it
            node = node.get("s" + here) if i + 1 < len(segments) else None
            i += 1
        return found


def url_parts(url: str) -> tuple[Column, Column]:
    """Columns of the host (A-Z lower-cased) and path of a url column; empty for null or without ://."""
    c = F.col(url)
    after = F.when(F.instr(c, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """df with host, path, rule and verdict for each row.

    rules: (verdict, host, path). A rule fits its host and the subdomains, if the path starts with its
    path; the longest host wins, then the longest path; of equal rules the last one. Where no rule
    fits, rule is null and verdict is default. A null url, or one without "://", has an empty host and
    path and fits none. Rows are kept one to one, repeated rows too; columns of df named host, path,
    rule or verdict are replaced. The trie is broadcast with the function that reads it if it has at
    most max_trie_bytes; else the rules are joined on each host suffix and path prefix of a url.
    """
    host, path = url_parts(url)
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    base = df.withColumns({"host": host, "path": path}).select(*kept, "host", "path")
    trie = Trie(rules)
    if len(packed := pickle.dumps(trie.root)) > max_trie_bytes:
        return _joined(base, rules, default)
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tree = Trie(())
        tree.root = pickle.loads(shared.value)
        for hosts, paths in batches:
            found = [tree.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [f and f[1] for f in found], "verdict": [f[0] if f else default for f in found]})

    found = _fresh(base)
    return base.withColumn(found, judge("host", "path")).select(*kept, "host", "path", f"{found}.rule", f"{found}.verdict")


def _fresh(df: DataFrame) -> str:
    """A name that no column of df has."""
    name = "_found"
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def _joined(base: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    """The same by a join: keys are a host suffix and the whole segments of a path, both as deep as a rule can be."""
    deep = max((p.count("/") for _, _, p in rules), default=0)
    wide = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    last = {(h.lower(), p): (i, v) for i, (v, h, p) in enumerate(rules)}
    table = base.sparkSession.createDataFrame([(h, p[: p.rfind("/") + 1], p, v, f"{h}{p}", h.count("."), len(p)) for (h, p), (_, v) in last.items()], "_h string, _s string, _p string, _v string, _r string, _labels int, _len int")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    tried = (
        base.select("host", "path").distinct()
        .select("host", "path", labels.alias("_l"), segments.alias("_g"))
        .withColumn("_k", F.explode(F.expr(f"sequence(1, least(size(_l), {wide}))")))
        .withColumn("_h", F.expr("array_join(slice(_l, size(_l) - _k + 1, _k), '.')"))
        .withColumn("_j", F.explode(F.expr(f"sequence(0, least(size(_g) - 1, {deep}))")))
        .withColumn("_s", F.expr("case when _j = 0 then '' else concat(array_join(slice(_g, 1, _j), '/'), '/') end"))
    )
    best = tried.join(table, ["_h", "_s"]).where(F.expr("startswith(path, _p)")).groupBy("host", "path").agg(F.max_by(F.struct("_r", "_v"), F.struct("_labels", "_len")).alias(found := _fresh(base)))
    return base.join(best, ["host", "path"], "left").select(*base.columns, F.col(f"{found}._r").alias("rule"), F.coalesce(f"{found}._v", F.lit(default)).alias("verdict"))

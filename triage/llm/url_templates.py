"""URL filter: rules by host and path, and a tree of path templates for the urls no rule decides.

Each host has a tree of path segments. Segments that are numbers or hexadecimal ids are wildcards
by their looks (``{n}``, ``{h}``, an extension stays). Below every node of the tree a value is a
constant if the node has fewer than ``FEW`` different values or the value holds at least one
``MOST``-th of the node's rows; all others are variable and become ``*``. Constant siblings are
then merged if they are statistically alike: what follows them has about the same distribution
of kinds (total variation at most ``APART``), and their labels neither differ significantly (two
proportions, 1.96 deviations) nor in smoothed rate by more than ``RATES``; siblings with and
without labels are not merged. A merged branch goes on as one node. The tree is built level by
level from counts of paths; only a node's constants, fewer than 66, ever meet in one place.

A template, a way from a host to the end of a path, is rejected if its smoothed purity
(blocked + 1) / (labelled + 2) is at least ``PURE``: three blocked rows and no allowed one are
the least that reject. Labels are those of an optional column (1 block, 0 allow), else the
verdicts of the rules. A template without labels is allowed.

Defined results: a null url and one without ``://`` have an empty host and path, and are judged
together; without rule or labels the verdict is allow. Rows are judged each, repeated rows alike; null ids
pass. Segments beyond ``DEPTH`` are one last segment; empty ones (doubled or last slashes) do not
count. No rows give no rows. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.tables import Table, map_lists

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTH, FEW, MOST = 6, 16, 50
APART, RATES, DEVIATIONS, PURE = 0.2, 0.25, 1.96, 0.8
NUMBER, HEX, END = r"^[0-9]+(\.[A-Za-z0-9]{1,8})?$", r"^(?=[^.]*[0-9])[0-9A-Fa-f-]{8,}(\.[A-Za-z0-9]{1,8})?$", "end"
KINDS = ("{n}", "{h}", END, "word")
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the registered query.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[Rule], host: Column, path: Column, give) -> Column:
    """``give`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(r.fits(host, path), F.lit(give(r))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments, numbers and ids as wildcards, at most DEPTH of them."""

    def known(s: Column) -> Column:
        tail = F.regexp_extract(s, r"(\.[A-Za-z0-9]{1,8})?$", 1)
        return (
            F.when(s.rlike(NUMBER), F.concat(F.lit("{n}"), tail)).when(s.rlike(HEX), F.concat(F.lit("{h}"), tail)).otherwise(s)
        )

    own = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), known)
    rest = F.array_join(F.slice(own, DEPTH, F.greatest(F.size(own), F.lit(1))), "/")
    return F.when(F.size(own) > DEPTH, F.concat(F.slice(own, 1, DEPTH - 1), F.array(rest))).otherwise(own)


def kind(segment: Column) -> Column:
    return (
        F.when(segment.isNull(), END)
        .when(segment.startswith("{n}"), "{n}")
        .when(segment.startswith("{h}"), "{h}")
        .otherwise("word")
    )


@dataclass
class Branch:
    names: list[str]
    counts: list[int]  # rows, blocked, allowed, then rows by kind of what follows


def alike(x: list[int], y: list[int]) -> bool:
    n, m = x[1] + x[2], y[1] + y[2]
    if (n == 0) != (m == 0):
        return False
    if n:
        p, q, both = x[1] / n, y[1] / m, (x[1] + y[1]) / (n + m)
        if abs(p - q) > DEVIATIONS * math.sqrt(both * (1 - both) * (1 / n + 1 / m)):
            return False
        if abs((x[1] + 1) / (n + 2) - (y[1] + 1) / (m + 2)) > RATES:
            return False
    return sum(abs(a / x[0] - b / y[0]) for a, b in zip(x[3:], y[3:], strict=True)) / 2 <= APART


def merged(children: list[tuple[str, list[int]]]) -> dict[str, str]:
    """The name of the branch each constant belongs to; the largest children found branches first."""
    branches: list[Branch] = []
    for name, counts in sorted(children, key=lambda c: (-c[1][0], c[0])):
        home = next((b for b in branches if alike(b.counts, counts)), None)
        if home is None:
            branches.append(Branch([name], list(counts)))
        else:
            home.names.append(name)
            home.counts = [a + b for a, b in zip(home.counts, counts, strict=True)]
    return {
        name: name if len(b.names) == 1 else "(" + "|".join(sorted(b.names)) + ")" for b in branches for name in b.names
    }


_COUNTS = ("n", "blocked", "allowed", *(f"k{i}" for i in range(len(KINDS))))


def _branches(paths: DataFrame, level: int) -> Table:
    """host, template, constants (map from value to the branch it belongs to) of every node at a level."""
    own = paths.withColumns({"seg": F.get("lex", F.lit(level)), "next": kind(F.get("lex", F.lit(level + 1)))}).filter(
        "seg is not null"
    )
    values = own.groupBy("host", "template", "seg").agg(
        *(F.sum(c).alias(c) for c in _COUNTS[:3]),
        *(F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(f"k{i}") for i, k in enumerate(KINDS)),
    )
    values = Table(values, "url-values")
    nodes = values.df.groupBy("host", "template").agg(F.count("*").alias("different"), F.sum("n").alias("all"))
    constants = values.df.join(nodes, ["host", "template"]).filter(
        (F.col("different") < FEW) | (F.col("n") * MOST >= F.col("all"))
    )
    # At most FEW - 1 or MOST to a node.
    sets = constants.groupBy("host", "template").agg(
        F.collect_list("seg").alias("seg"), F.collect_list(F.array(*_COUNTS)).alias("counts")
    )

    def merge(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [merged(list(zip(s, c, strict=True))) for s, c in zip(b["seg"], b["counts"], strict=True)]
            yield {
                "host": b["host"],
                "template": b["template"],
                "seg": [list(f) for f in found],
                "branch": [list(f.values()) for f in found],
            }

    out = Table(
        map_lists(sets, "host string, template string, seg array<string>, branch array<string>", merge).select(
            "host", "template", F.map_from_arrays("seg", "branch").alias("constants")
        ),
        "url-branches",
    )
    values.drop()
    return out


def templates(paths: DataFrame) -> Table:
    """host, lex, template of distinct (host, lex, n, blocked, allowed) rows."""
    current = Table(paths.withColumn("template", F.lit("")), "url-paths")
    levels = current.df.agg(F.max(F.size("lex"))).first()[0] or 0
    for level in range(levels):
        branches = _branches(current.df, level)
        seg = F.get("lex", F.lit(level))
        step = F.concat("template", F.lit("/"), F.coalesce(F.element_at("constants", seg), F.lit("*")))
        moved = Table(
            current.df.join(branches.df, ["host", "template"], "left")
            .withColumn("template", F.when(seg.isNull(), F.col("template")).otherwise(step))
            .drop("constants"),
            "url-paths",
        )
        current.drop()
        branches.drop()
        current = moved
    return current


def judge(urls: DataFrame, rules: Sequence[Rule] = RULES, label: str | None = None) -> tuple[DataFrame, list[Table]]:
    """page_id, host, path, rule, verdict, template, purity of every row of (page_id, url); tables to drop later."""
    host, path = host_and_path(F.col("url"))
    known = [F.col(label).cast("int").alias("label")] if label else []
    rows = (
        urls.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), *known)
        .withColumn("lex", segments(F.col("path")))
        .withColumn("rule", rule_of(rules, F.col("host"), F.col("path"), lambda r: r.name))
        .withColumn("ruled", rule_of(rules, F.col("host"), F.col("path"), lambda r: r.verdict))
    )
    block, allow = (F.col("label") == 1, F.col("label") == 0) if label else (F.col("ruled") == BLOCK, F.col("ruled") == ALLOW)
    paths = rows.groupBy("host", "lex").agg(
        F.count("*").alias("n"), F.count_if(block).alias("blocked"), F.count_if(allow).alias("allowed")
    )
    found = templates(paths)
    pure = found.df.groupBy("host", "template").agg(
        ((F.sum("blocked") + 1) / (F.sum("blocked") + F.sum("allowed") + 2)).alias("purity")
    )
    judged = Table(found.df.select("host", "lex", "template").join(pure, ["host", "template"]), "url-purity")
    found.drop()
    out = rows.join(judged.df, ["host", "lex"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("purity") >= PURE, BLOCK).otherwise(ALLOW)).alias("verdict"),
        "template",
        "purity",
    )
    return out, [judged]

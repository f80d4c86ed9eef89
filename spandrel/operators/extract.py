"""Per-file extraction as column expressions: rules, regions, symbols, value flow."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a definition's name is written, by language (fixed values, Java and RE2 syntax).
DEFINITIONS = {
    "python": r"(?m)^[ \t]*(?:async )?def (\w+)\(", "rust": r"(?m)^[ \t]*(?:pub )?fn (\w+)", "javascript": r"(?m)^[ \t]*(?:export )?function (\w+)\(", "typescript": r"(?m)^[ \t]*(?:export )?function (\w+)\(",
    "go": r"(?m)^func (\w+)\(", "ruby": r"(?m)^[ \t]*def (\w+)", "java": r"(?m)^[ \t]*static \w+ (\w+)\(", "shell": r"(?m)^(\w+)\(\) \{",
}


@dataclass(frozen=True)
class EdgeRule:
    """A declarative rule: files by glob, a pattern with one group, an edge from file to template."""

    name: str
    glob: str
    pattern: str
    target: str = "{0}"
    kind: str = "references"
    confidence: float = 0.5

    @property
    def path_pattern(self) -> str:
        return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|\?|[^*?]+", self.glob)) + "$"


def extra_edges(texts: DataFrame, rule: EdgeRule) -> DataFrame:
    """(source, target, kind, confidence, resolved_by) a rule finds in ``texts`` (path, text)."""
    hit = texts.where(F.col("path").rlike(rule.path_pattern) & F.col("text").isNotNull())
    found = hit.select("path", F.explode(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(1))).alias("g")).distinct()
    before, _, after = rule.target.partition("{0}")
    return found.select(F.col("path").alias("source"), F.concat(F.lit(before), "g", F.lit(after)).alias("target"), F.lit(rule.kind).alias("kind"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.name).alias("resolved_by"))


def embedded_regions(texts: DataFrame) -> DataFrame:
    """(id, ordinal, tag, text) of fenced regions in ``texts`` (id, text), in order."""
    p = F.lit(r"(?s)```(\w*)[^\n]*\n(.*?)```")
    z = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(1)).alias("tag"), F.regexp_extract_all("text", p, F.lit(2)).alias("body"))
    return texts.where(F.col("text").isNotNull()).select("id", F.posexplode(z).alias("ordinal", "r")).select("id", "ordinal", F.col("r.tag").alias("tag"), F.col("r.body").alias("text"))


def definitions(texts: DataFrame) -> DataFrame:
    """(path, name) of definitions in ``texts`` (path, language, text)."""
    pattern = F.create_map(*(F.lit(x) for kv in DEFINITIONS.items() for x in kv))[F.col("language")]
    t = texts.withColumn("p", pattern).where(F.col("p").isNotNull() & F.col("text").isNotNull())
    return t.select("path", F.explode(F.expr("regexp_extract_all(text, p, 1)")).alias("name"))


def behaviour(path: Column, body_lines: Column) -> Column:
    """test, trivial or body, by where a symbol lies and how long it is."""
    return F.when(path.rlike(r"(?:^|/)(?:tests?|spec|__tests__)/|_test\.\w+$|\.(?:test|spec)\.\w+$"), "test").when(body_lines <= 3, "trivial").otherwise("body")


def parameters(nodes: DataFrame) -> DataFrame:
    """(symbol, position, name) of the parameters in a signature."""
    inner = F.regexp_extract("signature", r"\(([^()]*)\)", 1)
    p = nodes.where(F.col("signature").isNotNull()).select("symbol", F.posexplode(F.split(inner, r"\s*,\s*")).alias("position", "raw"))
    return p.select("symbol", "position", F.regexp_extract("raw", r"(?:mut )?(\w+)", 1).alias("name")).where(F.col("name") != "")


def value_flow(calls: DataFrame, params: DataFrame) -> DataFrame:
    """(source, target, position): what a caller passes at a position flows to the callee's
    parameter there. Only call sites with exactly one distinct target; a position either side
    lacks has no hop. ``calls`` (site_id, caller, target)."""
    one = calls.groupBy("site_id", "caller").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).where(F.col("n") == 1)
    a = params.select(F.col("symbol").alias("caller"), "position", F.concat_ws("#", "symbol", "name").alias("source"))
    b = params.select(F.col("symbol").alias("target"), "position", F.concat_ws("#", "symbol", "name").alias("slot"))
    return one.join(a, "caller").join(b, ["target", "position"]).select("source", F.col("slot").alias("target"), "position").distinct()

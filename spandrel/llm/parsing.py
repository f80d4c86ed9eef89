"""Source files that do not parse in the language of their extension."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small
from spandrel.functions.text import blank_to_null, plain_path
from spandrel.llm.arrow_rows import small_batches
from spandrel.llm.grammars import EXTENSIONS, furthest_failure
from spandrel.llm.toml_keys import repeated_key

_CONFLICT = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?![<=>|])")


def judge(language: str, text: str) -> tuple[int, int, str] | None:
    """None if valid, else (furthest code point, its line from 1, cause).

    Causes: ``conflict`` (a merge marker starts the line the parser got to), ``truncated`` (it got
    to the end), ``language`` (the text parses in another language), ``duplicate`` (a TOML key is
    defined twice, which no grammar can say), ``syntax``.
    """
    at = furthest_failure(language, text)
    if at is None:
        twice = repeated_key(text) if language == "toml" else None
        return None if twice is None else (twice, text.count("\n", 0, twice) + 1, "duplicate")
    line = text.rfind("\n", 0, at) + 1
    if any(_CONFLICT.match(text, i) for i in (line, text.find("\n", at) + 1)) or _CONFLICT.match(text, at):
        cause = "conflict"
    elif at >= len(text.rstrip()):
        cause = "truncated"
    elif any(furthest_failure(x, text) is None for x in EXTENSIONS.values() if x != language):
        cause = "language"
    else:
        cause = "syntax"
    return at, text.count("\n", 0, at) + 1, cause


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        sha, ext, at, line, cause = [], [], [], [], []
        for s, e, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            verdict = judge(EXTENSIONS[e], t)
            if verdict:
                sha.append(s)
                ext.append(e)
                at.append(verdict[0])
                line.append(verdict[1])
                cause.append(verdict[2])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(ext, pa.string()), pa.array(at, pa.int64()), pa.array(line, pa.int64()), pa.array(cause, pa.string())], ["git_sha", "ext", "failed_at", "line", "cause"])


def versions(files: DataFrame) -> DataFrame:
    """Distinct (repo, path, git_sha, ext) of file versions in a language we have a grammar of."""
    f = files.select("repo", plain_path("path").alias("path"), blank_to_null("git_sha").alias("git_sha")).where(F.col("git_sha").isNotNull() & F.col("path").isNotNull())
    f = f.withColumn("ext", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))
    return f.where(F.col("ext").isin(*EXTENSIONS)).distinct()


def unparsable(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo, path, git_sha, ext, failed_at, line, cause) of file versions that aren't valid.

    Each stored text is parsed once per extension it is stored under, however many paths share it.
    Texts are never sorted, and not shuffled either while the identifiers of all versions are few
    enough to be broadcast; beyond that they are hashed to them. Rows without git_sha, text or a
    known extension aren't judged; an empty text is valid except as JSON. Repeated rows give one
    case, of texts that differ under one git_sha that with the least place.
    """
    v = versions(files)
    keys = broadcast_if_small(v.select("git_sha", "ext").distinct())
    texts = contents.where(F.col("blob").isNotNull()).select(blank_to_null("git_sha").alias("git_sha"), "blob")
    work = texts.join(keys, "git_sha").select("git_sha", "ext", "blob")
    bad = work.mapInArrow(_judged, "git_sha string, ext string, failed_at bigint, line bigint, cause string")
    bad = bad.groupBy("git_sha", "ext").agg(F.min(F.struct("failed_at", "line", "cause")).alias("b")).select("git_sha", "ext", "b.*")
    return v.join(bad, ["git_sha", "ext"]).select("repo", "path", "git_sha", "ext", "failed_at", "line", "cause")


def failure_rates(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo, language, versions, invalid, conflict, truncated, rate) over all judged versions."""
    stored = contents.where(F.col("blob").isNotNull()).select(blank_to_null("git_sha").alias("git_sha")).distinct()
    every = versions(files).join(stored, "git_sha")
    bad = unparsable(files, contents).select("repo", "path", "git_sha", "cause")
    j = every.join(bad, ["repo", "path", "git_sha"], "left")
    lang = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))[F.col("ext")]
    n = lambda c: F.count(F.when(c, 1))
    g = j.groupBy("repo", lang.alias("language")).agg(
        F.count("*").alias("versions"), n(F.col("cause").isNotNull()).alias("invalid"), n(F.col("cause") == "conflict").alias("conflict"), n(F.col("cause") == "truncated").alias("truncated"))
    return g.withColumn("rate", F.round(F.col("invalid") / F.col("versions"), 6))

"""Generated, minified, third-party and data files among source files.

A random forest judges every version of a file from what its text and place look like: how well
it compresses, the entropy of its tokens, the lengths of its identifiers, the density of its
comments, the shape of its lines, whether it lies in a vendor directory, and how much of it also
occurs in known third-party files. It is trained on the files that say themselves what they are:
a notice of the tool or of the foreign project in their leading comment (or a bundler's banner)
marks one kind, the repository's own copyright notice the other. Notices are cut off before
features are taken, so the forest has to recognise files that carry none, and only its votes count.
Two kinds have no comments to say anything in: data kept as code, for which blobs made from a fixed
seed stand in, and a repository's own small JSON and TOML, hand-written by definition. A path has one
class in all its versions.

Texts are looked at where they are read; from then on only features and a few hashes are shuffled.
"""

from __future__ import annotations

import base64
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small, stored
from spandrel.functions.text import blank_to_null, plain_path
from spandrel.llm.arrow_rows import small_batches

TRAIN_ROWS = 20_000  # labelled rows the forest is fitted on, at most; all rows are judged
BLOBS = 240
SMALL_CONFIG = 65_536  # bytes up to which JSON or TOML outside vendor directories is a repository's own, whatever the votes
_GRAM = 4  # lines hashed together
_WINDOW = 4  # of so many such hashes the least is kept

_LEAD = re.compile(r"\A﻿?(?:#![^\n]*\n)?(?P<lead>(?:\s*(?://[^\n]*|/\*[\s\S]*?\*/|#(?!include|define|if|pragma|\[|!)[^\n]*|--[^\n]*|<!--[\s\S]*?-->))*)")
_MAP = re.compile(r"\n?//[#@] sourceMappingURL=\S+\s*\Z")
_GENERATED = re.compile(
    r"(?im)^[\s/*#<>!-]*(?:this file (?:was|is|has been) )?(?:code |file )?(?:auto(?:matically)?[ -]?)?generated (?:by|from)\b|@generated\b|<auto-?generated>|\bauto-?generated (?:file|from|by)\b|\bautogenerated\b|automatically generated|g[ée]n[ée]r[ée] automatiquement|automatisch (?:erzeugt|generiert)|generado autom[áa]ticamente|\bcode generated\b.*\bdo not edit\b|^[\s/*#]*source: \S+\.(?:proto|idl|thrift|fbs|avsc)\b|produced by \S+-gen\b")
_FOREIGN = re.compile(r"(?i)\bupstream at\b|\(c\) \d{4}(?:-\d{4})? the \S+ authors|copyright \(c\) \d{4}(?:-\d{4})? \S+ project|^[\s/*#]*(?:this is )?[\w.-]+ (?:- version |v)?\d+\.\d+\.\d+ ?[,|-]", re.M)
_BUNDLE = re.compile(r"\A﻿?\s*/\*!")
_HOLDER = re.compile(r"(?i)copyright (?:\(c\) )?\d{4}(?:-\d{4})? the ([\w.-]+) contributors")
_VENDOR = r"(?i)(?:^|/)_?(?:vendor|vendored|third[_-]?party|thirdparty|node_modules|bower_components|external|extern|deps|Pods|Carthage)/"
_TOOLED = r"(?i)(?:\.(?:min|pb|g|gen|generated|bundle|bundled)\.\w+|_pb2(?:_grpc)?\.py|[-_.]generated\.\w+|(?:^|/)chunk-[0-9a-f]{6,}\.js)$|(?:^|/)(?:generated|gen|dist|target|out|node_modules)/"
_CONFIG = r"(?i)\.(?:json|toml)$"
#: A stand-in for a text kept elsewhere says nothing about the text.
_POINTER = re.compile(r"\A﻿?version https?://\S+\s+oid \w+:[0-9a-f]+\s+size \d+\s*\Z")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|(?m:^[ \t]*#(?!include|define|\[)[^\n]*)|\"\"\"[\s\S]*?\"\"\"")
_DIGITS = re.compile(r"\d+")

FEATURES = ("compression", "entropy", "entropy_share", "id_length", "id_short", "id_distinct", "comments", "line_mean", "line_max", "space", "digits",
            "strings", "string_max", "repeated_lines", "tokens_per_id", "length")
#: What a path alone says, and how much of a text occurs in known third-party files.
PLACE = ("vendored", "tooled", "overlap")


def notice(text: str) -> tuple[str, str | None]:
    """(kind of notice, copyright holder): generated, bundle, foreign or empty."""
    lead = _LEAD.match(text)["lead"]
    holder = _HOLDER.search(lead)
    kind = ""
    if _GENERATED.search(lead):
        kind = "generated"
    elif _FOREIGN.search(lead):
        kind = "foreign"
    elif _BUNDLE.match(text) or _MAP.search(text):
        kind = "bundle"
    return kind, holder[1] if holder else None


def body(text: str) -> str:
    """The text without what a notice may stand in."""
    return _MAP.sub("", text[_LEAD.match(text).end():]).strip("\r\n")


def features(text: str) -> list[float]:
    """Content features of a text without its notices; an empty one gives zeros."""
    if not text.strip():
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    tokens = _TOKEN.findall(text)
    n = max(1, len(tokens))
    counts = Counter(tokens)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    ids = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    k = max(1, len(ids))
    lines = text.splitlines()
    filled = [x for x in map(str.strip, lines) if x]
    shapes = Counter(_DIGITS.sub("0", x) for x in filled if len(x) > 3)
    m = max(1, sum(shapes.values()))
    strings = [len(s) for s in _STRING.findall(text)]
    size = len(text)
    return [
        len(zlib.compress(raw, 1)) / len(raw), entropy, entropy / math.log2(n) if n > 1 else 0.0, sum(map(len, ids)) / k, sum(len(t) <= 2 for t in ids) / k, len(set(ids)) / k,
        sum(len(c) for c in _COMMENT.findall(text)) / size, size / max(1, len(lines)), max(map(len, lines), default=0), sum(map(text.count, " \t\n")) / size,
        sum(map(len, _DIGITS.findall(text))) / size, sum(strings) / size, max(strings, default=0) / size, 1 - len(shapes) / m, n / k, math.log2(size)]


def line_fingerprints(text: str) -> list[int]:
    """Winnowed hashes of every few lines, without indentation and short lines."""
    lines = [s.encode("utf-8", "surrogatepass") for s in map(str.strip, text.splitlines()) if len(s) > 10]
    if len(lines) < _GRAM:
        return []
    h = np.array([xxhash.xxh64_intdigest(b"\n".join(lines[i : i + _GRAM])) for i in range(len(lines) - _GRAM + 1)], np.uint64).view(np.int64)
    if len(h) <= _WINDOW:
        return [int(h.min())]
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, _WINDOW).min(axis=1)).tolist()


def data_blobs(n: int = BLOBS, seed: int = 7) -> list[list[float]]:
    """Features of made-up data kept as code: byte tables, escapes, base64, numbers, words."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        size, kind = r.randint(400, 6000), i % 6
        name = r.choice(("table", "blob", "font", "icons", "weights", "points"))
        if kind == 0:
            text = "static const unsigned char %s[] = {\n%s\n};" % (name, ",\n".join("  " + ", ".join(f"0x{r.randrange(256):02x}" for _ in range(12)) for _ in range(size // 72)))
        elif kind == 1:
            text = '%s = "%s"' % (name, "".join(f"\\x{r.randrange(256):02x}" for _ in range(size // 4)))
        elif kind == 2:
            text = '%s = "data:;base64,%s"' % (name, base64.b64encode(r.randbytes(size * 3 // 4)).decode())
        elif kind == 3:
            text = "%s = [\n%s\n]" % (name, "\n".join(f"  [{r.uniform(0, 99):.4f}, {r.uniform(0, 999):.4f}, {r.randrange(9)}]," for _ in range(size // 26)))
        elif kind == 4:
            text = "%s = [%s]" % (name, ", ".join(str(r.randrange(100000)) for _ in range(size // 7)))
        else:
            line = r.choice((60, 76, 100))
            raw = base64.b64encode(r.randbytes(size * 3 // 4)).decode()
            text = "%s = (\n%s\n)" % (name, "\n".join(f'    "{raw[k:k + line]}"' for k in range(0, len(raw), line)))
        out.append(features(text))
    return out


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        kind, holder, size, feats, prints = [], [], [], [], []
        for t in b.column(1).to_pylist():
            size.append(len(t.encode("utf-8", "surrogatepass")))
            if _POINTER.match(t):
                for column, nothing in ((kind, ""), (holder, None), (feats, None), (prints, [])):
                    column.append(nothing)
                continue
            k, h = notice(t)
            rest = body(t)
            kind.append(k)
            holder.append(h)
            feats.append(features(rest))
            prints.append(line_fingerprints(rest))
        columns = [b.column(0), pa.array(kind, pa.string()), pa.array(holder, pa.string()), pa.array(size, pa.int64()), pa.array(feats, pa.list_(pa.float64())), pa.array(prints, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["git_sha", "notice", "holder", "bytes", "feats", "prints"])


def _overlap(examined: DataFrame) -> DataFrame:
    """(path, overlap): the share of a version's fingerprints that a known third-party file at
    another path has too, the greatest of a path's versions, for paths with any. Known ones are
    folded to two paths per fingerprint, so a hot one costs no more than any other."""
    prints = examined.select("path", "git_sha", "foreign", F.size("prints").alias("n"), F.explode("prints").alias("h"))
    known = prints.where("foreign").groupBy("h").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    j = prints.join(broadcast_if_small(known), "h").where((F.col("lo") != F.col("path")) | (F.col("hi") != F.col("path")))
    each = j.groupBy("path", "git_sha").agg((F.count("*") / F.first("n")).alias("overlap"))
    return each.groupBy("path").agg(F.max("overlap").alias("overlap"))


def judged_paths(files: DataFrame, contents: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 30, depth: int = 9, seed: int = 11, use: Sequence[str] = FEATURES + PLACE,
                 small_config: int = SMALL_CONFIG) -> DataFrame:
    """(path, score, noticed, vendored, bytes): the mean of the forest's votes over a path's
    versions, whether one of them carries a notice, whether it lies in a vendor directory, and the
    size of its longest version.

    ``use`` names the features the forest may see. Paths without stored text are judged by their
    place alone, as are mere pointers to large files (their content features are blank, and so are
    those of a copy of each training row). Null and blank paths are left out; with labels of one
    kind only the score is null.
    """
    v = files.select(plain_path("path").alias("path"), blank_to_null("git_sha").alias("git_sha")).where(F.col("path").isNotNull() & (F.col("path") != "")).distinct()
    texts = contents.where(F.col("blob").isNotNull()).select(blank_to_null("git_sha").alias("git_sha"), "blob").where(F.col("git_sha").isNotNull())
    seen = texts.mapInArrow(_examined, "git_sha string, notice string, holder string, bytes bigint, feats array<double>, prints array<bigint>").dropDuplicates(["git_sha"])
    repos = v.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repo")).distinct()
    e = v.join(seen, "git_sha", "left").withColumn("repo", F.split_part("path", F.lit("/"), F.lit(1)))
    e = e.join(broadcast_if_small(repos.select(F.col("repo").alias("holder"), F.lit(True).alias("holder_is_repo"))), "holder", "left")
    vendored = F.col("path").rlike(_VENDOR)
    stranger = F.col("holder").isNotNull() & F.col("holder_is_repo").isNull()
    small = F.col("path").rlike(_CONFIG) & ~vendored & (F.col("bytes") <= small_config)
    e = e.select(
        "path", "git_sha", "bytes", "feats", "prints", vendored.cast("double").alias("vendored"), F.col("path").rlike(_TOOLED).cast("double").alias("tooled"),
        (vendored | (F.col("notice") == "foreign") | stranger).alias("foreign"),
        F.when(F.col("notice").isin("generated", "bundle", "foreign") | stranger, 1.0).when((F.col("holder") == F.col("repo")) | small, 0.0).alias("label"))
    e = stored(e)
    rows = e.join(broadcast_if_small(_overlap(e)), "path", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    names = [*(n for n in FEATURES if n in use), *(n for n in PLACE if n in use)]
    text = [FEATURES.index(n) for n in names if n in FEATURES]
    place = [n for n in names if n in PLACE]
    blank = [F.lit(-1.0)] * len(text)
    x = F.when(F.col("feats").isNotNull(), F.array(*(F.col("feats")[i] for i in text), *place)).otherwise(F.array(*blank, *place))
    rows = rows.select("path", "label", "vendored", "bytes", x.alias("x"), F.col("feats").isNotNull().alias("read"))
    labelled = rows.where(F.col("label").isNotNull() & F.col("read"))
    train = labelled.orderBy(F.xxhash64("path", "x"), "path").limit(train_rows).select("label", "x")
    unread = train.select("label", F.array(*blank, *(F.col("x")[len(text) + i] if n != "overlap" else F.lit(0.0) for i, n in enumerate(place))).alias("x"))
    spark = files.sparkSession
    blobs = spark.createDataFrame([(1.0, [*(float(b[i]) for i in text), *(0.0 for _ in place)]) for b in data_blobs()], "label double, x array<double>")
    train = stored(train.unionByName(unread).unionByName(blobs)).select("label", array_to_vector("x").alias("features"))
    if train.select("label").distinct().count() < 2:
        scored = rows.withColumn("p", F.lit(None).cast("double"))
    else:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(train)
        scored = model.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("p", vector_to_array("probability")[1])
    return scored.groupBy("path").agg(F.avg("p").alias("score"), F.max(F.coalesce(F.col("label") == 1.0, F.lit(False))).alias("noticed"), F.max("vendored").alias("vendored"), F.max("bytes").alias("bytes"))


def not_handwritten(files: DataFrame, contents: DataFrame, threshold: float = 0.5, small_config: int = SMALL_CONFIG, **forest) -> DataFrame:
    """Distinct plain paths of files no person of the repository wrote: those the forest votes for,
    but for JSON and TOML outside vendor directories of up to ``small_config`` bytes in every
    version, which is a repository's own by definition."""
    j = judged_paths(files, contents, small_config=small_config, **forest)
    own = F.col("path").rlike(_CONFIG) & (F.col("vendored") == 0) & (F.coalesce("bytes", F.lit(0)) <= small_config)
    return j.where((F.col("score") >= threshold) & ~own).select("path")

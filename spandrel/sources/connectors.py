"""Sources and sinks beside the Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions.text import plain_path

LARGEST = 1 << 20


#: Directories no source is looked for in (fixed values).
SKIPPED = (".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv")


def walk_source_tree(spark: SparkSession, root: str, glob: str = "*", largest: int = LARGEST, longest_line: int = 5_000, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, size, text, skipped) of the files under a directory but for those in ``skipped``
    directories. A file that isn't read has no text and says why: ``too_large`` (judged by the
    listing, before contents are used), ``binary`` (a zero byte) or ``minified`` (lines of
    ``longest_line`` characters on average)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    raw = raw.where(~F.exists(F.split(below, "/"), lambda p: p.isin(*skipped)))
    text = F.when(F.col("length") <= largest, F.decode("content", "UTF-8"))
    t = raw.select(plain_path("path").alias("path"), F.col("length").alias("size"), text.alias("text"))
    why = F.when(F.col("text").isNull(), "too_large").when(F.col("text").contains("\x00"), "binary").when(F.length("text") / F.size(F.split("text", "\n")) >= longest_line, "minified")
    t = t.withColumn("skipped", why)
    return t.select("path", "size", F.when(F.col("skipped").isNull(), F.col("text")).alias("text"), "skipped")


def file_digest(text: Column | str) -> Column:
    """16 hex digits that change with a text."""
    return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


_EVIDENCE = "producer string, snapshot string, generation bigint, facts array<struct<fact_id:string,source:string,target:string,kind:string,file:string,line:int,col:int,confidence:double>>"


def scan_evidence(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, refused) of evidence envelopes (text): a fact has an id, both ends and a kind, and a
    confidence in [0, 1]; an envelope has a producer, a snapshot and distinct fact ids, and is
    refused whole, with the reason, if anything is wrong with it."""
    e = texts.select("text", F.from_json("text", _EVIDENCE).alias("e")).select("text", "e.*")
    bad = F.exists("facts", lambda f: f["fact_id"].isNull() | f["source"].isNull() | f["target"].isNull() | f["kind"].isNull() | ~F.coalesce(f["confidence"].between(0, 1), F.lit(False)))
    twice = F.size(F.array_distinct(F.transform("facts", lambda f: f["fact_id"]))) < F.size("facts")
    why = (F.when(F.col("producer").isNull() | F.col("snapshot").isNull() | F.col("facts").isNull(), "envelope").when(bad, "fact").when(twice, "repeated"))
    e = e.withColumn("why", why)
    good = e.where(F.col("why").isNull()).select("producer", "snapshot", "generation", F.explode("facts").alias("f")).select("producer", "snapshot", "generation", "f.*")
    return good, e.where(F.col("why").isNotNull()).select("text", "why")


#: One step of a job, a rule and a fact template, as their languages write them (fixed values).
_JCL_STEP, _JCL_DD = r"(?m)^//(\w+)[ \t]+EXEC[ \t]+(?:PGM=)?(\w+)", r"(?m)^//(?:\w+\.)?(\w+)[ \t]+DD[ \t]+[^\n]*?DSN=([\w.&()]+)"
_DRL_RULE, _CLIPS_RULE = r'(?m)^[ \t]*rule[ \t]+(?:"([^"\n]+)"|(\w+))', r"\(defrule[ \t\n]+([^\s()]+)"


def scan_jcl(texts: DataFrame) -> DataFrame:
    """(file, ordinal, name, kind, target) of job control texts (file, text): steps run a program,
    data definitions name a data set. Comment lines (``//*``) are left out."""
    body = F.regexp_replace("text", r"(?m)^//\*[^\n]*$", "")
    def found(p: str, kind: str) -> DataFrame:
        z = F.arrays_zip(F.regexp_extract_all(body, F.lit(p), F.lit(1)).alias("name"), F.regexp_extract_all(body, F.lit(p), F.lit(2)).alias("target"))
        return texts.where(F.col("text").isNotNull()).select("file", F.posexplode(z).alias("ordinal", "z")).select("file", "ordinal", "z.name", F.lit(kind).alias("kind"), "z.target")
    return found(_JCL_STEP, "step").unionByName(found(_JCL_DD, "data"))


def scan_rules(texts: DataFrame) -> DataFrame:
    """(file, language, name) of rules in rule texts (file, text): Drools by ``.drl``, CLIPS by
    ``.clp``; comments are left out."""
    t = texts.where(F.col("text").isNotNull())
    drl = F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)^[ \t]*(?://|#)[^\n]*$", "")
    clp = F.regexp_replace("text", r"(?m);[^\n]*$", "")
    z = F.arrays_zip(F.regexp_extract_all(drl, F.lit(_DRL_RULE), F.lit(1)).alias("a"), F.regexp_extract_all(drl, F.lit(_DRL_RULE), F.lit(2)).alias("b"))
    a = t.where(F.col("file").endswith(".drl")).select("file", F.lit("drools").alias("language"), F.explode(z).alias("z")).select("file", "language", F.coalesce(F.nullif("z.a", F.lit("")), "z.b").alias("name"))
    b = t.where(F.col("file").endswith(".clp")).select("file", F.lit("clips").alias("language"), F.explode(F.regexp_extract_all(clp, F.lit(_CLIPS_RULE), F.lit(1))).alias("name"))
    return a.unionByName(b).distinct()


def html_to_text(c: Column | str) -> Column:
    """Readable text of an HTML column: scripts and tags gone, entities of XML put back."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6])[^>]*>", "\n"), r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


_TFSTATE = "resources array<struct<mode:string,type:string,name:string,instances:array<struct<index_key:string,dependencies:array<string>>>>>"


def scan_tfstate(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resource nodes (symbol, name, kind, origin) and depends_on references (source, target) of
    state files in ``texts`` (text). Unreadable files give nothing."""
    r = texts.select(F.explode(F.from_json("text", _TFSTATE)["resources"]).alias("r")).where(F.col("r.mode") == "managed")
    r = r.select(F.concat_ws(".", "r.type", "r.name").alias("symbol"), F.col("r.name").alias("name"), F.col("r.type").alias("kind"), "r.instances")
    refs = r.select(F.col("symbol").alias("source"), F.explode("instances").alias("i")).select("source", F.explode("i.dependencies").alias("target")).distinct()
    return r.select("symbol", "name", "kind", F.lit("live").alias("origin")).distinct(), refs


#: Types of the clouds' inventories by what they are (fixed values).
CLOUD_KINDS = {"AWS::S3::Bucket": "bucket", "Microsoft.Storage/storageAccounts": "bucket", "storage.googleapis.com/Bucket": "bucket",
               "AWS::EC2::Instance": "instance", "Microsoft.Compute/virtualMachines": "instance", "compute.googleapis.com/Instance": "instance"}


def scan_cloud(texts: DataFrame) -> DataFrame:
    """(symbol, name, kind, origin) of inventories: a JSON array of (type, id, name) per text."""
    item = F.explode(F.from_json("text", "array<struct<type:string,id:string,name:string>>")).alias("r")
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in CLOUD_KINDS.items() for x in kv))[F.col("r.type")], F.concat(F.lit("other:"), "r.type"))
    return texts.select(item).where(F.col("r.id").isNotNull()).select(F.col("r.id").alias("symbol"), F.col("r.name").alias("name"), kind.alias("kind"), F.lit("live").alias("origin")).distinct()


_BATCH = "op string, symbol string, key string, value string, kind string, name string, _corrupt string"


def read_write_batch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an NDJSON batch of node and annotation writes, and those that are no valid write."""
    raw = spark.read.schema(_BATCH).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("_corrupt").isNull() & F.col("symbol").isNotNull() & (((F.col("op") == "node") & F.col("name").isNotNull()) | ((F.col("op") == "annotate") & F.col("key").isNotNull()))
    ok = F.coalesce(ok, F.lit(False))
    return raw.where(ok).drop("_corrupt"), raw.where(~ok)


def export_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object per row, in as many files as there are partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)

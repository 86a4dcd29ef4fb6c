"""Other files of the archive: transcripts, logs, vocabularies, periods, evaluation cases."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lorespark.functions.text import media_file, trim_all, vocab_key
from lorespark.operators.merge import first_seen

MANIFEST = "kind string, url string, peer_id bigint, msg_id bigint, att_type string, file string"
DOWNLOADS = "url string, path string, peer_id bigint, msg_id bigint, ok boolean, info string"
RUN_LOG = "ts string, stage string, key string, ok boolean, info string"
META = "msg_id bigint, page string, idx int, date string, sender string, whisper_prompt string, ogg string, duration_s double, wall_s double, ok boolean, attempts int, max_repeat int, suspect boolean, settings string, batch string, error string"
CASES = "query string, peer bigint, date date, note string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _named(df: DataFrame, suffix: str) -> DataFrame:
    """name, peer_id, msg_id of files <peer>-<message><suffix>; the peer may be negative."""
    rx = r"/((-?\d+)-(\d+))" + suffix.replace(".", r"\.") + "$"
    return (df.withColumn("name", F.regexp_extract("path", rx, 1)).where("name <> ''")
            .withColumn("peer_id", F.regexp_extract("path", rx, 2).cast("long")).withColumn("msg_id", F.regexp_extract("path", rx, 3).cast("long")))


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and descriptions side by side; either may be missing."""
    b = spark.read.format("binaryFile").load(folder).select("path", F.col("content").cast("string").alias("content"))
    text = _named(b.where(F.col("path").endswith(".txt")), ".txt").select("name", "peer_id", "msg_id", F.col("content").alias("transcript"))
    meta = _named(b.where(F.col("path").endswith(".meta.json")), ".meta.json").select("name", F.from_json("content", META).alias("meta"))
    return text.join(meta, "name", "full").withColumn("peer_id", F.coalesce("peer_id", F.regexp_extract("name", r"^(-?\d+)-", 1).cast("long"))).withColumn("msg_id", F.coalesce("msg_id", F.regexp_extract("name", r"-(\d+)$", 1).cast("long")))


def read_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """(peer_id, term, gloss, source, first_batch, first_date) of <peer>.md: the manual list in its text block, and the collected section."""
    t = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name()).withColumn("peer_id", F.regexp_extract("path", r"/(-?\d+)\.md$", 1).try_cast("long")).where("peer_id is not null")
    block = F.regexp_extract("value", r"(?s)```text\n(.*?)```", 1)
    manual = (t.select("peer_id", F.explode(F.split(block, "[,\n]")).alias("term")).select("peer_id", trim_all("term").alias("term")).where("length(term) > 1 and length(term) <= 60")
              .select("peer_id", "term", F.lit(None).cast("string").alias("gloss"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("first_batch"), F.lit(None).cast("string").alias("first_date")))
    rx = r"(?m)^- (.+?) — (.+?) \*\(встретилось: ([^,)]+), ([^)]+)\)\*"
    auto = t.select("peer_id", F.explode(F.arrays_zip(*[F.regexp_extract_all("value", F.lit(rx), i).alias(f"c{i}") for i in (1, 2, 3, 4)])).alias("x"))
    auto = auto.select("peer_id", F.col("x.c1").alias("term"), F.col("x.c2").alias("gloss"), F.lit("sonnet").alias("source"), F.col("x.c3").alias("first_batch"), F.col("x.c4").alias("first_date"))
    return manual.unionByName(auto).dropDuplicates(["peer_id", "term", "source"])


def read_periods(spark: SparkSession, folder: str) -> DataFrame:
    """(peer_id, year_from, description, whisper_prompt) of <peer>-periods.md: sections '### … YYYY год …'; of a repeated year the last."""
    t = spark.read.text(folder, wholetext=True).withColumn("peer_id", F.regexp_extract(F.input_file_name(), r"/(-?\d+)-periods\.md$", 1).try_cast("long")).where("peer_id is not null")
    s = t.select("peer_id", F.posexplode(F.split("value", r"(?m)^###")).alias("i", "s")).withColumn("year_from", F.regexp_extract("s", r"^[^\n]*?(\d{4})\s+год", 1).try_cast("int")).where("year_from is not null")
    s = s.withColumn("whisper_prompt", trim_all(F.regexp_extract("s", r"(?s)```text\n(.*?)```", 1)))
    s = s.withColumn("description", F.substring(trim_all(F.regexp_replace(F.regexp_replace("s", r"^[^\n]*\n?", ""), r"(?s)```.*?```", "")), 1, 2500))
    return first_seen(s, ["peer_id", "year_from"], [F.desc("i")]).select("peer_id", "year_from", "description", "whisper_prompt")


def new_terms(found: DataFrame, known: DataFrame) -> DataFrame:
    """Terms to append: at least two characters, and no known term of the peer has their key in it.  A peer's vocabulary is one text."""
    text = known.groupBy("peer_id").agg(F.lower(F.array_join(F.collect_list("term"), "\n")).alias("__text"))
    f = found.withColumn("key", vocab_key("term")).where("length(key) >= 2").join(text, "peer_id", "left")
    return f.where(~F.coalesce(F.col("__text").contains(F.col("key")), F.lit(False))).drop("__text").dropDuplicates(["peer_id", "key"])


# Fixed value: the heading under which collected terms stand.
SECTION = "## Собранные термины"


def appended(vocab: DataFrame, terms: DataFrame, batch: str, day: str) -> DataFrame:
    """(peer_id, value): the vocabularies with new terms (peer_id, term, gloss) under their section; a term that the text has already is left out."""
    line = F.concat(F.lit("- "), "term", F.lit(" — "), F.coalesce("gloss", F.lit("")), F.lit(f" *(встретилось: {batch}, {day})*"))
    fresh = (terms.withColumn("key", vocab_key("term")).where("length(key) >= 2").join(vocab.select("peer_id", F.lower("value").alias("__low")), "peer_id")
             .where(~F.col("__low").contains(F.col("key"))).dropDuplicates(["peer_id", "key"]).groupBy("peer_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("__new")))  # the terms of one batch
    base = F.when(F.col("value").contains(SECTION), F.rtrim("value")).otherwise(F.concat(F.rtrim("value"), F.lit("\n\n" + SECTION)))
    return vocab.join(fresh, "peer_id", "left").select("peer_id", F.when(F.col("__new").isNull(), F.col("value")).otherwise(F.concat(base, F.lit("\n"), F.col("__new"), F.lit("\n"))).alias("value"))


def with_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows (url) whose file, named after the address, is in the listing (path)."""
    have = listing.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("__file")).distinct()
    return manifest.withColumn("__file", media_file("url")).join(have, "__file", "left_semi").drop("__file")


def to_reset(meta: DataFrame, settings: str | None = None, bad: DataFrame | None = None) -> DataFrame:
    """(name) of transcripts to be made anew: of other settings than the current, or found bad (name)."""
    old = meta.where(~F.coalesce(F.col("settings") == settings, F.lit(False))).select("name") if settings is not None else meta.select("name").limit(0)
    return (old.unionByName(bad.select("name")) if bad is not None else old).distinct()


def reset(meta: DataFrame, names: DataFrame) -> DataFrame:
    """What stays of the transcripts, to be written to a new path."""
    return meta.join(names.select("name").distinct(), "name", "left_anti")


@F.pandas_udf(DoubleType())
def ogg_duration(tail: pd.Series) -> pd.Series:
    """Seconds: the granule position of the last page, at 48 kHz; 0 without one."""
    def one(b: bytes | None) -> float:
        if not b:
            return 0.0
        i = bytes(b[-65536:]).rfind(b"OggS")
        b = bytes(b[-65536:])
        return struct.unpack_from("<q", b, i + 6)[0] / 48000 if i >= 0 and i + 14 <= len(b) else 0.0
    return tail.map(one)


def columns_differ(df: DataFrame, ddl_columns: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns of a table against its schema."""
    have = set(df.columns)
    return [c for c in ddl_columns if c not in have], sorted(have - set(ddl_columns))


def schema_differs(df: DataFrame, ddl: str, keys: list[str] | None = None) -> list[str]:
    """What is wrong with a table against its DDL: missing and unexpected columns, other types, keys that are null or repeat."""
    from pyspark.sql.types import StructType
    want, have = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl)}, {f.name: f.dataType.simpleString() for f in df.schema}
    out = [f"missing {c}" for c in want if c not in have] + [f"unexpected {c}" for c in have if c not in want]
    out += [f"{c} is {have[c]}, not {want[c]}" for c in want if c in have and have[c] != want[c]]
    if keys and all(k in have for k in keys):
        null = df.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count()
        twice = df.groupBy(*keys).count().where("count > 1").limit(1).count()
        out += ["null key"] * bool(null) + ["repeated key"] * bool(twice)
    return out

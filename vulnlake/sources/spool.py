"""Spool files: S1-S3, S16, X13: newline-delimited JSON with an atomic publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vulnlake.operators.normalize import parse_envelopes, text

# --- fixed values ---------------------------------------------------------
READY, PROCESSING, STAGED, FAILED, PARTIAL = ".ndjson.ready", ".ndjson.processing", ".ndjson.staged", ".ndjson.failed", ".ndjson.partial"
NOT_SPOOL = "first-epss-"
#: The exploit list that is delivered as one full snapshot per file.
SNAPSHOT_SOURCE = "nuclei-templates"
# --------------------------------------------------------------------------


def scan_spool(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, run, sequence, line_no, value``: lines in order of run and
    sequence; blank lines and score snapshots left out. An empty folder gives no rows.

    Files are read whole as lines, in parallel; the line number is the place in
    the file as read.
    """
    lines = spark.read.option("pathGlobFilter", f"*{READY}").text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    lines = lines.withColumn("name", base).where(~F.col("name").startswith(NOT_SPOOL) & (F.trim("value") != ""))
    named = lines.withColumns(
        {
            "run": F.regexp_replace("name", r"(-s\d+)?\.ndjson\.ready$", ""),
            "sequence": F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(name, '-s(\\d+)\\.ndjson', 1), '') as int)"), F.lit(0)),
            "line_no": F.monotonically_increasing_id(),
        }
    )
    return named.select("file", "run", "sequence", "line_no", "value")


def judge_files(lines: DataFrame) -> DataFrame:
    """``file, good, bad, source, sources, accepted``: a file with any bad
    line or with several sources is refused whole, and so is a file of the snapshot
    source that is not one complete snapshot of one revision."""
    parsed = parse_envelopes(lines)
    v = F.col("envelope")
    source, revision = F.lower(text(v, "$.sourceCode")), text(v, "$.snapshotId")
    whole = revision.isNotNull() & F.coalesce(F.try_variant_get(v, "$.snapshotComplete", "boolean"), F.lit(False)) & text(v, "$.sourceMode").isNull()
    broken = (source == SNAPSHOT_SOURCE) & ~whole
    return parsed.groupBy("file").agg(
        F.count_if("is_valid").alias("good"), F.count_if(~F.col("is_valid") | F.coalesce(broken, F.lit(False))).alias("bad"), F.max(source).alias("source"),
        F.count_distinct(source).alias("sources"), F.count_distinct(F.when(source == SNAPSHOT_SOURCE, revision)).alias("revisions"),
    ).withColumn("accepted", (F.col("bad") == 0) & (F.col("sources") == 1) & (F.col("revisions") <= 1)).drop("revisions")


def accepted_envelopes(lines: DataFrame) -> DataFrame:
    """Parsed lines of accepted files."""
    files = judge_files(lines).where("accepted").select("file")
    return parse_envelopes(lines).join(files, "file", "left_semi")


def last_envelopes(envelopes: DataFrame) -> DataFrame:
    """D1 over a spool: the last line of each source and record, without case."""
    v = F.col("envelope")
    keys = [F.lower(text(v, "$.sourceCode")), F.lower(F.coalesce(text(v, "$.externalId"), text(v, "$.externalKey")))]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("run").desc(), F.col("sequence").desc(), F.col("line_no").desc()))
    return envelopes.withColumn("place", place).where("place = 1").drop("place")


class SpoolFiles:
    """S3: states of spool files, kept in their names; renames are atomic."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self.folder = folder
        self._fs = self._path(folder).getFileSystem(context._jsc.hadoopConfiguration())

    def names(self, state: str = READY) -> list[str]:
        """Files in a state, by run and sequence."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted((n for n in found if n.endswith(state)), key=lambda n: (n.split("-s")[0], len(n), n))

    def queue_sizes(self) -> dict[str, int]:
        """Files by state."""
        return {state.removeprefix(".ndjson."): len(self.names(state)) for state in (READY, PROCESSING, STAGED, FAILED, PARTIAL)}

    def move(self, name: str, before: str, after: str) -> str:
        moved = name.removesuffix(before) + after
        if not self._fs.rename(self._path(f"{self.folder}/{name}"), self._path(f"{self.folder}/{moved}")):
            raise OSError(f"cannot rename {name}")
        return moved

    def recover(self) -> list[str]:
        """Files left in processing by a run that died are ready again."""
        return [self.move(n, PROCESSING, READY) for n in self.names(PROCESSING)]

    def finish(self, judged: DataFrame, also_refused: list[str] = ()) -> tuple[list[str], list[str]]:
        """Accepted files are staged and refused ones set aside; gives the names of both.
        A file that is gone already (a batch that ran again) is passed over."""
        accepted, refused = [], []
        for row in judged.select("file", "accepted").toLocalIterator():  # one row per file
            name = row["file"].rsplit("/", 1)[1]
            (accepted if row["accepted"] and name not in also_refused else refused).append(name)
        ready = set(self.names(READY))
        for name in ready.intersection(refused):
            self.move(name, READY, FAILED)
        for name in ready.intersection(accepted):
            self.move(name, READY, STAGED)
        return accepted, refused

    def clear_staged(self) -> int:
        """S3: deletes staged files, once what was made of them is safe."""
        names = self.names(STAGED)
        for name in names:
            self._fs.delete(self._path(f"{self.folder}/{name}"), False)
        return len(names)


def write_spool(df: DataFrame, folder: str, run: str, records_per_file: int = 5000) -> list[str]:
    """Rows as spool files of at most so many lines, published by rename
    only after all are written."""
    spark = df.sparkSession
    staged = f"{folder}/_staging-{run}"
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.option("maxRecordsPerFile", records_per_file).mode("overwrite").text(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in fs.listStatus(path(staged)) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
    names = [f"{run}-s{n:04d}" for n in range(1, len(parts) + 1)]
    for part, name in zip(parts, names):
        fs.rename(path(f"{staged}/{part}"), path(f"{folder}/{name}{PARTIAL}"))
    for name in names:
        fs.rename(path(f"{folder}/{name}{PARTIAL}"), path(f"{folder}/{name}{READY}"))
    fs.delete(path(staged), True)
    return [f"{name}{READY}" for name in names]

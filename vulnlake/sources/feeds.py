"""Feed formats: S4-S11, S13-S15, N22, N23, N25, N31, N34-N36, N38, X6; of N37 the ExploitDB rows (others in ``exploit_feeds``)."""

from __future__ import annotations

import hashlib
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.functions.identity import normalize
from vulnlake.functions.packages import join_package_version, parse_cpe, parse_purl, present, purl_ecosystem
from vulnlake.functions.text import artifact_type, exploit_class, extract_cves, language_of_path, maturity

# Scores --------------------------------------------------------------------


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A gzipped CSV of scores with one comment line; strict types; keys upper case."""
    rows = spark.read.csv(path, schema="cve string, epss double, percentile double", comment="#", header=True, mode="FAILFAST")
    return rows.select(normalize(F.col("cve")).alias("vulnerability_key"), F.col("epss").alias("score"), "percentile")


def verified_snapshot(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """The scores of a file whose size and SHA-256 are those of its manifest;
    else ValueError."""
    said = spark.read.text(manifest, wholetext=True).select(F.from_json("value", "contentHash string, bytes long, sourceCode string, observedAt string").alias("m")).select("m.*").first()
    file = spark.read.format("binaryFile").load(path).select(F.length("content").alias("n"), F.sha2("content", 256).alias("h")).first()
    if said is None or file is None or said["bytes"] != file["n"] or (said["contentHash"] or "").lower() != file["h"]:
        raise ValueError("the snapshot does not match its manifest")
    return read_scores(spark, path).withColumn("observed_at", F.lit(said["observedAt"]))


def content_changed(spark: SparkSession, path: str, known_hash: str | None) -> tuple[bool, str]:
    """Whether files differ from those of a checkpoint, and their hash now."""
    each = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h"))
    now = each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "h"))), ";"), 256).alias("h")).first()["h"]
    return now != known_hash, now


# Archives and documents ----------------------------------------------------

_ENTRY = "archive string, entry string, place long, body string"


#: Entries of an archive that one task reads.
TASK_ENTRIES = 2000


def read_archives(
    spark: SparkSession, path: str, suffix: str = ".json", prefix: str = "", start: int = 0, ids: list[str] | None = None, task_entries: int = TASK_ENTRIES
) -> DataFrame:
    """Text entries of ZIP and TAR archives, one row each, by name
    prefix or by a list of names, and from a resume place on.

    A ZIP archive is read by as many tasks as it has stretches of entries: each
    finds its own by the directory at the archive's end, so neither the size of an
    archive nor that of a task grows with the other. A TAR archive has no
    directory and is one task, which reads it as a stream.
    """
    wanted = None if ids is None else frozenset(ids)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "n": [_zip_size(p) if p.endswith(".zip") else 1 for p in batch["path"]]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, low, high in zip(batch["path"], batch["low"], batch["high"]):
                rows: list[tuple] = []
                for place, entry, body in _entries(name, max(low, start), high):
                    base = entry.rsplit("/", 1)[-1]
                    if entry.endswith(suffix) and base.startswith(prefix) and (wanted is None or base.removesuffix(suffix) in wanted):
                        rows.append((name, entry, place, body().decode("utf-8", "replace")))
                    if len(rows) >= 200:
                        yield pd.DataFrame(rows, columns=["archive", "entry", "place", "body"])
                        rows = []
                yield pd.DataFrame(rows, columns=["archive", "entry", "place", "body"])

    found = spark.read.format("binaryFile").load(path).select("path").mapInPandas(count, "path string, n long")
    sizes = [(r["path"], r["n"]) for r in found.toLocalIterator()]  # one row per archive
    stretches = [(p, low, low + task_entries) if p.endswith(".zip") else (p, 0, 1 << 62) for p, n in sizes for low in range(0, max(1, n), task_entries if p.endswith(".zip") else max(1, n))]
    if not stretches:
        return spark.createDataFrame([], _ENTRY)
    tasks = spark.createDataFrame([(n, *s) for n, s in enumerate(stretches)], "task long, path string, low long, high long")
    return tasks.repartitionByRange(len(stretches), "task").select("path", "low", "high").mapInPandas(read, _ENTRY)


def _opened(path: str):
    """A file of any file system that can seek in it."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(place)


def _zip_size(path: str) -> int:
    with _opened(path) as file, zipfile.ZipFile(file) as archive:
        return sum(not info.is_dir() for info in archive.infolist())


def _entries(path: str, low: int, high: int) -> Iterator[tuple]:
    """``place, name, reader`` of the files in an archive from one place up to another."""
    with _opened(path) as file:
        if path.endswith(".zip"):
            with zipfile.ZipFile(file) as archive:
                infos = [info for info in archive.infolist() if not info.is_dir()]
                for place in range(low, min(high, len(infos))):
                    yield place, infos[place].filename, lambda i=infos[place]: archive.read(i)
        else:
            with tarfile.open(fileobj=file, mode="r:*") as archive:
                for place, info in enumerate(i for i in archive if i.isfile()):
                    if low <= place < high:
                        yield place, info.name, lambda i=info: archive.extractfile(i).read()


def changed_archives(spark: SparkSession, path: str, known: dict[str, str]) -> dict[str, str]:
    """Archives whose length or time of change differs from a checkpoint's, with
    their marks now; nothing of their content is read."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("mark"))
    return {r["path"]: r["mark"] for r in rows.toLocalIterator() if known.get(r["path"]) != r["mark"]}  # one row per archive


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a mirror below a folder, whole, with their path."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quotes, doubled quotes and line ends in values; rows without
    any value dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.where(F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns)).isNotNull())


def _yaml_to_json(text: str | None) -> str | None:
    try:
        import yaml
    except ImportError:
        return None
    try:
        return json.dumps(yaml.safe_load(text), default=str) if text else None
    except yaml.YAMLError:
        return None


def _toml_to_json(text: str | None) -> str | None:
    import tomllib

    if not text:
        return None
    fenced = text.split("```toml", 1)
    front = fenced[1].split("```", 1)[0] if len(fenced) == 2 else text
    try:
        return json.dumps(tomllib.loads(front), default=str)
    except tomllib.TOMLDecodeError:
        return None


def _converter(convert):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(convert)

    return run


def yaml_json(body: Column) -> Column:
    """YAML as JSON; null if unreadable or without a YAML reader."""
    return _converter(_yaml_to_json)(body)


def toml_json(body: Column) -> Column:
    """TOML, or the TOML front matter of a document, as JSON; null if unreadable."""
    return _converter(_toml_to_json)(body)


def xml_items(body: Column, schema: str, tag: str = "item") -> Column:
    """Repeated elements of an XML feed as structs."""
    found = F.regexp_extract_all(body, F.lit(f"(?s)(<{tag}[ >].*?</{tag}>)"), F.lit(1))
    return F.transform(found, lambda x: F.from_xml(x, schema))


# Bills of materials --------------------------------------------------------

_PROPERTY = "array<struct<name:string,value:string>>"
CYCLONEDX = (
    "bomFormat string, specVersion string, serialNumber string, metadata struct<component:struct<name:string,version:string,type:string>>, "
    f"components array<struct<type:string,name:string,version:string,group:string,purl:string,cpe:string,publisher:string,supplier:struct<name:string>,properties:{_PROPERTY}>>"
)


def _property(name: str) -> Column:
    fits = F.filter(F.col("c.properties"), lambda p: F.lower(p["name"]) == name.lower())
    return F.try_element_at(fits, F.lit(1))["value"]


def sbom_components(documents: DataFrame, id_column: str = "sbom_id", body: str = "body") -> DataFrame:
    """Components of CycloneDX documents; unreadable documents give none."""
    parsed = documents.select(id_column, F.from_json(body, CYCLONEDX).alias("b")).where("b.bomFormat = 'CycloneDX'")
    rows = parsed.select(id_column, F.posexplode("b.components").alias("place", "c"))
    rows = rows.withColumn("cpe23_uri", F.coalesce("c.cpe", _property("cpe"), _property("cpe23Uri"), _property("cpe23")))
    rows = rows.withColumn("cpe_parts", parse_cpe(F.col("cpe23_uri"))).withColumn("purl_parts", parse_purl(F.col("c.purl")))
    group = F.coalesce("c.group", present(F.col("purl_parts.namespace")))
    name = F.coalesce("c.name", "cpe_parts.product")
    return rows.select(
        id_column, (F.col("place") + 1).cast("bigint").alias("place"), F.col("c.purl").alias("purl"), name.alias("name"), F.coalesce("c.version", "cpe_parts.version").alias("version"),
        F.coalesce(purl_ecosystem(F.col("c.purl")), F.when(F.col("cpe23_uri").isNotNull(), "cpe")).alias("ecosystem"), group.alias("group_name"),
        F.coalesce("c.supplier.name", "c.publisher", group, "cpe_parts.vendor").alias("vendor"), F.coalesce(name, "purl_parts.name").alias("product"), "cpe23_uri",
        _property("aquasecurity:trivy:SrcName").alias("source_package_name"),
        join_package_version(_property("aquasecurity:trivy:SrcEpoch"), _property("aquasecurity:trivy:SrcVersion"), _property("aquasecurity:trivy:SrcRelease")).alias("source_package_version"),
        F.col("c.type").alias("component_type"),
    )


# Adapters ------------------------------------------------------------------


def stable_hash(text: str | None) -> str | None:
    """SHA-256 of JSON with sorted names; null for unreadable text."""
    try:
        return None if text is None else hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    except ValueError:
        return None


def record_hash(body: Column) -> Column:
    return _converter(stable_hash)(body)


def regroup_tracker(tracker: DataFrame, body: str = "body") -> DataFrame:
    """Package -> id -> advisory regrouped as id -> package -> advisory; only
    CVE and TEMP ids count."""
    packages = tracker.select(F.explode(F.from_json(body, "map<string,string>")).alias("package", "advisories"))
    rows = packages.select("package", F.explode(F.from_json("advisories", "map<string,string>")).alias("vulnerability_key", "advisory"))
    kept = rows.where(F.col("vulnerability_key").rlike("^(CVE-|TEMP-)"))
    return kept.groupBy("vulnerability_key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("package", "advisory"))))).alias("packages_json"))


def exploit_rows(rows: DataFrame) -> DataFrame:
    """Exploit entries of an exploit index with columns ``id, description, codes,
    aliases, file, type, tags, verified, platform, author, date_published, date_updated, date_added``; rows that
    name no CVE dropped."""
    ids = extract_cves(F.concat_ws(" ", "codes", "description", "aliases"))
    verified = F.col("verified") == "1"
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), "[;,]"), lambda t: F.trim(t)), lambda t: t != "")
    return rows.where(F.size(extract_cves(F.concat_ws(" ", "codes", "description"))) > 0).select(
        F.concat(F.lit("EDB-"), "id").alias("source_key"), ids.alias("identifiers"), F.coalesce(present(F.col("description")), F.concat(F.lit("Exploit "), "id")).alias("title"),
        artifact_type(F.lit("exploitdb"), F.col("file"), tags).alias("artifact_type"), exploit_class(F.concat_ws(" ", "type", "description", "tags")).alias("exploit_type"),
        maturity(F.lit("exploitdb"), verified).alias("maturity"), F.when(verified, "source_verified").otherwise("unreviewed").alias("verification_status"),
        language_of_path(F.col("file")).alias("language"), "platform", "author", "date_published", F.coalesce("date_updated", "date_added").alias("modified_at"),
    )


def boundary_samples(records: DataFrame, category: Column, order: list[str]) -> DataFrame:
    """The first record of each category, with how many it has."""
    one = records.groupBy(category.alias("category")).agg(F.min_by(F.struct(*records.columns), F.struct(*order)).alias("r"), F.count("*").alias("n_records"))
    return one.select("category", "n_records", "r.*")


def largest_samples(records: DataFrame, category: Column, size: Column, order: list[str]) -> DataFrame:
    """The record of each category with the most items (``size``), first by order."""
    ranked = F.struct((-size).alias("size"), *order)
    return records.groupBy(category.alias("category")).agg(F.min_by(F.struct(*records.columns), ranked).alias("r"), F.max(size).alias("most")).select("category", "most", "r.*")


def missing_ids(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Asked ids that a replay did not find."""
    return wanted.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def rust_advisory(body: Column) -> Column:
    """A crate advisory (TOML as JSON) as an OSV-like record in JSON; patched
    versions give ``fixed`` events, unaffected ones ``introduced`` events."""
    v = F.from_json(body, "advisory struct<id:string,package:string,date:string,title:string,aliases:array<string>>, versions struct<patched:string,unaffected:string>")
    event = lambda name: lambda x: F.create_map(F.lit(name), F.regexp_replace(x, r"^[\s^>=]+", ""))
    empty = F.array().cast("array<map<string,string>>")
    listed = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(x))
    part = lambda versions, name: F.coalesce(F.transform(listed(v["versions"][versions]), event(name)), empty)
    events = F.concat(F.array(F.create_map(F.lit("introduced"), F.lit("0"))), part("patched", "fixed"), part("unaffected", "introduced"))
    package = F.struct(F.lit("crates.io").alias("ecosystem"), v["advisory"]["package"].alias("name"))
    affected = F.array(F.struct(package.alias("package"), F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges")))
    return F.to_json(F.struct(v["advisory"]["id"].alias("id"), v["advisory"]["aliases"].alias("aliases"), v["advisory"]["title"].alias("summary"), v["advisory"]["date"].alias("published"), affected.alias("affected")))


def merge_detail(rows: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a list page completed by their detail pages, which come first;
    ids of both upper case and distinct."""
    joined = rows.alias("l").join(details.alias("d"), key, "left")
    merged = [F.coalesce(present(F.col(f"d.{c}")), present(F.col(f"l.{c}"))).alias(c) for c in columns]
    ids = F.array_distinct(F.transform(F.concat(F.array(F.col(key)), *(F.coalesce(F.col(f"{s}.identifiers"), F.array().cast("array<string>")) for s in "ld")), F.upper))
    return joined.select(key, *merged, ids.alias("identifiers"))


def registry_package(ecosystem: str, name: Column, version: Column, repository: Column, homepage: Column) -> Column:
    """The payload of a registry package."""
    return F.struct(F.concat(F.lit(f"pkg:{ecosystem}/"), name, F.coalesce(F.concat(F.lit("@"), version), F.lit(""))).alias("purl"), repository.alias("repository"), homepage.alias("homepage"))


def csaf_list_rows(items: DataFrame, after: str | None = None) -> DataFrame:
    """Entries of a RedHat list with columns ``RHSA, advisory, id, CVEs,
    released_on`` that came out after a date, or have none; those without id dropped."""
    key = F.coalesce("RHSA", "advisory", "id")
    new = F.lit(True) if not after else F.coalesce(F.col("released_on") == "", F.lit(True)) | (F.col("released_on") > after)
    ids = F.filter(F.concat(F.array(key), F.coalesce("CVEs", F.array().cast("array<string>"))), lambda x: x != "")
    return items.where(new & (key != "")).select(key.alias("source_key"), F.concat(F.lit("https://access.redhat.com/errata/"), key).alias("source_url"), ids.alias("identifiers"), "released_on")


def alpine_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """Packages of Alpine pages (columns ``release, repo`` and the page) with the
    distinct ids of all their fixed versions."""
    kind = "name:string,secfixes:map<string,array<string>>"
    packages = pages.select("release", "repo", F.explode(F.from_json(body, f"packages array<struct<pkg:struct<{kind}>,{kind}>>")["packages"]).alias("p"))
    lists = F.map_values(F.coalesce("p.pkg.secfixes", "p.secfixes"))
    ids = F.filter(F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull()))), lambda x: x != "")
    name = F.coalesce("p.pkg.name", "p.name")
    return packages.select(F.concat_ws("/", "release", "repo", name).alias("source_key"), name.alias("package_name"), F.coalesce(ids, F.array().cast("array<string>")).alias("identifiers"))


def explode_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Package -> list of advisories as one row per pair, with place."""
    packages = pages.select(F.explode(F.from_json(body, "map<string,array<map<string,string>>>")).alias("package_name", "advisories"))
    return packages.select("package_name", F.posexplode("advisories").alias("place", "advisory"))


def write_quoted_csv(df: DataFrame, folder: str) -> None:
    """Rows as CSV with a header, every value quoted and quotes doubled; null is
    the empty text."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.options(header=True, quoteAll=True, escape='"', emptyValue="").csv(folder)

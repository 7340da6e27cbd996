"""Search plans over the catalog: P8-P13, P15, P19, P28, A14, T2-T4, J5, J6, J18, J19, D12, T7."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.packages import ecosystem_matches
from vulnlake.functions.text import tokenize_query
from vulnlake.operators.catalog import LATEST_ROWS

# --- fixed values ---------------------------------------------------------
MAX_OFFSET, MAX_PAGE, DEFAULT_PAGE = 100_000, 200, 25
SORTS = {
    "modifiedDesc": ("modified_at", False), "modifiedAsc": ("modified_at", True), "publishedDesc": ("published_at", False),
    "publishedAsc": ("published_at", True), "cvssDesc": ("max_cvss_score", False), "cvssAsc": ("max_cvss_score", True),
    "severityDesc": ("max_cvss_score", False), "severityAsc": ("max_cvss_score", True),
    "identifierAsc": ("primary_identifier", True), "identifierDesc": ("primary_identifier", False),
}
# --------------------------------------------------------------------------


def sort_order(sort: str | None) -> list[Column]:
    """A sort mode, nulls last either way; unknown modes sort by change."""
    column, ascending = SORTS.get(sort or "", SORTS["modifiedDesc"])
    first = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return [first, F.col("id").desc()]


def page_bounds(page: int, size: int) -> tuple[int, int, bool]:
    """Offset, page size, and whether the page lies within reach."""
    size = min(max(size, 1), MAX_PAGE)
    offset = (max(page, 1) - 1) * size
    return offset, size, offset <= MAX_OFFSET


def like_pattern(query: str) -> str:
    """A substring pattern in which % and _ are wildcards and a backslash is itself."""
    return "%" + query.lower().replace("\\", "\\\\") + "%"


def key_list(keys: list[str | None]) -> list[str]:
    """Keys normalised, without blanks and repeats, in order."""
    found = (k.strip().upper() for k in keys if k is not None)
    return list(dict.fromkeys(k for k in found if k))


def equals_or_in(column: str, values: list[str | None]) -> Column:
    """A column among values: never for no value, equal to the one, in the list."""
    known = list(dict.fromkeys(v for v in values if v is not None))
    return F.lit(False) if not known else F.col(column) == known[0] if len(known) == 1 else F.col(column).isin(*known)


def rows_of_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """P8 for key lists of any length: a semi join on normalised keys."""
    wanted = keys.select(F.upper(F.trim(F.col(keys.columns[0]))).alias("__k")).where("__k <> ''").distinct()
    return df.join(wanted, F.upper(F.trim(F.col(column))) == F.col("__k"), "left_semi")


def year_range(year: int) -> Column:
    """CVE ids of a year as a half-open range, which reaches the scan."""
    return (F.col("primary_identifier") >= f"CVE-{year:04d}") & (F.col("primary_identifier") < f"CVE-{year + 1:04d}")


def token_hits(tokens: DataFrame, wanted: list[str]) -> DataFrame:
    """Vulnerabilities that have all wanted tokens."""
    hits = tokens.where(F.col("token").isin(*wanted)).groupBy("vulnerability_id").agg(F.count_distinct("token").alias("n"))
    return hits.where(F.col("n") == len(set(wanted))).select("vulnerability_id")


def plan_search(
    vulnerabilities: DataFrame, tokens: DataFrame, relations: DataFrame, query: str | None = None, sort: str | None = None,
    page: int = 1, size: int = DEFAULT_PAGE, latest: DataFrame | None = None,
) -> tuple[str, DataFrame]:
    """The plan chosen for a query, and its page of ``size`` + 1 rows (T3: the row
    more tells whether another page follows).

    Exact id, then the materialised latest rows for a blank query, then a year,
    then tokens (semi join), and a substring scan if no token matches.
    """
    offset, size, reachable = page_bounds(page, size)
    text = (query or "").strip()
    first: list[Column] = []
    if not reachable:
        return "empty", vulnerabilities.limit(0)
    if re.fullmatch(r"(?i)CVE-\d{4}-\d{4,}", text):
        name, found = "point", vulnerabilities.where(F.col("primary_identifier") == text.upper())
    elif not text and latest is not None and (sort or "modifiedDesc") == "modifiedDesc" and offset + size + 1 <= LATEST_ROWS:
        name, found = "latest", latest
    elif not text:
        name, found = "all", vulnerabilities
    elif re.fullmatch(r"(?i)CVE-\d{4}", text):
        name, found = "year", vulnerabilities.where(year_range(int(text[4:])))
    else:
        wanted = tokenize_query(text)
        related = relations.where(F.upper("related_identifier") == text.upper()).select("vulnerability_id")
        hits = token_hits(tokens, wanted) if wanted else None
        first = [F.when(F.upper("primary_identifier") == text.upper(), 0).otherwise(1)]  # T4
        if hits is not None and not hits.isEmpty():
            ids = hits.unionByName(related).distinct().withColumnRenamed("vulnerability_id", "id")
            name, found = "tokens", vulnerabilities.join(ids, "id", "left_semi")
        else:
            name, found = "like", substring_search(vulnerabilities, relations, text)
    return name, found.orderBy(*first, *sort_order(sort)).offset(offset).limit(size + 1)


def substring_search(vulnerabilities: DataFrame, relations: DataFrame, text: str) -> DataFrame:
    """Substring of id, title or identifiers, or of a related identifier."""
    pattern = like_pattern(text)
    fits = lambda c: F.coalesce(F.lower(c).like(pattern), F.lit(False))
    related = relations.where(fits("related_identifier")).select(F.col("vulnerability_id").alias("id")).distinct()
    direct = reduce(lambda a, b: a | b, (fits(c) for c in ("primary_identifier", "title", "identifiers_json")))
    found = vulnerabilities.join(related.withColumn("__related", F.lit(True)), "id", "left")
    return found.where(direct | F.coalesce("__related", F.lit(False))).drop("__related")


def resolve_identifier(wanted: DataFrame, vulnerabilities: DataFrame, owners: DataFrame, relations: DataFrame) -> DataFrame:
    """The catalog row of an identifier: its own, its owner's, or that of the
    record it relates to (upstream first). ``wanted(identifier)``."""
    ask = wanted.select(F.upper(F.trim("identifier")).alias("identifier")).distinct()
    own = ask.join(vulnerabilities.select(F.col("primary_identifier").alias("identifier"), "id"), "identifier").select("identifier", "id", F.lit(0).alias("tier"))
    alias = ask.join(owners.select("identifier", F.col("vulnerability_id").alias("id")), "identifier").select("identifier", "id", F.lit(1).alias("tier"))
    kind = F.when(F.col("relation_type") == "upstream", 2).otherwise(3)
    linked = relations.select(F.upper("related_identifier").alias("identifier"), F.col("vulnerability_id").alias("id"), kind.alias("tier"))
    related = ask.join(linked, "identifier").select("identifier", "id", "tier")
    known = own.unionByName(alias).unionByName(related).join(vulnerabilities.select("id", "primary_identifier"), "id")
    best = known.groupBy("identifier").agg(F.min(F.struct("tier", "primary_identifier", "id")).alias("b"))
    return best.select("identifier", F.col("b.tier").cast("bigint").alias("tier"), F.col("b.primary_identifier").alias("primary_identifier"), F.col("b.id").alias("id"))


def component_search(components: DataFrame, purl: str | None, name: str | None, ecosystem: str | None) -> DataFrame:
    """Components by exact purl, else by exact name and ecosystem, else by
    substring; the first tier that finds any wins."""
    exact = F.lit(False) if not purl else F.lower("purl_without_version") == purl.lower()
    named = F.lit(False) if not name else (F.col("display_name_lower") == name.lower()) & ecosystem_matches(F.col("ecosystem"), ecosystem)
    pattern = like_pattern(name or purl or "")
    loose = reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).like(pattern), F.lit(False)) for c in ("display_name", "package_name", "purl", "cpe23_uri")))
    tier = F.when(exact, 0).when(named, 1).when(loose, 2)
    tiered = components.withColumn("tier", tier).where("tier is not null")
    best = tiered.agg(F.min("tier").alias("tier"))
    return tiered.join(F.broadcast(best), "tier", "left_semi")  # one row


def cpe_search(entries: DataFrame, text: str) -> DataFrame:
    """CPE entries by part of vendor or product."""
    pattern = like_pattern(text)
    return entries.where(F.lower("vendor").like(pattern) | F.lower("product").like(pattern))


def vulnerabilities_of(candidates: DataFrame, vulnerabilities: DataFrame, size: int = DEFAULT_PAGE) -> DataFrame:
    """The best row per vulnerability of component candidates, by
    score (0 where missing) and id; candidates without a catalog row drop out."""
    one = candidates.groupBy("vulnerability_id").agg(F.count("*").alias("n_components"))
    joined = one.join(vulnerabilities.withColumnRenamed("id", "vulnerability_id"), "vulnerability_id")
    return joined.orderBy(F.coalesce(F.col("max_cvss_score"), F.lit(0.0)).desc(), F.lower("primary_identifier"), "vulnerability_id").limit(size)

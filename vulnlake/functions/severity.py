"""CVSS scores and severity labels: F30-F33, F41."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.packages import lookup

# --- fixed values ---------------------------------------------------------
V3_WEIGHTS = {
    "AV": {"N": "0.85", "A": "0.62", "L": "0.55", "P": "0.20"},
    "AC": {"L": "0.77", "H": "0.44"},
    "UI": {"N": "0.85", "R": "0.62"},
    "C": {"N": "0.00", "L": "0.22", "H": "0.56"},
    "I": {"N": "0.00", "L": "0.22", "H": "0.56"},
    "A": {"N": "0.00", "L": "0.22", "H": "0.56"},
}
V3_PRIVILEGES = {"U": {"N": "0.85", "L": "0.62", "H": "0.27"}, "C": {"N": "0.85", "L": "0.68", "H": "0.50"}}
V2_WEIGHTS = {
    "AV": {"L": "0.395", "A": "0.646", "N": "1.000"},
    "AC": {"H": "0.350", "M": "0.610", "L": "0.710"},
    "AU": {"M": "0.450", "S": "0.560", "N": "0.704"},
    "C": {"N": "0.000", "P": "0.275", "C": "0.660"},
    "I": {"N": "0.000", "P": "0.275", "C": "0.660"},
    "A": {"N": "0.000", "P": "0.275", "C": "0.660"},
}
VERSION_NAMES = {
    "2": "2.0", "2.0": "2.0", "CVSS:2.0": "2.0", "CVSS_V2": "2.0", "CVSS_V2_0": "2.0",
    "3.0": "3.0", "CVSS:3.0": "3.0", "CVSS_V3_0": "3.0",
    "3": "3.1", "3.1": "3.1", "CVSS:3.1": "3.1", "CVSS_V3": "3.1", "CVSS_V3_1": "3.1",
}
TYPE_VERSIONS = {"CVSS_V4": "4.0", "CVSS_V4_0": "4.0", "CVSS_V3": "3.1", "CVSS_V3_1": "3.1", "CVSS_V3_0": "3.0", "CVSS_V2": "2.0"}
#: Metric groups and labels of a vector.
METRICS = {
    "AV": ("base", "Attack Vector"), "AC": ("base", "Attack Complexity"), "AT": ("base", "Attack Requirements"), "PR": ("base", "Privileges Required"),
    "UI": ("base", "User Interaction"), "S": ("base", "Scope"), "AU": ("base", "Authentication"), "C": ("base", "Confidentiality"),
    "I": ("base", "Integrity"), "A": ("base", "Availability"), "E": ("temporal", "Exploit Code Maturity"), "RL": ("temporal", "Remediation Level"),
    "RC": ("temporal", "Report Confidence"), "CR": ("environmental", "Confidentiality Requirement"),
    "IR": ("environmental", "Integrity Requirement"), "AR": ("environmental", "Availability Requirement"),
}
SEVERITY_WORDS = {
    "4": "critical", "critical": "critical", "严重": "critical", "超危": "critical", "3": "high", "high": "high", "高危": "high", "高": "high",
    "2": "medium", "medium": "medium", "moderate": "medium", "中危": "medium", "中": "medium", "1": "low", "low": "low", "低危": "low", "低": "low",
    "0": "unknown", "unknown": "unknown", "未知": "unknown",
}
NUGET_SEVERITIES = {"0": "low", "1": "moderate", "2": "high", "3": "critical"}
# --------------------------------------------------------------------------


def _parts(vector: Column) -> Column:
    return F.filter(F.transform(F.split(vector, "/"), lambda p: F.trim(p)), lambda p: p != "")


def cvss_metrics(vector: Column) -> Column:
    """Metrics of a vector by upper-case name; null if malformed or repeated."""
    parts = F.filter(_parts(vector), lambda p: ~F.upper(p).startswith("CVSS:"))
    first_only = F.when(F.size(parts) >= F.size(_parts(vector)) - 1, parts)
    names = F.transform(first_only, lambda p: F.upper(F.substring_index(p, ":", 1)))
    good = F.forall(first_only, lambda p: p.rlike("^[^:]+:.+$")) & (F.size(F.array_distinct(names)) == F.size(names))
    pairs = F.transform(first_only, lambda p: F.struct(F.upper(F.substring_index(p, ":", 1)), F.upper(F.regexp_extract(p, "^[^:]+:(.+)$", 1))))
    return F.when(good, F.map_from_entries(pairs))


def cvss_version(vector: Column) -> Column:
    """F32: the version a vector names, null if it names none."""
    return F.nullif(F.regexp_extract(vector, "^(?i:CVSS):([^/]+)/", 1), F.lit(""))


def cvss_version_from_type(kind: Column) -> Column:
    """F32: the version a severity type stands for."""
    return lookup(F.upper(kind), TYPE_VERSIONS, F.lit(None).cast("string"))


def _version(vector: Column, hint: Column, metrics: Column) -> Column:
    none = F.lit(None).cast("string")
    named = F.upper(F.trim(F.regexp_extract(F.trim(vector), "^/*\\s*(?i:CVSS):([^/]*)", 1)))
    has_name = F.trim(vector).rlike("^/*\\s*(?i:CVSS):")
    version = F.when(has_name, lookup(named, VERSION_NAMES, none)).otherwise(lookup(F.upper(F.trim(hint)), VERSION_NAMES, none))
    return F.coalesce(version, F.when(F.map_contains_key(metrics, "AU"), "2.0"))


def _weight(metrics: Column, name: str, weights: dict[str, str]) -> Column:
    value = F.try_element_at(metrics, F.lit(name))
    out = F.lit(None).cast("decimal(4,3)")
    for key, weight in weights.items():
        out = F.when(value == key, F.lit(weight).cast("decimal(4,3)")).otherwise(out)
    return out


def with_cvss_score(df: DataFrame, vector: str, hint: str, name: str = "base_score") -> DataFrame:
    """base score of a CVSS 2.0, 3.0 or 3.1 vector in a column, as a double.

    Null if the vector is malformed, repeats a metric, lacks one, has an unknown
    value, or is of another version. Decimal arithmetic; only the high powers of a
    changed scope are taken in double, whose error is far below the rounding.
    Metrics and weights are columns of their own, so no expression is repeated.
    """
    kept = df.columns
    df = df.withColumn("__m", cvss_metrics(F.col(vector)))
    df = df.withColumn("__v", _version(F.col(vector), F.col(hint), F.col("__m"))).withColumn("__s", F.try_element_at("__m", F.lit("S")))
    m = F.col("__m")
    weights = {f"__3{k}": _weight(m, k, V3_WEIGHTS[k]) for k in V3_WEIGHTS} | {f"__2{k}": _weight(m, k, V2_WEIGHTS[k]) for k in V2_WEIGHTS}
    weights["__3PR"] = F.when(F.col("__s") == "C", _weight(m, "PR", V3_PRIVILEGES["C"])).when(F.col("__s") == "U", _weight(m, "PR", V3_PRIVILEGES["U"]))
    df = df.withColumns(weights)
    one, dec = F.lit(1).cast("decimal(4,3)"), lambda x: F.lit(x).cast("decimal(6,3)")
    w = lambda k: F.col(f"__{k}")
    df = df.withColumns(
        {
            "__sub": (one - (one - w("3C")) * (one - w("3I")) * (one - w("3A"))).cast("decimal(20,9)"),
            "__exploit": (dec("8.22") * w("3AV") * w("3AC") * w("3PR") * w("3UI")).cast("decimal(28,14)"),
            "__impact2": (dec("10.41") * (one - (one - w("2C")) * (one - w("2I")) * (one - w("2A")))).cast("decimal(24,12)"),
            "__exploit2": (F.lit(20) * w("2AV") * w("2AC") * w("2AU")).cast("decimal(24,12)"),
        }
    )
    base = F.col("__sub").cast("double")
    steep = F.when(F.col("__v") == "3.0", F.pow(base - 0.02, F.lit(15))).otherwise(F.pow(base * 0.9731 - 0.02, F.lit(13)))
    bent = ((base - 0.029) * 7.52 - steep * 3.25).cast("decimal(28,14)")
    df = df.withColumn("__impact", F.when(F.col("__s") == "U", (dec("6.42") * F.col("__sub")).cast("decimal(28,14)")).when(F.col("__s") == "C", bent))
    total = (F.col("__impact") + F.col("__exploit")).cast("decimal(28,14)")
    raised = F.when(F.col("__s") == "C", (dec("1.08") * total).cast("decimal(28,14)")).otherwise(total)
    score3 = F.when(F.col("__impact") <= 0, F.lit(0.0)).otherwise((F.ceil(F.least(raised, F.lit(10).cast("decimal(28,14)")) * 10) / 10).cast("double"))
    factor = F.when(F.col("__impact2") == 0, F.lit("0").cast("decimal(4,3)")).otherwise(F.lit("1.176").cast("decimal(4,3)"))
    plain2 = (dec("0.6") * F.col("__impact2") + dec("0.4") * F.col("__exploit2") - dec("1.5")).cast("decimal(24,12)")
    score2 = F.round((plain2 * factor).cast("decimal(28,14)"), 1).cast("double")
    scored = F.when(F.col("__v") == "2.0", score2).when(F.col("__v").isin("3.0", "3.1"), F.when(F.col("__exploit").isNotNull(), score3))
    return df.withColumn("__score", scored).select(*kept, F.col("__score").alias(name))


def severity_from_score(score: Column, version: Column) -> Column:
    """the label of a score; three levels for version 2, five after it."""
    old = F.when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").otherwise("LOW")
    new = F.when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").when(score > 0.0, "LOW").otherwise("NONE")
    return F.when(score.isNotNull(), F.when(F.coalesce(version, F.lit("")).startswith("2"), old).otherwise(new))


def labelled_metrics(vector: Column) -> Column:
    """array of (metric_group, label, value) in order of the vector."""
    labels = F.create_map(*(x for k, (g, n) in METRICS.items() for x in (F.lit(k), F.struct(F.lit(g).alias("g"), F.lit(n).alias("n")))))
    pairs = F.filter(_parts(vector), lambda p: p.rlike("^[^:]+:.+$") & ~F.upper(p).startswith("CVSS:"))

    def label(pair: Column) -> Column:
        name = F.upper(F.substring_index(pair, ":", 1))
        known = F.try_element_at(labels, name)
        environmental = name.startswith("M") & (F.length(name) > 1)
        group = F.coalesce(known["g"], F.when(environmental, "environmental").otherwise("base"))
        return F.struct(group.alias("metric_group"), F.coalesce(known["n"], name).alias("label"), F.upper(F.regexp_extract(pair, ":(.+)$", 1)).alias("value"))

    return F.transform(pairs, label)


def severity_word(word: Column) -> Column:
    """label of a severity word or level in several languages; other words
    in lower case, null for an empty one."""
    low = F.lower(F.trim(word))
    return F.when(word != "", lookup(low, SEVERITY_WORDS, low))


def nuget_severity(level: Column) -> Column:
    """label of a numeric level."""
    return lookup(F.trim(level.cast("string")), NUGET_SEVERITIES, F.lit(None).cast("string"))

"""Package urls, CPE names and ecosystems: F7-F18, F43, P9."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
PURL_ECOSYSTEMS = {"golang": "go", "gem": "rubygems", "composer": "packagist"}
RPM_PRODUCTS = {
    "redhat": "red hat:enterprise_linux", "rhel": "red hat:enterprise_linux", "rocky": "rocky linux", "rockylinux": "rocky linux",
    "alma": "almalinux", "almalinux": "almalinux", "opensuse": "opensuse", "suse": "suse",
}
SHORT_ECOSYSTEMS = {"apk": "alpine", "deb": "debian", "rpm": "rpm"}
DEBIAN_RELEASES = {
    "etch": "4", "lenny": "5", "squeeze": "6", "wheezy": "7", "jessie": "8", "stretch": "9",
    "buster": "10", "bullseye": "11", "bookworm": "12", "trixie": "13", "forky": "14",
}
# --------------------------------------------------------------------------


def lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    """``table`` as a chain of conditions, ``default`` where nothing matches."""
    out = default
    for key, result in table.items():
        out = F.when(value == key, result).otherwise(out)
    return out


def present(value: Column) -> Column:
    """Null where blank."""
    return F.when(F.trim(value) != "", value)


def purl_without_version(purl: Column) -> Column:
    """a package url without fragment, qualifiers and version; null if blank."""
    base = F.substring_index(F.substring_index(F.trim(purl), "#", 1), "?", 1)
    return F.when(F.trim(purl) != "", F.regexp_replace(base, "^(.{5,})@[^/@]*$", "$1"))


def purl_qualifier(purl: Column, key: str) -> Column:
    """a decoded qualifier, its name in any case; null if absent."""
    query = F.regexp_extract(purl, r"\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?i)(?:^|&){key}=([^&]*)", 1)
    has = query.rlike(rf"(?i)(?:^|&){key}=")
    return F.when(has, F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def distro_ecosystem(fallback: Column, distro: Column) -> Column:
    """debian, ubuntu or alpine with its release."""
    pattern = r"(?i)^(debian|ubuntu|alpine)[-_](\d+(?:\.\d+)?)"
    named = F.concat(F.lower(F.regexp_extract(distro, pattern, 1)), F.lit(":"), F.regexp_extract(distro, pattern, 2))
    return F.when(distro.rlike(pattern), named).otherwise(fallback)


def rpm_ecosystem(namespace: Column, distro: Column) -> Column:
    """the rpm distribution with its major release, where it has one."""
    product = lookup(F.lower(namespace), RPM_PRODUCTS, F.lit("rpm"))
    release = F.regexp_extract(distro, r"(?:^|[-_])(\d+)(?:[._-]|$)", 1)
    versioned = ~product.isin("rpm", "opensuse", "suse") & (release != "")
    return F.when(versioned, F.concat(product, F.lit(":"), release)).otherwise(product)


def purl_ecosystem(purl: Column) -> Column:
    """F8: the ecosystem a package url belongs to; null if it is none."""
    kind = F.lower(F.regexp_extract(purl, "^(?i:pkg):([^/]*)/", 1))
    path = F.regexp_extract(purl, "^(?i:pkg):[^/]*/([^/@?#]*)", 1)
    distro = F.lower(purl_qualifier(purl, "distro"))
    deb = F.when(F.lower(path) == "ubuntu", "ubuntu").otherwise("debian")
    eco = (
        F.when(kind == "deb", distro_ecosystem(deb, distro))
        .when(kind == "apk", distro_ecosystem(F.lit("alpine"), distro))
        .when(kind == "rpm", rpm_ecosystem(path, distro))
        .otherwise(lookup(kind, PURL_ECOSYSTEMS, kind))
    )
    return F.when(purl.rlike("^(?i:pkg):[^/]*/"), eco)


def parse_purl(purl: Column) -> Column:
    """F16: struct of type, namespace (empty if none) and name; null if no purl."""
    base = F.substring_index(purl_without_version(purl), "?", 1)
    inner = F.regexp_extract(base, "^(?i:pkg):[^/]+/(.*)$", 1)
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(
        base.rlike("^(?i:pkg):[^/]+/"),
        F.struct(
            F.regexp_extract(base, "^(?i:pkg):([^/]+)/", 1).alias("type"),
            decode(F.when(F.instr(inner, "/") > 0, F.regexp_replace(inner, "/[^/]*$", "")).otherwise("")).alias("namespace"),
            decode(F.regexp_extract(inner, "([^/]*)$", 1)).alias("name"),
        ),
    )


def escape_data(value: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    encoded = F.url_encode(value)
    for raw, code in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        encoded = F.regexp_replace(encoded, raw, code)
    return encoded


def to_purl(ecosystem: Column, name: Column) -> Column:
    """the package url of a named package, null for other ecosystems."""
    eco = F.lower(ecosystem)
    part = lambda n: escape_data(F.try_element_at(F.split(name, ":"), F.lit(n)))
    url = (
        F.when(eco == "npm", F.concat(F.lit("pkg:npm/"), escape_data(name)))
        .when(eco.isin("pip", "pypi"), F.concat(F.lit("pkg:pypi/"), escape_data(F.lower(name))))
        .when((eco == "maven") & name.contains(":"), F.concat(F.lit("pkg:maven/"), part(1), F.lit("/"), part(2)))
        .when(eco == "nuget", F.concat(F.lit("pkg:nuget/"), escape_data(name)))
        .when(eco == "go", F.concat(F.lit("pkg:golang/"), name))
        .when(eco == "alpine", F.concat(F.lit("pkg:apk/alpine/"), escape_data(name)))
    )
    return F.when((F.trim(ecosystem) != "") & (F.trim(name) != ""), url)


def infer_purl(ecosystem: Column, vendor: Column, name: Column) -> Column:
    """the package url a component search tries for ecosystem, vendor and name."""
    eco, has_vendor = F.lower(ecosystem), F.coalesce(F.trim(vendor) != "", F.lit(False))
    v, n = escape_data(vendor), escape_data(name)
    return (
        F.when((eco == "maven") & has_vendor, F.concat(F.lit("pkg:maven/"), v, F.lit("/"), n))
        .when((eco == "npm") & name.startswith("@"), F.concat(F.lit("pkg:npm/"), F.regexp_replace(n, "%2F", "/")))
        .when((eco == "npm") & has_vendor, F.concat(F.lit("pkg:npm/@"), v, F.lit("/"), n))
        .when(eco == "npm", F.concat(F.lit("pkg:npm/"), n))
        .when(eco == "pypi", F.concat(F.lit("pkg:pypi/"), escape_data(F.lower(name))))
        .when(eco == "nuget", F.concat(F.lit("pkg:nuget/"), n))
        .when(eco == "go", F.concat(F.lit("pkg:golang/"), name))
        .when(eco == "cargo", F.concat(F.lit("pkg:cargo/"), n))
        .when(eco == "rubygems", F.concat(F.lit("pkg:gem/"), n))
        .when((eco == "packagist") & has_vendor, F.concat(F.lit("pkg:composer/"), v, F.lit("/"), n))
    )


def component_query(name: Column, vendor: Column, purl: Column, ecosystem: Column) -> Column:
    """struct of lower-case name and purl candidates and the ecosystem to look up."""
    given = F.coalesce(F.when(F.lower(name).startswith("pkg:"), F.trim(name)), present(F.trim(purl)))
    parts = parse_purl(given)
    maven_name = F.when(F.lower(parts["type"]) == "maven", parts["name"])
    npm_scoped = (F.lower(parts["type"]) == "npm") & parts["namespace"].startswith("@")
    purl_name = F.coalesce(maven_name, F.when(npm_scoped, F.concat(parts["namespace"], F.lit("/"), parts["name"])), parts["name"])
    eco = F.lower(F.coalesce(purl_ecosystem(given), present(F.trim(ecosystem))))
    eco = lookup(eco, SHORT_ECOSYSTEMS, eco)
    who = F.coalesce(present(F.trim(vendor)), present(F.regexp_replace(parts["namespace"], "^@", "")))
    what = F.coalesce(F.when(~F.lower(name).startswith("pkg:"), present(F.trim(name))), purl_name)
    scoped = F.when((eco == "npm") & ~what.startswith("@"), F.concat(F.lit("@"), who, F.lit("/"), what))
    names = F.array(what, F.concat(who, F.lit(":"), what), F.concat(who, F.lit("/"), what), scoped)
    purls = F.array(purl_without_version(given), F.when(parts.isNull(), infer_purl(eco, who, what)))
    keep = lambda a: F.array_distinct(F.transform(F.filter(a, lambda v: F.trim(v) != ""), F.lower))
    return F.struct(keep(names).alias("names"), keep(purls).alias("purls"), eco.alias("ecosystem"))


def map_ecosystem(value: Column) -> Column:
    """short names of distributions spelled out, lower case."""
    return lookup(F.lower(value), SHORT_ECOSYSTEMS, F.lower(value))


def debian_ecosystem(release: Column) -> Column:
    """``debian:N`` of a release name; other names stay."""
    return F.concat(F.lit("debian:"), lookup(F.lower(release), DEBIAN_RELEASES, F.lower(release)))


def parse_cpe(cpe: Column) -> Column:
    """struct of part, vendor, product and version. Escaped colons split too."""
    parts = F.split(cpe, ":")
    shift = F.when(F.try_element_at(parts, F.lit(2)) == "2.3", 3).otherwise(2)
    plain = lambda n: F.replace(F.replace(F.try_element_at(parts, shift + n), F.lit("\\:"), F.lit(":")), F.lit("\\\\"), F.lit("\\"))
    good = (F.size(parts) >= 6) & (F.lower(F.try_element_at(parts, F.lit(1))) == "cpe") & (F.size(parts) >= shift + 3)
    return F.when(good, F.struct(plain(0).alias("part"), plain(1).alias("vendor"), plain(2).alias("product"), plain(3).alias("version")))


def cpe_product(cpe: Column) -> Column:
    """the product of a CPE 2.3 name, null if too short."""
    parts = F.split(cpe, ":")
    return F.when(F.size(parts) > 4, F.replace(F.try_element_at(parts, F.lit(5)), F.lit("\\:"), F.lit(":")))


def cpe_prefix(cpe: Column) -> Column:
    """the CPE 2.3 name up to its product."""
    parsed = parse_cpe(cpe)
    escape = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return F.concat(F.lit("cpe:2.3:"), parsed["part"], F.lit(":"), escape(parsed["vendor"]), F.lit(":"), escape(parsed["product"]), F.lit(":"))


def join_package_version(epoch: Column, version: Column, release: Column) -> Column:
    """``epoch:version-release`` without empty parts; null without version."""
    front = F.when((F.trim(epoch) != "") & (epoch != "0"), F.concat(epoch, F.lit(":"), version)).otherwise(version)
    return F.when(F.trim(version) != "", F.when(F.trim(release) != "", F.concat(front, F.lit("-"), release)).otherwise(front))


def sbom_name(*names: Column, serial: Column) -> Column:
    """first non-blank name, else the serial number without ``urn:uuid:``."""
    return F.coalesce(*(present(F.trim(n)) for n in names), F.regexp_replace(serial, "^(?i:urn:uuid:)", ""))


def ecosystem_matches(column: Column, wanted: str | None) -> Column:
    """No wanted ecosystem matches all; cargo and crates.io are one; a base
    name also matches its releases."""
    if wanted is None or not wanted.strip():
        return F.lit(True)
    want, have = wanted.strip().lower(), F.lower(column)
    if want in ("cargo", "crates.io"):
        return have.isin("cargo", "crates.io")
    return (have == want) | (have.startswith(f"{want}:") if ":" not in want else F.lit(False))


def purl_label(purl: Column) -> Column:
    """The first eighty characters of a package url, empty without one."""
    return F.substring(F.coalesce(purl, F.lit("")), 1, 80)

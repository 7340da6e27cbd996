import pytest
from pyspark.sql import functions as F

from vulnlake.functions import identity as I
from vulnlake.functions import packages as P
from vulnlake.functions import severity as V
from vulnlake.functions import text as X
from vulnlake.functions.versions import is_commit_like, version_matches, with_version_match
from vulnlake.operators.normalize import canonical_key

RANGES = [
    # Debian: revision, epoch, tilde, letters before other marks, leading zeros, no revision
    ("0.9-4", "< 0.9-10", "debian:11", True), ("0.9-10", "< 0.9-10", "debian:11", False), ("2:0.1", "> 7.8-3", "ubuntu:22.04", True), ("5.0~beta2", "< 5.0", "deb", True), ("5.0~beta2", "> 5.0~beta1", "deb", True),
    ("1.0a", "< 1.0+", "debian", True), ("1.0a", "> 1.0", "debian", True), ("1.007", "= 1.7", "debian", True), ("8.4", "= 8.4-0", "debian", True), ("1.0~~", "< 1.0~", "debian", True), ("1.0-1~", "< 1.0-1", "debian", True),
    # RPM: epoch, tilde on either side, words and numbers
    ("3:1.1-2", "> 9.9-9", "redhat:8", True), ("4.2~alpha-1", "< 4.2-1", "rocky:9", True), ("4.2", "> 4.2~alpha", "rpm", False), ("4.2~alpha", "< 4.2", "rpm", True), ("4.2rc", "> 4.2", "almalinux", True), ("1.el8", "< 1.5", "rpm", True),
    # Alpine: revision, pre-release
    ("0.7.1-r9", "< 0.7.1-r10", "alpine:3.18", True), ("0.7.1-r10", "<= 0.7.1-r9", "apk", False), ("0.7.1", "< 0.7.1-r1", "alpine", True), ("0.7.1_beta3-r4", "< 0.7.1-r0", "alpine:edge", True),
    # other: numbers by value, pre-release words lower, build data ignored, a surplus part higher
    ("v12.0.3", "> 9.8.7", "pypi", True), ("6.1.0-preview", "< 6.1.0", "nuget", True), ("6.1.0-dev", "> 6.1.0", "nuget", True), ("6.1.0+sha.77", "== 6.1.0", "cargo", True), ("7.7", "< 7.7.0", "npm", True), ("0.5.2", ">= 0, < 0.6", "go", True),
    ("0.6", ">= 0, < 0.6", "go", False), ("4.4.4", ">= 1, <= 4.4.4, > 4", None, True), ("RC1", "= rc1", "npm", True),
    # commits are equal or unknown; no range; order of constraints
    ("0badf00d", "< 3.1", "npm", None), ("git+ssh://h.test/r@0badf00d", ">= 1", "npm", None), ("0badf00d", "= 0BADF00D", "npm", True), ("0badf00d", "= feedf00d", "npm", None), ("19991231", "> 5", "npm", None),
    ("2.2", "every release", "npm", None), ("", "> 0", "npm", None), (None, "> 0", None, None), ("2", None, None, None), ("9", "< 8, = 0badf00d", "npm", False),
]


@pytest.mark.parametrize("version,bounds,ecosystem,expected", RANGES)
def test_version_matches(version, bounds, ecosystem, expected):
    assert version_matches(version, bounds, ecosystem) is expected


def test_version_match_of_a_table(spark):
    df = spark.createDataFrame([(n, *r, "x") for n, r in enumerate(RANGES * 3)], "n int, v string, r string, e string, expected boolean, __v string")
    got = with_version_match(df, "v", "r", "e", "hit")
    assert got.count() == 3 * len(RANGES) and got.where(~F.col("hit").eqNullSafe(F.col("expected"))).count() == 0


def test_commit_like():
    assert is_commit_like("x@deadbeef1") and is_commit_like("git+deadbeef") and not is_commit_like("git+ssh://h/p") and not is_commit_like("1.2") and not is_commit_like(None)


IDENTITIES = [
    ("OSV-2031-77", ["OSV-2031-77", "CVE-2031-55501"], "CVE-2031-55501"), ("GHSA-2345-6789-CFGH", ["CVE-2031-55501", "GHSA-2345-6789-CFGH"], "CVE-2031-55501"),
    ("OSV-2031-77", ["ALPINE-CVE-2031-55501"], "CVE-2031-55501"), ("GHSA-2345-6789-CFGH", [], "GHSA-2345-6789-CFGH"), ("VENDOR-31", ["VENDOR-31"], "VENDOR-31"),
    ("OSV-2031-77", ["CVE-2031-55501", "CVE-2031-66602"], "OSV-2031-77"), ("GHSA-2345-6789-CFGH", ["CVE-2031-66602", "CVE-2031-55501"], "GHSA-2345-6789-CFGH"),
    ("OSV-7-7", ["GHSA-2345-6789-CFGH"], "GHSA-2345-6789-CFGH"), ("SUSE-CVE-2031-7070", ["CVE-2031-1"], "CVE-2031-7070"), ("Y-9", ["no id", " ", "VENDOR-31", "VENDOR-32"], "Y-9"),
]


def test_canonical_identity(spark):
    df = spark.createDataFrame([(o, i, e) for o, i, e in IDENTITIES], "own string, ids array<string>, expected string")
    rows = df.withColumn("got", I.resolve_canonical(F.col("own"), F.col("ids"))).collect()
    assert [r["got"] for r in rows] == [r["expected"] for r in rows]
    assert [canonical_key(o, i) for o, i, _ in IDENTITIES] == [e for _, _, e in IDENTITIES]


def test_embedded_cve(spark):
    yes = ["SUSE-CVE-2031-7070", "ALPINE-CVE-2031-7070", "A.B_C-CVE-2031-7070", "ONE-TWO-THREE-CVE-2031-7070", "alpine-cve-2031-7070"]
    no = ["CVE-2031-7070", "SUSE-CVE-2031-7070-1", "CVE-2031-7070-SUSE", "GHSA-2345-6789-CFGH", "VENDOR-31", "SUSE-CVE-2031-70", "SUSE-CVE-31-70701", " ", "", None]
    df = spark.createDataFrame([(x,) for x in yes + no], "id string").select(I.embedded_cve(F.col("id")).alias("cve"))
    assert [r["cve"] for r in df.collect()] == ["CVE-2031-7070"] * len(yes) + [None] * len(no)


def test_guid(spark):
    assert spark.range(1).select(I.vulnerability_guid(F.lit("CVE-2021-44228"))).first()[0] == "1f190b61-51cc-565a-b9ee-1e6a26b067f9"


PURLS = [
    ("pkg:deb/debian/openssl@3.0.11?distro=debian-12", "debian:12"), ("pkg:deb/ubuntu/x?distro=ubuntu-22.04", "ubuntu:22.04"), ("pkg:apk/alpine/x?distro=alpine-3.19", "alpine:3.19"),
    ("pkg:rpm/redhat/x?distro=rhel-8.8", "red hat:enterprise_linux:8"), ("pkg:rpm/rocky/x?distro=rocky-9.3", "rocky linux:9"), ("pkg:rpm/almalinux/x?distro=almalinux-9.2", "almalinux:9"),
    ("pkg:golang/a/b@1", "go"), ("pkg:gem/x", "rubygems"), ("pkg:deb/debian/x", "debian"), ("nope", None), (None, None), ("", None),
]


def test_purl_ecosystem(spark):
    df = spark.createDataFrame(PURLS, "purl string, eco string").withColumn("got", P.purl_ecosystem(F.col("purl")))
    assert [r["got"] for r in df.collect()] == [e for _, e in PURLS]


def test_packages(spark):
    row = spark.range(1).select(
        P.purl_without_version(F.lit("pkg:npm/%40a/b@1.2?x=1#y")), P.purl_without_version(F.lit("pkg:npm/@scope/b")), P.purl_without_version(F.lit(" ")), P.purl_qualifier(F.lit("pkg:a/b?Arch=a%2Bb+c&x=1"), "arch"),
        P.to_purl(F.lit("maven"), F.lit("g:a b")), P.to_purl(F.lit("PyPI"), F.lit("Name")), P.to_purl(F.lit("other"), F.lit("x")), P.infer_purl(F.lit("npm"), F.lit("v"), F.lit("n")),
        P.join_package_version(F.lit("1"), F.lit("2"), F.lit("3")), P.join_package_version(F.lit("0"), F.lit("2"), F.lit(None).cast("string")), P.cpe_prefix(F.lit("cpe:2.3:a:v:p:1:*")), P.map_ecosystem(F.lit("APK")),
        P.parse_cpe(F.lit("cpe:/a:v:p:1:x"))["version"], P.parse_cpe(F.lit("cpe:2.3:a"))["part"], P.sbom_name(F.lit(" "), serial=F.lit("urn:uuid:abc")),
    ).first()
    assert list(row) == ["pkg:npm/%40a/b", "pkg:npm/@scope/b", None, "a+b+c", "pkg:maven/g/a%20b", "pkg:pypi/name", None, "pkg:npm/@v/n", "1:2-3", "2", "cpe:2.3:a:v:p:", "alpine", "1", None, "abc"]


def test_component_query(spark):
    q = P.component_query(F.lit("core"), F.lit("angular"), F.lit(None).cast("string"), F.lit("npm"))
    row = spark.range(1).select(q.alias("q")).first()["q"]
    assert row["names"] == ["core", "angular:core", "angular/core", "@angular/core"] and row["purls"] == ["pkg:npm/@angular/core"] and row["ecosystem"] == "npm"


VECTORS = [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None, 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", None, 10.0), ("CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", None, 7.8),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", None, 6.1), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", None, 0.0), ("AV:N/AC:L/Au:N/C:P/I:P/A:P", None, 7.5), ("AV:N/AC:L/Au:N/C:C/I:C/A:C", "CVSS_V2", 10.0),
    ("AV:N/AC:M/Au:N/C:N/I:P/A:N", "2.0", 4.3), ("AV:N/AC:L/Au:N/C:N/I:N/A:N", "2", 0.0), ("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N", "CVSS_V3", 9.1), ("CVSS:4.0/AV:N/AC:L/AT:N", None, None),
    ("CVSS:3.1/AV:N/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None, None), ("CVSS:3.1/AV:N/AC:L", None, None), ("CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None, None), ("nonsense", "3.1", None), ("", None, None), (None, "3.1", None),
]


def test_cvss(spark):
    df = spark.createDataFrame([(n, *v) for n, v in enumerate(VECTORS)], "n int, v string, h string, expected double")
    got = {r["n"]: r["s"] for r in V.with_cvss_score(df, "v", "h", "s").collect()}
    assert [got[n] for n in range(len(VECTORS))] == [e for _, _, e in VECTORS]


def test_text(spark):
    row = spark.range(1).select(
        X.extract_identifiers(F.lit("cve-2024-1234 GHSA-aaaa-bbbb-cccc CVE-2024-1234 RUSTSEC-2024-0001")), X.exploit_class(F.lit("Remote Code Execution via SQL injection")), X.language_of_path(F.lit("a/b.py")),
        X.platform_of_path(F.lit("modules/exploits/linux/x.rb")), X.html_text(F.lit("<p>a&nbsp;<b>b</b></p><script>x</script>c &amp;lt;")), X.absolute_url(F.lit("https://h/a/b"), F.lit("c")), X.split_products(F.lit("a，b; a\nc|")),
        X.severity_class(F.lit(None).cast("string"), F.lit(7.5)), X.url_domain(F.lit("https://u@Host.Org:1/x")), V.severity_word(F.lit("严重")), V.severity_word(F.lit("")),
    ).first()
    assert list(row) == [["CVE-2024-1234", "GHSA-AAAA-BBBB-CCCC", "RUSTSEC-2024-0001"], "rce", "python", "linux", "a b\nc &lt;".replace("&lt;", "<"), "https://h/a/c", ["a", "b", "c"], "high", "host.org", "critical", None]
    assert X.tokenize_query("OpenSSL, x é 3.0 openssl") == ["openssl"]
    assert spark.range(1).select(X.rfc3339_key(F.lit("2024-01-01T00:00:00.1Z")) < X.rfc3339_key(F.lit("2024-01-01T00:00:00.12Z"))).first()[0]


def test_html(spark):
    page = "<html><style>p{}</style><p>a&nbsp;<b>b</b> \t c</p>\r\n\n\n<div>x &lt;y&gt; &#65;&#x4e2d;&#128512;</div><script>if (a<b) {}</script>z&#0;&#xd800;&AMP;quot;<br/>q <"
    got = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(X.html_text(F.col("h"))).collect()
    assert [r[0] for r in got] == ["a b c\n\nx <y> A中😀\nz&#0;&#xd800;\"\nq <", None, ""]


def test_dates_of_lists(spark):
    row = spark.range(1).select(
        X.checkpoint_reached(F.lit("2030-01-01"), F.lit("2030-01-02T00:00:00Z")), X.checkpoint_reached(F.lit("2030-01-03"), F.lit("2030-01-02")), X.checkpoint_reached(F.lit("x"), F.lit("2030-01-02")),
        X.checkpoint_reached(F.lit("2030-01-01"), F.lit("2030-01-02"), F.lit(True)), X.latest_date(F.array(F.lit("x"), F.lit("2030-01-02"), F.lit(None), F.lit("2030-01-02T09:00:00Z"))), X.latest_date(F.array(F.lit("x"))),
    ).first()
    assert list(row) == [True, False, False, False, "2030-01-02T09:00:00Z", None]

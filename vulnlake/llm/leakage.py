"""Evaluation texts leaking into training text, by greedy string tiling.

1. Seeds. Windows of ``min_words`` words (the whole item where it is shorter)
   of the evaluation items are hashed. A document that shares no seed with any
   item holds no passage and is done after one scan: its words are numbered by
   the items' vocabulary, so windows with a foreign word never match, and the
   rest is compared by a rolling hash over the whole document at once.
2. Tiles. For each pair that shares a seed, the longest common runs of words are
   marked one after the other, never overlapping (running Karp-Rabin with a
   shrinking search length). Tiles may come in any order, so reordered passages
   count in the coverage.

Items up to ``MAX_ITEM_CHARS`` characters in all travel to every task, after
their size has been measured; beyond that only a Bloom filter of their seeds does,
of at most ``FILTER_BITS`` bits. A document's windows that pass it, few besides
those really shared, are joined with the items' seeds by a shuffle (see
``by_join``). Both give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.session import reliable_checkpoint

#: Consecutive words that make a leaked passage.
MIN_WORDS = 13
#: Characters of all items together up to which they are sent to every task.
MAX_ITEM_CHARS = 8_000_000
#: Most bits of the Bloom filter of the items' seeds, bits a seed, and places a seed sets.
FILTER_BITS, SEED_BITS, PLACES = 1 << 29, 16, 4
#: Parts over which the rows of one seed, and of one item, are spread in joins.
SALTS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all windows of ``size`` ids (modulo 2**64)."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        for k in range(size):
            hashes *= _BASE
            hashes += mixed[k : k + count]
    return hashes


@dataclass
class Items:
    """Evaluation items, numbered words, and the seeds of all of them."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]  # by window size: sorted hashes, item of each
    min_words: int

    @staticmethod
    def build(rows: list[tuple[int, str | None]], min_words: int) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for item, text in rows:
            found = words_of(text)
            if found:
                ids.append(item)
                words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], dtype=np.uint64))
        by_size: dict[int, list] = {}
        for n, numbered in enumerate(words):
            size = min(min_words, len(numbered))
            by_size.setdefault(size, []).extend((int(h), n) for h in window_hashes(numbered, size))
        seeds = {}
        for size, pairs in by_size.items():
            pairs = sorted(set(pairs))
            seeds[size] = (np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.int64))
        return Items(ids, words, vocabulary, seeds, min_words)

    def numbered(self, text: str | None) -> np.ndarray:
        """The words of a document by number; 0 stands for all foreign words."""
        number = self.vocabulary.get
        return np.array([number(w, 0) for w in words_of(text)], dtype=np.uint64)

    def candidates(self, document: np.ndarray) -> list[int]:
        """Items that share a seed with the document."""
        found: set[int] = set()
        foreign = np.concatenate(([0], np.cumsum(document == 0)))
        for size, (hashes, owners) in self.seeds.items():
            starts = np.flatnonzero(foreign[size:] == foreign[:-size]) if len(document) >= size else ()
            if not len(starts):
                continue
            mine = np.unique(window_hashes(document, size)[starts])
            low, high = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            for a, b in zip(low[low < high], high[low < high]):
                found.update(owners[a:b].tolist())
        return sorted(found)


def tiles(item: np.ndarray, document: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item place, document place, length)``, longest first.

    Tiles have at least ``min_words`` words, or those of the item if fewer.
    """
    least = min(min_words, len(item))
    if not least or len(document) < least:
        return []
    item_free, document_free = np.ones(len(item), bool), np.ones(len(document), bool)
    item_words, document_words = item.tolist(), document.tolist()
    search, out = max(least, 4 * least), []
    while True:
        matches, longest = _scan(item_words, document_words, item_free, document_free, search, least)
        if longest > 2 * search:
            search = longest  # a much longer run: look for its like first
            continue
        matches.sort(key=lambda m: (-m[2], m[0], m[1]))
        occluded = False
        for a, b, length in matches:
            if item_free[a : a + length].all() and document_free[b : b + length].all():
                item_free[a : a + length] = False
                document_free[b : b + length] = False
                out.append((a, b, length))
            else:
                occluded = True
        if occluded and matches:
            continue  # what is left of occluded matches may still reach the search length
        if search > 2 * least:
            search //= 2
        elif search > least:
            search = least
        else:
            return sorted(out, key=lambda m: (-m[2], m[0], m[1]))


def _scan(
    item: list[int], document: list[int], item_free: np.ndarray, document_free: np.ndarray, size: int, least: int
) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches of unmarked words of at least ``size`` words, and the longest length."""
    places: dict[int, list[int]] = {}
    for start in _free_windows(item_free, size):
        places.setdefault(hash(tuple(item[start : start + size])), []).append(start)
    if not places:
        return [], 0
    hashes = window_hashes(np.array(document, dtype=np.uint64), size)
    keys = window_hashes(np.array(item, dtype=np.uint64), size)
    wanted = np.array(sorted({int(keys[s]) for group in places.values() for s in group}), dtype=np.uint64)
    starts = np.array(_free_windows(document_free, size), dtype=np.int64)
    if not len(starts):
        return [], 0
    at = np.searchsorted(wanted, hashes[starts])
    at[at == len(wanted)] = 0
    starts = starts[wanted[at] == hashes[starts]]
    found, longest, reach = [], 0, {}
    for b in starts.tolist():
        for a in places.get(hash(tuple(document[b : b + size])), ()):
            if item[a : a + size] != document[b : b + size] or reach.get(a - b, -1) > a:
                continue
            length = size
            while a + length < len(item) and b + length < len(document) and item[a + length] == document[b + length] and item_free[a + length] and document_free[b + length]:
                length += 1
            reach[a - b] = a + length - size + 1
            found.append((a, b, length))
            longest = max(longest, length)
    return found, longest


def _free_windows(free: np.ndarray, size: int) -> list[int]:
    if len(free) < size:
        return []
    marked = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(marked[size:] == marked[:-size]).tolist()


_LEAK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("n_tiles", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("covered", T.LongType()),
        T.StructField("item_words", T.LongType()),
    ]
)


def coverable(item: np.ndarray, document: np.ndarray, size: int) -> int:
    """Words of an item that lie in some window of ``size`` words the document has too:
    no tiling with tiles of at least that size can cover more."""
    starts = np.flatnonzero(np.isin(window_hashes(item, size), window_hashes(document, size)))
    marks = np.zeros(len(item) + 1, dtype=np.int64)
    marks[starts] += 1
    marks[starts + size] -= 1
    return int(np.count_nonzero(np.cumsum(marks)[:-1] > 0))


def _row(doc: int, item: int, words: np.ndarray, document: np.ndarray, min_words: int, cover: float) -> tuple | None:
    if cover and coverable(words, document, min(min_words, len(words))) / len(words) < cover:
        return None
    found = tiles(words, document, min_words)
    if not found:
        return None
    return doc, item, len(found), found[0][2], sum(m[2] for m in found), len(words)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.name for f in _LEAK.fields]).astype("int64")


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_item_chars: int = MAX_ITEM_CHARS, cover: float = 0.0) -> DataFrame:
    """Documents with passages of evaluation items, one row per pair.

    ``documents(doc_id, text)``, ``items(item_id, item_text)``. Gives ``doc_id,
    item_id, n_tiles, longest, covered, item_words`` for every pair with a common
    run of ``min_words`` words (all words of a shorter item). Null, empty and
    wordless texts take no part; repeated rows give repeated rows; other columns
    are not carried. Whole texts are scanned. With ``cover`` pairs that cannot reach
    that share of the item are left out before they are tiled; a pair that is given
    may still cover less.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    size = items.agg(F.sum(F.length("item_text")).alias("n")).first()["n"] or 0
    if size > max_item_chars:
        return by_join(documents, items, min_words, cover)
    rows = [(int(r["item_id"]), r["item_text"]) for r in items.where("item_id is not null").select("item_id", "item_text").toLocalIterator()]
    shared = documents.sparkSession.sparkContext.broadcast(Items.build(sorted(rows, key=lambda r: (r[0], r[1] or "")), min_words))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Items = shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                document = known.numbered(text)
                for n in known.candidates(document):
                    row = _row(int(doc), known.ids[n], known.words[n], document, min_words, cover)
                    if row:
                        out.append(row)
            yield _frame(out)

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(scan, _LEAK)


def _stable_numbers(words: list[str]) -> np.ndarray:
    """Words as numbers that are the same in every task."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _places(seeds: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a filter of ``bits`` (a power of 2) that seeds set, one row per place."""
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)[:PLACES, None]
    with np.errstate(over="ignore"):
        return ((seeds.astype(np.uint64)[None, :] ^ (seeds.astype(np.uint64)[None, :] >> np.uint64(31))) * factors) >> np.uint64(65 - bits.bit_length())


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds, as 64-bit words; at most ``FILTER_BITS`` bits reach
    the driver. A fuller filter lets more windows through and loses none."""
    wanted = max(1 << 10, SEED_BITS * seeds.count())
    bits = min(FILTER_BITS, 1 << (wanted - 1).bit_length())

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(_places(batch["seed"].to_numpy().view(np.uint64), bits))
            first, start = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.left_shift(np.uint64(1), at & np.uint64(63))
            yield pd.DataFrame({"word": first.astype(np.int64), "mask": (np.bitwise_or.reduceat(mask, start) if len(at) else mask).view(np.int64)})

    found = seeds.select("seed").mapInPandas(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def by_join(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, cover: float = 0.0) -> DataFrame:
    """``leaks`` for items of any number: windows of documents that pass the filter meet
    the items' seeds in a shuffle join, then the texts of each pair meet and are
    tiled. A seed of many documents, and an item of many, are spread over ``SALTS``
    parts each, besides what adaptive execution splits."""
    short = items.where("item_id is not null and item_text is not null").select("item_id", "item_text")

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["item_text"]):
                numbers = _stable_numbers(words_of(text))
                size = min(min_words, len(numbers))
                if size:
                    out.extend((int(item), size, int(h)) for h in np.unique(window_hashes(numbers, size)).view(np.int64))
            yield pd.DataFrame(out, columns=["item_id", "size", "seed"]).astype({"item_id": "int64", "size": "int32", "seed": "int64"})

    seeds = reliable_checkpoint(short.mapInPandas(item_seeds, "item_id long, size int, seed long").distinct())
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().toLocalIterator())  # at most min_words
    shared = documents.sparkSession.sparkContext.broadcast(seed_filter(seeds))

    def document_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        bits = len(words) << 6
        for batch in batches:
            docs, widths, found = [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                numbers = _stable_numbers(words_of(text))
                for size in sizes:
                    mine = np.unique(window_hashes(numbers, size))
                    for place in range(PLACES):
                        if not len(mine):
                            break
                        at = _places(mine, bits)[place]
                        mine = mine[((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)]
                    docs.append(np.full(len(mine), doc, dtype=np.int64))
                    widths.append(np.full(len(mine), size, dtype=np.int32))
                    found.append(mine.view(np.int64))
            if docs:
                yield pd.DataFrame({"doc_id": np.concatenate(docs), "size": np.concatenate(widths), "seed": np.concatenate(found)})

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    mine = texts.mapInPandas(document_seeds, "doc_id long, size int, seed long").select("*", salt)
    pairs = mine.join(seeds.select("*", salts), ["size", "seed", "salt"]).select("doc_id", "item_id").distinct()
    both = pairs.join(texts, "doc_id").select("*", salt).join(short.select("*", salts), ["item_id", "salt"])

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, item, text, item_text in zip(batch["doc_id"], batch["item_id"], batch["text"], batch["item_text"]):
                row = _row(int(doc), int(item), _stable_numbers(words_of(item_text)), _stable_numbers(words_of(text)), min_words, cover)
                if row:
                    out.append(row)
            yield _frame(out)

    return both.select("doc_id", "item_id", "text", "item_text").mapInPandas(tile, _LEAK)


def leaked_pairs(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct ``doc_id, item_id`` where the document holds ``min_words``
    consecutive words of the item, or the whole item if it has fewer."""
    found = leaks(documents, items, min_words)
    return found.where(F.col("longest") >= F.least(F.lit(min_words), F.col("item_words"))).select("doc_id", "item_id").distinct()


def item_report(documents: DataFrame, items: DataFrame, min_tile: int = 5, coverage: float = 0.5) -> DataFrame:
    """Per item: documents that cover it to ``coverage`` with tiles of ``min_tile``
    words in any order, and the best coverage; items without any have 0."""
    covered = leaks(documents, items, min_tile, cover=coverage).withColumn("share", F.col("covered") / F.col("item_words"))
    hits = covered.where(F.col("share") >= coverage)
    best = hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.round(F.max("share"), 6).alias("best_coverage"))
    return items.select("item_id", "suite").join(best, "item_id", "left").fillna({"n_documents": 0, "best_coverage": 0.0})

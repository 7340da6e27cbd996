"""Mixed timestamp notations: readings per value, chosen by Viterbi per source.

Every value gets the array of its valid readings (see ``functions.timestamps``).
The values of one field of one source, in record order, form a chain. A path
through the chain picks one reading per value; it pays for a change of notation
between neighbours and for a step back in time, and the cheapest path wins.

A chain may hold a third of all rows, so it is never one task. It is cut into
blocks of ``BLOCK`` record numbers and solved as (min, +) products:

1. each block gives the cost of its best inner path for every pair of first and
   last reading;
2. the blocks of a chain, one small row each, are joined to the best path over
   block borders, which fixes each block's first and last reading;
3. each block is solved again between its fixed ends.

The result is that of one Viterbi pass over the whole chain, whatever the
cut. Rows with a single reading pass through the same model: they fix the path.
Where that holds for every value of a chain, its only path is its readings, and
the chain is given as read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.timestamps import readings
from vulnlake.session import reliable_checkpoint

#: Record numbers per block of a chain.
BLOCK = 1 << 16
#: Cost of a change of notation, and of a step back in time.
SWITCH, BACKWARD = 1.0, 2.5

_VALUES = "field_name string, source_code string, row_no long, kind int, micros long, more array<struct<kind:int,micros:long>>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values that have a reading: the first inline, further ones in ``more`` (null
    for most values). A table function, so that no filter runs it twice."""
    for batch in batches:
        kinds, micros, more, kept = [], [], [], []
        for place, (text, order, zone) in enumerate(zip(batch["value"], batch["date_order"], batch["home_zone"])):
            found = readings(text, order, zone)
            if found:
                kept.append(place)
                kinds.append(found[0][0])
                micros.append(found[0][1])
                more.append([{"kind": k, "micros": m} for k, m in found[1:]] if len(found) > 1 else None)
        rows = batch[["field_name", "source_code", "row_no"]].take(kept)
        yield rows.assign(kind=np.array(kinds, dtype=np.int32), micros=np.array(micros, dtype=np.int64), more=pd.Series(more, dtype=object, index=rows.index))


def _step(before: list[tuple[int, int]], after: list[tuple[int, int]]) -> np.ndarray:
    """Costs of the step from each reading of one value to each of the next."""
    kind_a, time_a = (np.array([r[i] for r in before])[:, None] for i in (0, 1))
    kind_b, time_b = (np.array([r[i] for r in after])[None, :] for i in (0, 1))
    return SWITCH * (kind_a != kind_b) + BACKWARD * (time_b < time_a)


def _columns(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]:
    """Kinds and instants in record order, and all readings of the values that have several."""
    order = np.argsort(block["row_no"].to_numpy(), kind="stable")
    block = block.iloc[order]
    kinds, micros = block["kind"].to_numpy(dtype=np.int64), block["micros"].to_numpy(dtype=np.int64)
    open_at = np.flatnonzero(block["more"].notna().to_numpy())
    more = block["more"].to_numpy()
    many = {
        int(i): [(int(kinds[i]), int(micros[i]))] + [(int(r["kind"]), int(r["micros"])) for r in more[i]]
        for i in open_at
    }
    return kinds, micros, many


def _fixed_cost(kinds: np.ndarray, micros: np.ndarray) -> float:
    return float(SWITCH * np.count_nonzero(kinds[1:] != kinds[:-1]) + BACKWARD * np.count_nonzero(micros[1:] < micros[:-1]))


def _states(i: int, kinds: np.ndarray, micros: np.ndarray, many: dict) -> list[tuple[int, int]]:
    return many.get(i) or [(int(kinds[i]), int(micros[i]))]


def _stretches(size: int, many: dict) -> list[tuple[int, int]]:
    """(start, end) of the stretches between which the model has a choice: whole
    runs of single readings count as one stretch and cost what they cost."""
    cuts, last = [], 0
    for i in sorted(many):
        if i > last:
            cuts.append((last, i))
        cuts.append((i, i + 1))
        last = i + 1
    if last < size:
        cuts.append((last, size))
    return cuts


def _forward(kinds: np.ndarray, micros: np.ndarray, many: dict) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, int]]]:
    """(min, +) product over a block, the best predecessors, and the stretches."""
    stretches = _stretches(len(kinds), many)
    first = _states(0, kinds, micros, many)
    total = np.full((len(first), len(first)), np.inf)
    np.fill_diagonal(total, 0.0)
    back: list[np.ndarray] = []
    before = first
    for k, (start, end) in enumerate(stretches):
        if k:
            after = _states(start, kinds, micros, many)
            paths = total[:, :, None] + _step(before, after)[None, :, :]
            back.append(paths.argmin(axis=1))
            total, before = paths.min(axis=1), after
        if end - start > 1:
            total = total + _fixed_cost(kinds[start:end], micros[start:end])
            before = [(int(kinds[end - 1]), int(micros[end - 1]))]
    return total, back, stretches


_SUMMARY = "field_name string, source_code string, block long, first_states string, last_states string, costs string"


def _summarise(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    kinds, micros, many = _columns(block)
    total, _, _ = _forward(kinds, micros, many)
    n = len(kinds)
    dump = lambda states: ";".join(f"{k},{m}" for k, m in states)
    return pd.DataFrame(
        {
            "field_name": [key[0]],
            "source_code": [key[1]],
            "block": [key[2]],
            "first_states": [dump(_states(0, kinds, micros, many))],
            "last_states": [dump(_states(n - 1, kinds, micros, many))],
            "costs": [";".join(",".join(repr(float(x)) for x in row) for row in total)],
        }
    )


_ENDS = "field_name string, source_code string, block long, enter_at int, leave_at int"


def _join_blocks(summaries: pd.DataFrame) -> pd.DataFrame:
    """The best first and last reading of each block of one chain."""
    summaries = summaries.sort_values("block", kind="stable")
    load = lambda text: [tuple(map(int, s.split(","))) for s in text.split(";")]
    firsts, lasts = [load(t) for t in summaries["first_states"]], [load(t) for t in summaries["last_states"]]
    costs = [np.array([[float(x) for x in row.split(",")] for row in t.split(";")]) for t in summaries["costs"]]
    best: np.ndarray = np.zeros(len(firsts[0]))
    entered, left = [], []
    for i, cost in enumerate(costs):
        if i:
            paths = best[:, None] + _step(lasts[i - 1], firsts[i])
            left.append(paths.argmin(axis=0))
            best = paths.min(axis=0)
        paths = best[:, None] + cost
        entered.append(paths.argmin(axis=0))
        best = paths.min(axis=0)
    leave = int(best.argmin())
    rows = []
    for i in range(len(costs) - 1, -1, -1):
        enter = int(entered[i][leave])
        rows.append((enter, leave))
        if i:
            leave = int(left[i - 1][enter])
    rows.reverse()
    return summaries[["field_name", "source_code", "block"]].assign(enter_at=[r[0] for r in rows], leave_at=[r[1] for r in rows])


_CHOSEN = "field_name string, source_code string, row_no long, utc_micros long, reading_kind int"


def _choose(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    rows = np.sort(block["row_no"].to_numpy(), kind="stable")
    kinds, micros, many = _columns(block)
    if many:
        enter, leave = int(block["enter_at"].iloc[0]), int(block["leave_at"].iloc[0])
        _, back, stretches = _forward(kinds, micros, many)
        state = leave
        for k in range(len(stretches) - 1, -1, -1):
            start, end = stretches[k]
            if end - start == 1 and start in many:
                kinds[start], micros[start] = many[start][state]
            if k:
                state = int(back[k - 1][enter, state if end - start == 1 else 0])
    return pd.DataFrame({"field_name": key[0], "source_code": key[1], "row_no": rows, "utc_micros": micros, "reading_kind": kinds.astype(np.int32)})


CHAIN = ["field_name", "source_code"]


def choose_readings(values: DataFrame) -> DataFrame:
    """Viterbi over ``values(field_name, source_code, row_no, kind, micros, more)``.

    A chain is one field of one source (both not null). Gives ``field_name,
    source_code, row_no, utc_micros, reading_kind``, one row per input row. Rows
    of equal number in one chain are taken in any order. The values are written
    once, with all their readings; chains without any choice (all of them, where
    the registry settles every value) go out from there without a shuffle.
    """
    values = reliable_checkpoint(values.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in CHAIN}))
    as_read = lambda df: df.select(*CHAIN, "row_no", F.col("micros").alias("utc_micros"), F.col("kind").alias("reading_kind"))
    chains = values.groupBy(*CHAIN).agg(F.max(F.col("more").isNotNull()).alias("open")).where("open")
    if chains.isEmpty():
        return as_read(values)
    chains = reliable_checkpoint(chains.select(*CHAIN))
    return as_read(values.join(chains, CHAIN, "left_anti")).unionByName(_viterbi(values.join(chains, CHAIN, "left_semi")))


def _viterbi(values: DataFrame) -> DataFrame:
    """Steps 1 to 3 above."""
    block = F.coalesce(F.floor(F.col("row_no") / F.lit(BLOCK)).cast("bigint"), F.lit(0).cast("bigint"))
    blocks = values.withColumn("block", block).repartition(*CHAIN, "block")
    summaries = blocks.groupBy(*CHAIN, "block").applyInPandas(_summarise, _SUMMARY)
    ends = summaries.groupBy(*CHAIN).applyInPandas(_join_blocks, _ENDS)
    return blocks.join(ends.hint("merge"), [*CHAIN, "block"]).groupBy(*CHAIN, "block").applyInPandas(_choose, _CHOSEN)


def read_values(df: DataFrame, row_no: str, source: str, fields: list[str], registry: DataFrame | None) -> DataFrame:
    """The values of ``fields`` that have a reading, one row each, with all readings."""
    flat = df.select(
        F.col(row_no).cast("bigint").alias("row_no"),
        F.coalesce(F.col(source), F.lit("")).alias("source_code"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))).alias("v"),
    ).select("row_no", "source_code", "v.field_name", "v.value")
    flat = flat.where(F.col("value").rlike("[0-9]") & F.col("row_no").isNotNull())
    if registry is None:
        zoned = flat.withColumns({"home_zone": F.lit(None).cast("string"), "date_order": F.lit(None).cast("string")})
    else:
        rules = registry.select("source_code", "home_zone", "date_order").dropDuplicates(["source_code"])
        zoned = flat.join(rules, "source_code", "left")
    return zoned.select("field_name", "source_code", "row_no", "value", "date_order", "home_zone").mapInPandas(_read, _VALUES)


def normalise_times(df: DataFrame, row_no: str, source: str, fields: list[str], registry: DataFrame | None, label: str) -> DataFrame:
    """One UTC instant per readable value of ``fields``.

    ``registry(source_code, home_zone, date_order)`` settles zones and the order
    of numeric dates; a source it lacks (or null) is read as UTC with every order
    possible, and Viterbi chooses. Null, blank and unreadable values, and rows
    without number, give no row; an empty input gives an empty result. Other columns of ``df`` are not
    carried. Gives ``table_name, row_no, field_name, source_code, utc_micros``.
    """
    chosen = choose_readings(read_values(df, row_no, source, fields, registry))
    return chosen.select(F.lit(label).alias("table_name"), "row_no", "field_name", "source_code", "utc_micros")

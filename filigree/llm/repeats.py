"""Exact repeated windows of a corpus: the machinery that the suffix-array and suffix-tree jobs share.

Three passes, each a shuffle of hashes and places, never of suffix texts:

1. Each document is cut into records (see ``anchors``), about one for every ``reach / 2`` windows. A record travels as (prefix hash, whole
   hash, document, place) and is range-partitioned by that pair, so that a prefix which a third of all
   documents share is split further by what follows it. Records equal as a whole are decided here.
2. Only records that share a prefix with different ones are opened: their single windows travel as (window hash, document, place).
3. Decided ranges go back to their documents.

Equal records and windows of one task are folded to one row before each shuffle. Rows that are
decided by that travel on under a spread-out key. Groups cut by a batch or partition boundary are opened in pass 2, where the
comparison is complete; that costs rows, never results. Hashes have 64 bits.

A document is named by its id. Rows with the same id count as one place: a repeated row is no repeat of itself, and what is removed in one is
removed in all, as far as its text reaches. A NULL id is one id, before all others. NULL texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filigree.llm import anchors
from filigree.llm.words import SEEDS, as_bytes, mix, word_hashes
from filigree.sources.staging import stage

NO_ID = -(1 << 63)
#: Rows that a task holds at once before it folds and sends them.
FOLD = 1 << 20
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(SEEDS[1]))
_TWIN, _DECIDED = 1, 2  # flags of a row: equal rows were folded into it; it is decided already
_FULL, _OPEN = 1, 2  # verdicts: all windows are removed; its windows have to be looked at


class Job(NamedTuple):
    """What to look for: windows of ``width`` units; ``earlier``: only later copies count as repeats."""

    width: int
    reach: int
    gram: int
    words: bool
    earlier: bool

    def units(self, data: bytes) -> np.ndarray:
        return word_hashes(data) if self.words else _VALUES[np.frombuffer(data, np.uint8)]


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before in any of the columns; the first row does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _fold(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """One row for each distinct key; the others are decided and get a key that spreads them. ``at`` gets two bits of flags."""
    order = np.lexsort((at, doc, *reversed(keys)))
    keys, doc, at = [k[order] for k in keys], doc[order], at[order]
    real = _changes(*keys, doc, at)  # a repeated row of the table is the same place
    keys, doc, at = [k[real] for k in keys], doc[real], at[real]
    first = _changes(*keys)
    last = np.append(first[1:], True)
    flags = np.where(first, np.where(last, 0, _TWIN), _DECIDED)
    spread = mix(doc.view(np.uint64) * np.uint64(SEEDS[0]) + at.view(np.uint64))
    keys = [np.where(first, k, spread) for k in keys]
    return keys, doc, at << 2 | flags


def _records(job: Job) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            prefix, whole, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, doc, at = _fold([prefix, whole], doc, at)
            for k in range(0, len(doc), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield _table(prefix=keys[0][s], whole=keys[1][s], doc=doc[s], at=at[s])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                values = job.units(text or b"")
                found = anchors.records(values, job.width, job.reach, job.gram)
                if not len(found.low):
                    continue
                (prefix,), (whole,) = anchors.keys(values, found, job.width, job.reach, SEEDS[:1])
                parts.append((prefix, whole, np.full(len(prefix), doc, np.int64), found.low << 16 | (found.high - found.low)))
                held += len(prefix)
                if held >= FOLD:
                    yield from flush()
                    parts, held = [], 0
        if parts:
            yield from flush()

    return run


def _verdicts(job: Job, prefix: np.ndarray, whole: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Verdicts on sorted rows, a piece of a sorted partition. The first and last prefix group may go on elsewhere, so they count as mixed."""
    decided = at & _DECIDED > 0
    if decided.any():
        yield _table(doc=doc[decided], at=at[decided] >> 2, verdict=np.full(decided.sum(), _FULL, np.int64))
        prefix, whole, doc, at = (x[~decided] for x in (prefix, whole, doc, at))
    if not len(doc):
        return
    place, twin = at >> 2, at & _TWIN > 0
    group = np.cumsum(_changes(prefix)) - 1
    of_class = np.cumsum(first := _changes(prefix, whole)) - 1
    mixed = np.bincount(group, weights=first) > 1
    mixed[[0, -1]] = True
    head = np.flatnonzero(first)[of_class]
    other = (doc != doc[head]) | (place != place[head])  # not the same place as the first of its class
    if job.earlier:
        verdict = np.where(other, _FULL, np.where(first & mixed[group], _OPEN, 0))
    else:
        many = (np.bincount(of_class, weights=other) > 0)[of_class] | (np.bincount(of_class, weights=twin) > 0)[of_class]
        verdict = np.where(many, _FULL, 0) | np.where(first & mixed[group], _OPEN, 0)
    some = verdict > 0
    yield _table(doc=doc[some], at=place[some], verdict=verdict[some].astype(np.int64))


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: order by the first token, then only within runs of equal tokens by the next."""
    order = np.argsort(columns[0], kind="quicksort")
    tied = np.arange(len(order))  # slots whose rows are not yet told apart
    run = np.zeros(len(order), np.int64)
    for k in range(1, len(columns)):
        rows = order[tied]
        new = np.zeros(len(tied), bool)
        new[1:] = (columns[k - 1][rows][1:] != columns[k - 1][rows][:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new)
        more = np.bincount(run, minlength=1)[run] > 1
        tied, run = tied[more], run[more]
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((columns[k][rows], run))]
    return order


def _classified(job: Job, local_sort: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            if local_sort:
                order = multikey_order(columns)
                columns = [c[order] for c in columns]
            yield from _verdicts(job, *columns)

        for batch in batches:
            if batch.num_rows:
                parts.append([batch.column(k).to_numpy() for k in range(4)])
                held += batch.num_rows
            if held >= FOLD:
                yield from flush()
                parts, held = [], 0
        if parts:
            yield from flush()

    return run


def _windows(job: Job) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            (h,), doc, at = _fold([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
            for k in range(0, len(doc), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield _table(h=h[s], doc=doc[s], at=at[s])

        for batch in batches:
            for doc, text, marks in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), strict=True):
                values = job.units(text or b"")
                packed = np.asarray(marks.values)
                low, more = packed >> 16, (packed & 0xFFFF) + 1
                start = np.repeat(low - (np.cumsum(more) - more), more) + np.arange(more.sum())
                start = np.unique(start[start + job.width <= len(values)])
                if not len(start):
                    continue
                parts.append((anchors.Hasher(values, SEEDS[1]).of(start, start + job.width), np.full(len(start), doc, np.int64), start))
                held += len(start)
                if held >= FOLD:
                    yield from flush()
                    parts, held = [], 0
        if parts:
            yield from flush()

    return run


def _cut(job: Job) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from filigree.llm.words import SPACED, spans

    def one(text: bytes, packed: np.ndarray) -> tuple[int, list[dict[str, int]], bytes]:
        starts, ends = spans(text, SPACED) if job.words else (None, None)
        n = len(starts) if job.words else len(text)
        low, high = packed >> 16, (packed >> 16) + (packed & 0xFFFF) + job.width
        inside = high <= n
        change = np.bincount(low[inside], minlength=n + 1) - np.bincount(high[inside], minlength=n + 1)
        removed = np.cumsum(change)[:n] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))).tolist()
        cuts = [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
        if job.words:
            kept = b" ".join([text[a:b] for a, b, r in zip(starts.tolist(), ends.tolist(), removed.tolist(), strict=True) if not r])
        else:
            kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
        return n, cuts, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t or b"", np.asarray(m.values) if m.is_valid else np.zeros(0, np.int64)) for t, m in zip(as_bytes(batch.column(2)), batch.column(3), strict=True)]
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_units", "spans", "kept"])

    return run


def find(docs: DataFrame, job: Job, *, doc_id: str, text: str, local_sort: bool) -> DataFrame:
    """``doc_id, n_units, spans, kept`` for every row of ``docs``; an empty table gives none."""
    named = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    sent = named.mapInArrow(_records(job), "prefix long, whole long, doc long, at long").repartitionByRange("prefix", "whole")
    # A task judges its rows a fold at a time, so a group has to lie in one fold or be cut by its ends.
    sent = sent.sortWithinPartitions("prefix", "whole", *(() if local_sort else ("doc", "at")))
    verdicts = stage(sent.mapInArrow(_classified(job, local_sort), "doc long, at long, verdict long"))
    opened = verdicts.where(F.col("verdict").bitwiseAND(_OPEN) > 0).groupBy("doc").agg(F.collect_list("at").alias("marks"))
    rows = named.join(opened.hint("shuffle_hash"), "doc").select("doc", "text", "marks").mapInArrow(_windows(job), "h long, doc long, at long")
    same = Window.partitionBy("h")
    if job.earlier:
        repeat = F.rank().over(same.orderBy("doc", "at")) > 1
    else:
        repeat = (F.min("doc").over(same) < F.max("doc").over(same)) | (F.min("at").over(same) < F.max("at").over(same))
    repeat = repeat | (F.col("at").bitwiseAND(_DECIDED if job.earlier else _DECIDED | _TWIN) > 0)
    marks = stage(rows.withColumn("repeat", repeat).where("repeat").select("doc", F.shiftleft(F.shiftright("at", 2), 16).alias("at")))
    full = verdicts.where(F.col("verdict").bitwiseAND(_FULL) > 0).select("doc", "at")
    removed = full.unionAll(marks).groupBy("doc").agg(F.collect_list("at").alias("marks"))
    every = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    joined = every.join(removed.hint("shuffle_hash"), "doc", "left").select("doc_id", "doc", "text", "marks")
    kind = dict(docs.dtypes)[doc_id]
    return joined.mapInArrow(_cut(job), f"doc_id {kind}, n_units long, spans array<struct<start:int,end:int>>, kept binary")


def n_removed(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))

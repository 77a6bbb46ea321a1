"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``width`` consecutive words of an item; an item of fewer words is one window. Containment has
to be complete, so one prefix word per window is necessary and enough: the word of the window that is rarest
in the documents. A document word that is some window's prefix gives candidates; the window's
length and the word's place in it bound where it can lie, and the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.words import ALNUM, hash_spans, spans, windows

HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = (text or "").encode("utf-8", "replace").lower()
    starts, ends = spans(data, ALNUM)
    return data, starts, ends, hash_spans(data, starts, ends)


class WindowIndex:
    """The windows of a block of items, by prefix word. ``rarity`` gives a word hash's count in the documents."""

    def __init__(self, items: list[tuple[str, str]], width: int, rarity: dict[int, int]) -> None:
        found: dict[tuple[bytes, ...], tuple[int, int, int, set[str]]] = {}
        for item, text in items:
            data, starts, ends, hashes = _words(text)
            n = len(hashes)
            length = min(width, n)
            words = [data[a:b] for a, b in zip(starts, ends, strict=True)]
            ids = hashes.tolist()
            order = [(rarity.get(h, 0), h) for h in ids]
            for k, whole in enumerate(windows(hashes, length).tolist() if n else ()):
                key = tuple(words[k : k + length])
                if key not in found:
                    at = min(range(k, k + length), key=order.__getitem__)
                    found[key] = (ids[at], at - k, whole, set())
                found[key][3].add(item)
        rows = sorted(found.items(), key=lambda kv: kv[1][0])
        self.words = [key for key, _ in rows]
        self.items = [sorted(v[3]) for _, v in rows]
        self.prefix = np.array([v[0] for _, v in rows], np.uint64)
        self.offset = np.array([v[1] for _, v in rows], np.int64)
        self.whole = np.array([v[2] for _, v in rows], np.uint64)
        self.length = np.array([len(key) for key in self.words], np.int64)

    def search(self, text: str | None) -> tuple[int, list[dict[str, int]], list[str]]:
        """Words of the text, maximal hit word ranges, and the items with a window in it."""
        data, starts, ends, hashes = _words(text)
        n = len(hashes)
        lo = np.searchsorted(self.prefix, hashes, "left")
        count = np.searchsorted(self.prefix, hashes, "right") - lo
        at = np.flatnonzero(count)
        if not len(at):
            return n, [], []
        count = count[at]
        entry = np.repeat(lo[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        start = np.repeat(at, count) - self.offset[entry]
        fits = (start >= 0) & (start + self.length[entry] <= n)
        hit = np.zeros(n + 1, np.int64)
        items: set[str] = set()
        for length in np.unique(self.length[entry[fits]]).tolist():
            some = fits & (self.length[entry] == length)
            e, s = entry[some], start[some]
            same = windows(hashes, length)[s] == self.whole[e]
            for k, p in zip(e[same].tolist(), s[same].tolist(), strict=True):
                if all(data[starts[p + j] : ends[p + j]] == w for j, w in enumerate(self.words[k])):
                    hit[p] += 1
                    hit[p + length] -= 1
                    items.update(self.items[k])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]))))
        return n, [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2], strict=True)], sorted(items)


def _rarity(docs: DataFrame, text: str, vocabulary: np.ndarray) -> dict[int, int]:
    """How often the words of an item block occur in all documents: one sum per word and task, then per word."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        totals = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for t in batch[text]:
                hashes = _words(t)[3]
                place = np.searchsorted(known, hashes)
                place[known[np.minimum(place, len(known) - 1)] != hashes] = len(known)
                totals += np.bincount(place, minlength=len(known) + 1)
        seen = np.flatnonzero(totals[:-1])
        yield pd.DataFrame({"place": seen, "n": totals[seen]})

    sums = docs.select(text).mapInPandas(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = {int(vocabulary[r["place"]]): r["n"] for r in sums.collect()}  # at most one row per word of the block
    held.unpersist()
    return out


def find(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, block_bytes: int = 16 << 20) -> Column:
    """``struct(n_words, spans, items)`` for a row of ``docs``: its words, hit word ranges and item ids found.

    Words are runs of ASCII digits, letters and non-ASCII bytes, A-Z lower-cased. Items are taken in blocks of about
    ``block_bytes`` of text, the most that is ever sent to the driver and to a task; a larger benchmark means
    more columns, not a larger index. The result is a row-local column: no shuffle of documents, no skew.
    NULL or wordless texts have no words; NULL or wordless items no windows; an item without id is item ''.
    Items with the same id count once; without items nothing is hit.
    """
    known = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = []
    for b in range(blocks):
        rows = [(r["i"], r["t"]) for r in known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        hashes = [_words(t)[3] for _, t in rows]
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        index = WindowIndex(rows, width, _rarity(docs, text, vocabulary) if len(vocabulary) else {})
        found.append(_column(docs, F.col(text), index))
    return found[0] if blocks == 1 else _merged(found)


def _column(docs: DataFrame, text: Column, index: WindowIndex) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(HITS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.search(t) for t in texts], columns=["n_words", "spans", "items"])

    return run(text)


def _merged(found: list[Column]) -> Column:
    """Hits of several item blocks as one: ranges united, items united."""
    every = F.array_sort(F.flatten(F.array(*[f["spans"] for f in found])))
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    united = F.aggregate(every, F.lit([]).cast("array<struct<start:int,end:int>>"), join)
    return F.struct(found[0]["n_words"].alias("n_words"), united.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.array(*[f["items"] for f in found])))).alias("items"))


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contaminated(hits: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (n_hit(hits) > 0) & (share * n_hit(hits) >= hits["n_words"])

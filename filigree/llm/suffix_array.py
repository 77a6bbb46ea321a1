"""Suffix-array dedup of byte strings.

Suffixes start at content-defined anchors and are read as token sequences: the hash of the bytes that every
window of a record shares, then the hash of all its bytes. Spark's range partitioning samples splitters and deals
suffixes by their leading tokens; each bucket is sorted by multikey quicksort and neighbours are compared. Groups at a bucket's ends are
compared with the other buckets in a second round over single windows. See ``repeats`` for the passes and edge cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from filigree.llm.repeats import Job, find


def repeated_bytes(docs: DataFrame, *, width: int = 200, reach: int = 100, gram: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_units, spans, kept``: bytes covered by a ``width``-byte string that also starts elsewhere are cut.

    Texts are UTF-8 bytes; spans are maximal cut byte ranges; ``kept`` is the rest. Matches never cross documents and overlaps count. NULL and
    texts shorter than ``width`` are kept whole.
    """
    return find(docs, Job(width, reach, gram, words=False, earlier=False), doc_id=doc_id, text=text, local_sort=True)

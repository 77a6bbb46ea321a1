"""Substring dedup of word sequences by prefix-partitioned suffix trees.

The suffixes of a document branch at content-defined anchors. A node is a prefix of a suffix, named by its hash: the words that all
windows of a record share, then all its words. Range partitioning by (short prefix, long prefix) splits the
tree into groups that fit a task: a short prefix if it is rare, longer ones where many suffixes share it. Within
a subtree, an internal node at least ``width`` words deep is a repeat, and its first leaf in corpus order is the one that stays; nodes
that branch before that depth are opened into single windows. See ``repeats`` for the passes and edge cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from filigree.llm.repeats import Job, find


def repeated_words(docs: DataFrame, *, width: int = 20, reach: int = 12, gram: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_units, spans, kept``: words covered by a ``width``-word window that also starts earlier are cut.

    Words are runs without ASCII white space; spans are maximal cut word ranges; ``kept`` is the other words joined by
    one space. Earlier is a smaller id, or the same id and an earlier start. NULL and shorter texts are kept whole.
    """
    return find(docs, Job(width, reach, gram, words=True, earlier=True), doc_id=doc_id, text=text, local_sort=False)

"""Near copies by the Jaccard similarity of five-word shingles: of each group one document stays.

Groups are those of the exact join (`ngram_join.linked`): texts whose sets of shingles have a Jaccard similarity of at least
`similarity` per cent are linked, whatever the size of a group and however common its shingles; no pair is left to chance.
Covering masks, as in `simhash`, can't find these pairs: at 0.8 about 10 of 64 bits differ, and a radius r takes
2^(r + 1) - 1 masks; what they link beyond the join's pairs is below the similarity.

A text with fewer words than a shingle is one shingle. Texts without words, null among them, are copies of one another.
Repeated rows are copies too. Rows without doc_id stay. An empty table gives no rows. Columns of the input stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import one_row_each
from listenlake.llm.ngram_join import linked


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_hash, component) of every row; options: those of `linked`."""
    each, known = linked(docs, **options)
    met = each.join(known.withColumnRenamed("node", "id"), "id", "left")  # the empty set has one id and no links
    return met.select("doc_id", "text_hash", F.coalesce("component", "id").alias("component"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Documents without near copies: of each component the row with the least (doc_id, text hash) stays, one of equal
    rows. Rows without doc_id stay."""
    return one_row_each(docs, near_copies(docs, **options))

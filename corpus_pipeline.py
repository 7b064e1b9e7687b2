"""A corpus pipeline over ``documents``: quality rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared
folder and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from brindle.llm.common import documents, forget, prepared, stored, vocabulary
from brindle.llm.exact_dedup import exact_dedup_rows
from brindle.llm.jaccard import near_duplicate_rows
from brindle.llm.mixing import mixed_rows
from brindle.llm.packing import pack
from brindle.llm.quality_rules import quality_rules

#: Words of a block when sources are mixed: long, so that most texts stay whole.
MIX_BLOCK_WORDS = 512


def quality(spark, docs, sf_dir):
    """Documents that the rules keep, columns unchanged.

    A null or empty text has no words and goes, as has any text of fewer than 50; whole texts are judged, however
    long. Equal rows are judged alike, so all of them stay or go; null ids are carried along. A null language, or
    one without bands, is judged by script. An empty table stays empty; columns of any name are carried along.
    """
    prepared(spark)
    return quality_rules(docs, vocabulary("piece_bpe_32k.model"), carry=True, second=vocabulary("byte_bpe_multi_50k.tiktoken"))


def exact_duplicates(spark, docs, sf_dir):
    """One document of each text (A-Z lower-cased): that with the largest id.

    A null id is smaller than any other; of rows with the same id, that with the smallest hash of all its columns
    stays. Null and empty texts are equal. Whole texts are compared by SHA-256. An empty table stays empty; columns of any name are
    carried along.
    """
    return exact_dedup_rows(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies (five words, a similarity of 0.75): that with the smallest id.

    A null id comes after all others. Texts without words, null ones too, are near to nothing and all stay. Rows
    equal in id and text stay or go together (the stage before leaves one of them). Whole texts are compared. An
    empty table stays empty; columns of any name are carried along.
    """
    return near_duplicate_rows(docs)


def mixing(spark, docs, sf_dir):
    """The documents, or the parts of them, that the mix takes, once for each time.

    A null source is a source of its own; texts without words, null ones too, are never taken. Texts longer than
    a block may be taken in part. Rows equal in id and text count as one (the stages before leave one of them).
    n_chars is the length of what is taken. An empty table stays empty; columns of any name are carried along.
    """
    return mixed_rows(docs, block_words=MIX_BLOCK_WORDS)


def packing(spark, docs, sf_dir):
    """Pieces of the documents in windows of 1024 tokens, with their ids.

    A null or empty text has one id, the end of a document. Equal rows, and the times a document is taken, are
    packed each on its own; null ids are carried along. Whole texts are packed. An empty table gives no pieces; columns
    besides id and text are not read.
    """
    return pack(docs, vocabulary(), window=1024, end_id=0, with_ids=True)


STAGES = [("quality rules", quality), ("exact dedup", exact_duplicates), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: SQL can't express tokenisers and seeded draws; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Pieces of what is left of documents after all stages; each stage's output is written, and the one before it deleted."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

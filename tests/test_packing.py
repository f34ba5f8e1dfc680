import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.operators import documents
from tessera.operators.packing import pack_pages


def page_text(rng):
    parts = []
    for _ in range(rng.randint(0, 4)):
        n = rng.choice([1, 2, 3, 5, 8, 13, 19, 20, 21, 45])
        parts.append("".join(rng.choice("abé ") for _ in range(n)))
    return rng.choice(["\n\n", "\n\n\n", "\n\n \n\n"]).join(parts)


@pytest.mark.parametrize("size,overlap", [(20, 4), (20, 13), (50, 0)])
def test_blocks_give_what_the_fold_gives(spark, size, overlap):
    rng = random.Random(size + overlap)
    rows = [(doc, page, page_text(rng)) for doc in range(12) for page in range(rng.choice([1, 2, 9, 40]))]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "doc long, page int, text string").repartition(6)
    got = pack_pages(pages, "doc", "page", "text", size, overlap, 10, pages_per_block=3, chunks_per_group=4)
    docs = documents.assemble_pages(pages, "doc", "page", "text").where(F.char_length("text") >= 10)
    want = documents.explode_pieces(docs, chunking.packed_chunks(F.col("text"), size, overlap), "doc")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_short_documents_only(spark):
    pages = spark.createDataFrame([("d", 0, "a" * 600), ("e", 0, "b")], "doc string, page int, text string")
    got = pack_pages(pages, "doc", "page", "text").collect()
    assert [(r["doc"], r["chunk_index"], r["end_char"]) for r in got] == [("d", 0, 600)]

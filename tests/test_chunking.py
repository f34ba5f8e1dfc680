import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.operators import documents


def collect(spark, text, col):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(col.alias("v")).first()["v"]


def packed(spark, text, **kw):
    rows = collect(spark, text, chunking.packed_chunks(F.col("text"), **kw))
    return None if rows is None else [(len(r["text"]), r["start_char"], r["end_char"]) for r in rows]


def paras(*lengths):
    return "\n\n".join("x" * n for n in lengths)


def test_packing_golden(spark):
    assert packed(spark, paras(1000, 1000, 3000, 100)) == [
        (1000, 0, 1000), (1000, 800, 1800), (1500, 1002, 2502), (1500, 2302, 3802),
        (400, 3602, 4002), (100, 1600, 1700),
    ]


def test_packing_boundaries(spark):
    assert [c[0] for c in packed(spark, paras(700, 798))] == [1500]
    assert [c[0] for c in packed(spark, paras(700, 799))] == [700, 799]
    assert [c[0] for c in packed(spark, paras(2700))] == [1500, 1400, 100]
    assert [c[0] for c in packed(spark, paras(2700), drop_contained_tail=True)] == [1500, 1400]
    assert packed(spark, "") == [] and packed(spark, " \n\n  \n\n") == []
    assert packed(spark, None) is None


def test_true_offsets_slice_the_text(spark):
    text = "  intro \n\n " + "a" * 900 + "\n\n\n\n" + "b" * 900 + " \n\n" + "c" * 3300 + "\n\nend"
    rows = collect(spark, text, chunking.packed_chunks(F.col("text")))
    for r in rows:
        piece = text[r["src_start"] : r["src_end"]]
        if len(r["text"]) == len(piece):
            assert piece == r["text"]
        else:  # paragraphs with white space between them, joined by a blank line
            assert "\n\n".join(p.strip() for p in piece.split("\n\n") if p.strip()) == r["text"]


@pytest.mark.parametrize(
    "n,count", [(50, 0), (51, 1), (800, 1), (801, 2), (1500, 2), (1501, 3), (1489, 2), (1723, 3), (1156, 2),
                (1111, 2), (1147, 2), (1181, 2)],
)
def test_sliding_counts(spark, n, count):
    chunks = collect(spark, "x" * n, chunking.sliding_chunks(F.col("text")))
    assert len(chunks) == count


def by_position(text, size, overlap, stop_at_end):
    """Windows start at multiples of the step; with a stop, none starts within the overlap of the last."""
    starts = range(0, len(text), size - overlap)
    return [text[i : i + size] for i in starts if not (stop_at_end and i and i + overlap >= len(text))]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    text=st.text(alphabet="ab é🦆\n", max_size=120),
    size=st.integers(1, 20),
    overlap=st.integers(0, 19),
    stop=st.booleans(),
)
def test_windows_match_slicing(spark, text, size, overlap, stop):
    if overlap >= size:
        with pytest.raises(ValueError):
            chunking.run_to_end_windows(F.col("text"), size, overlap)
        return
    got = collect(spark, text, chunking.run_to_end_windows(F.col("text"), size, overlap, stop))
    assert got == by_position(text, size, overlap, stop)


def test_long_text_windows(spark):
    text = "é0123456789" * 30_000
    got = collect(spark, text, chunking.run_to_end_windows(F.col("text")))
    assert got == by_position(text, 1500, 200, False)


def test_assembly_strips_and_skips_blank_pages(spark):
    rows = [(1, 2, " b "), (1, 0, "a\n"), (1, 1, "  "), (2, 0, None)]
    pages = spark.createDataFrame(rows, "doc int, page int, text string")
    got = {r["doc"]: (r["text"], r["page_count"]) for r in documents.assemble_pages(
        pages, "doc", "page", "text").collect()}
    assert got == {1: ("a\n\nb", 3), 2: ("", 1)}


def test_assembly_in_blocks_is_the_same(spark):
    rows = [(i % 3, i, "" if i % 7 == 0 else f" p{i} ") for i in range(200)]
    pages = spark.createDataFrame(rows, "doc int, page int, text string").repartition(5)
    whole = documents.assemble_pages(pages, "doc", "page", "text", 1000).collect()
    blocks = documents.assemble_pages(pages, "doc", "page", "text", 8).collect()
    assert sorted(whole) == sorted(blocks) and len(whole) == 3

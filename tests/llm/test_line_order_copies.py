"""Line dedup: order of any ids, copies as a whole, columns whose names clash; the other drop_* functions' values."""

import pytest

from jobsift.llm import bench, linededup, minhash, quality
from llm_helpers import prose

LINE = "one two three four five six seven"


@pytest.mark.parametrize(("ids", "kind"), [
    ((2**43 - 1, 2**43 + 5), "long"), ((5, 2**44 + 1), "long"), ((-3, 2**62), "long"), (("a10", "b2"), "string"),
    ((7, None), "long"), (("z", None), "string"), ((2**62, None), "long")])
def test_the_later_document_loses_its_line(spark, ids, kind):
    rows = [(ids[1], LINE + " x\nown words of the later one here"), (ids[0], "others in the first of both\n" + LINE)]
    got = linededup.removed_lines(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(2)).collect()
    assert {r.doc_id: list(r.removed) for r in got} == {ids[0]: [], ids[1]: [0]}


def test_copies_keep_what_they_share_and_others_do_not(spark):
    lines = [prose(i, 40, 5000) for i in range(8)]
    copy = list(lines)
    copy[3:5] = [lines[3] + " " + lines[4]]                      # broken elsewhere
    copy[1] = "changed " + lines[1]
    half = lines[:4] + [prose(100 + i, 40, 5000) for i in range(4)]  # half of its words are its own
    shared = prose(55, 12, 5000)
    rows = [(1, "\n".join([shared, "x y z w v u"])), (2, "\n".join([*lines, shared])), (3, "\n".join([shared, *copy])),
            (4, "\n".join(half)), (5, "\n".join(lines[5:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in linededup.drop_matched_lines(df).collect()}
    assert got[2] == lines and got[3] == copy       # ``shared`` goes from both, as another document had it
    assert got[4] == half[4:] and 5 not in got      # no copies of document 2
    kept = minhash.drop_near_duplicates(linededup.drop_matched_lines(df)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 4]


NAMES = ["_key", "_gone", "_left", "_k", "_row", "removed_lines", "score", "base", "KEY"]


def test_clashing_columns_keep_their_values(spark):
    rows = [(i, prose(i // 2, 70, 5000) if i < 6 else prose(i, 70, 5000) + "\n" + LINE, f"s{i % 2}",
             *(f"{c}{i}" for c in NAMES)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES))
    items = spark.createDataFrame([(1, prose(7, 70, 5000))], "item_id long, text string")
    for out in (linededup.drop_matched_lines(df), minhash.drop_near_duplicates(df), bench.decontaminate(df, items),
                quality.clean_documents(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in NAMES)


def test_leaks_begin_at_the_word_and_repeated_rows_are_one(spark):
    item = prose(3, 40, 5000)
    df = spark.createDataFrame([(1, "- " + item), (2, "a b " + item), (2, "a b " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "... " + item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start) for r in bench.find_leaks(df, items).collect())
    assert got == [(1, 9, 0), (2, 9, 2)]
    windows = {r.doc_id: r.n_windows for r in bench.find_leaks(df, items).collect()}
    assert windows[1] <= windows[2] <= windows[1] + 8

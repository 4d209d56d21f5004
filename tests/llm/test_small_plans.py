"""Plans that the driver holds: no broadcast in the rounds of components, and
the fingerprints' sums of 64 bits are not planned again with later steps."""

from jobsift.llm import bench, graph
from llm_helpers import prose


def _explained(df):
    return df._jdf.queryExecution().toString()


def test_components_join_without_broadcasts(spark, monkeypatch):
    plans, plain = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: plans.append(_explained(df)) or plain(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 9)], "a long, b long")
        got = {(r.node, r.comp) for r in graph.components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 4)}
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p] and any("SortMergeJoin" in p for p in plans)


def test_fingerprints_are_planned_once(spark):
    passage = prose(1, 30)
    docs = spark.createDataFrame([(1, prose(2, 40) + " " + passage), (2, prose(3, 60)), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, prose(4, 20))], "item_id long, text string")
    found = bench.find_leaks(docs, items)
    assert [(r.doc_id, r.item_id, r.start) for r in found.collect()] == [(1, 7, 40)]
    assert "b63" not in _explained(found)

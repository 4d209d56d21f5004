"""Randomised checks against brute-force Python versions of the SQL
semantics (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from jobsift.operators import dedup as DD

rows_st = st.lists(
    st.tuples(st.sampled_from(["u1", "u2", "u3", None]), st.sampled_from(["a", "b", "c", None])),
    min_size=0, max_size=12)


def py_latest_url(rows):
    best = {}
    for seq, url, _ in rows:
        if url not in best or seq > best[url]:
            best[url] = seq
    return {seq for seq in best.values()}


def py_strict(rows):
    """seq IN (max seq per url) AND description NOT IN (descriptions with
    more than one row), with SQL's three-valued NOT IN."""
    keep_url = py_latest_url(rows)
    counts = {}
    for _, _, d in rows:
        counts[d] = counts.get(d, 0) + 1
    dup = {d for d, n in counts.items() if n > 1}
    out = set()
    for seq, _, d in rows:
        if seq not in keep_url:
            continue
        if not dup:
            out.add(seq)
        elif d is None or d in dup or None in dup:
            continue
        else:
            out.add(seq)
    return out


def py_latest(rows):
    s1 = [r for r in rows if r[0] in py_latest_url(rows)]
    best = {}
    for seq, _, d in s1:
        if d is not None and (d not in best or seq > best[d]):
            best[d] = seq
    return {seq for seq, _, d in s1 if d is None or best[d] == seq}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_st)
def test_dedup_matches_sql_semantics(spark, pairs):
    rows = [(i + 1, u, d) for i, (u, d) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "seq bigint, url string, description_text string")
    assert {r.seq for r in DD.dedup_strict(df).collect()} == py_strict(rows)
    latest = DD.dedup_latest(df)
    assert {r.seq for r in latest.collect()} == py_latest(rows)
    assert {r.seq for r in DD.dedup_latest(latest).collect()} == py_latest(rows)  # idempotent

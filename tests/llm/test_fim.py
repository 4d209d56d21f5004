"""op13: exact round trips, the order of the parts, edge rows, the SQL."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobsift.llm import fim, q_fim
from llm_helpers import SMOKE, docs, edge_docs, no_docs  # noqa: F401
from tools.oracle_compare import compare, duck

PIECES = st.lists(st.sampled_from(["word", "é", "😀", "<", "P", ">", "<P", "<S>", " ", "\n", "S>", "12", "ß"]), max_size=30)


def plainly(text, doc_id, seed=1):
    """The contract over units, by slices."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(0, 10**6))
def test_forms_and_round_trip(pieces, doc_id):
    text = "".join(pieces)
    n, form, cut, cut2 = fim.plan(text.encode(), doc_id)
    out = fim.transform(text.encode(), form, cut, cut2)
    want = plainly(text, doc_id)
    assert (n, form, out.decode()) == (want[0], want[1], want[4])
    assert fim.restore(out, form).decode() == text


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_of_a_text(form):
    text = "a<b <Pé>\n\n<<S".encode()
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            p, m, s = text[:i], text[i:j], text[j:]
            out = fim.transform(text, form, i, j)
            assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
            assert fim.restore(out, form) == text


def test_reversal_of_long_blocks():
    import numpy as np
    for n in (0, 1, 2, 5, 3 * fim._BLOCK + 7, 2 * fim._BLOCK):
        data = np.random.default_rng(n).integers(0, 256, n + 4).astype(np.uint8)
        want = np.concatenate([data[:2], data[2:n + 2][::-1], data[n + 2:]])
        fim.reverse(data, 2, n + 2)
        assert (data == want).all()


def test_edge_rows(spark, edge_docs):
    got = fim.restore_texts(fim.fill_in_middle(edge_docs)).collect()
    want = edge_docs.select("doc_id", "text").collect()
    assert len(got) == len(want)
    view = lambda r: (str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)
    assert sorted(map(view, got), key=repr) == sorted(
        ((str(d), *plainly(t or "", d), t or "") for d, t in want), key=repr)


def test_text_ids_and_small_batches(spark, docs, monkeypatch):
    d = docs.selectExpr("concat('k', doc_id) as doc_id", "text", "'x' as output", "'y' as form")
    monkeypatch.setattr(fim, "BATCH_BYTES", 1)  # one text a batch
    batches = list(fim._transform_batches(1)(d.limit(20).toArrow().select(["doc_id", "text"]).combine_chunks().to_batches()))
    assert sum(b.num_rows for b in batches) == 20
    back = [r for b in batches for r in fim._restore_batches([b])]
    assert [t for b in back for t in b.column("restored").to_pylist()] == [r.text for r in d.limit(20).collect()]
    assert fim.fill_in_middle(d).count() == d.count()


def test_empty(spark, no_docs):
    assert fim.restore_texts(fim.fill_in_middle(no_docs)).count() == 0


def test_query_against_sql(spark):
    res = compare(spark, duck(SMOKE), SMOKE, "op13", q_fim.op13_fill_in_middle, q_fim.ORACLE)
    assert res["status"] == "match" and "types" not in res, res

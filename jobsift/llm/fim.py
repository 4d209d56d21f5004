"""Fill-in-middle: documents cut in three and put in another order, in place.

A text is cut into units (runs of ASCII letters, else single code points).
Two cuts give prefix, middle and suffix.  The text lies in one bytearray with
its sentinels put in at the cuts, ``<P>`` prefix ``<M>`` middle ``<S>`` suffix;
the order of a form is one exchange of two neighbouring segments, done in
place by three reversals:

* psm: ``<M>`` middle and ``<S>`` suffix change places;
* spm: ``<S>`` suffix changes places with all before it.

``restore`` finds the sentinels of a form, turns the same exchange back and
takes them out.  A text that holds a sentinel stays plain, so every sentinel
of an output is one that was put in: none can begin in the text and end in a
sentinel, as ``<`` is only its first character.

Cuts and forms are drawn from sha256 of (seed, doc_id), so reruns and other
file splits agree.

Defined cases: a null text counts as empty; an empty text is plain; a null
doc_id is drawn as the empty id; repeated rows give equal rows; an empty table
gives an empty result; extra columns are never read.  Whole texts are taken,
and outputs leave a task in batches of ``BATCH_BYTES`` (or one text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The sentinels.
PRE, SUF, MID = b"<P>", b"<S>", b"<M>"
SIGN = 3               # bytes of a sentinel
PLAIN_FROM = 90        # of 100: draws from here on stay plain
SPM_BELOW = 20         # of 100: draws below are spm, the others psm
BATCH_BYTES = 16 << 20
_BLOCK = 1 << 16       # bytes that a reversal holds aside

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def draws(doc_id, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 bytes begin."""
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverse view[lo:hi] in place, block against mirrored block."""
    half = (hi - lo) // 2
    for i in range(0, half, _BLOCK):
        w = min(_BLOCK, half - i)
        left = view[lo + i:lo + i + w].copy()
        view[lo + i:lo + i + w] = view[hi - i - w:hi - i][::-1]
        view[hi - i - w:hi - i] = left[::-1]


def exchange(buf: bytearray, lo: int, at: int, hi: int) -> None:
    """buf[lo:at] and buf[at:hi] change places."""
    view = np.frombuffer(buf, np.uint8)
    reverse(view, lo, at)
    reverse(view, at, hi)
    reverse(view, lo, hi)


def transform(text: bytes, form: str, cut: int, cut2: int) -> bytes:
    """The text in its form, cut at two byte offsets (the lesser first)."""
    if form == "plain":
        return text
    buf = bytearray(text)
    for at, sign in ((cut2, SUF), (cut, MID), (0, PRE)):  # from the end: earlier offsets hold
        buf[at:at] = sign
    middle, suffix = cut + SIGN, cut2 + 2 * SIGN
    exchange(buf, middle if form == "psm" else 0, suffix, len(buf))
    return bytes(buf)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` gave this output for."""
    if form == "plain":
        return output
    buf = bytearray(output)
    lo, at = (buf.find(SUF), buf.find(MID)) if form == "psm" else (0, buf.find(PRE))
    exchange(buf, lo, at, len(buf))
    # now <P> prefix <M> middle <S> suffix
    middle = buf.find(MID)
    suffix = buf.find(SUF)
    for i in (suffix, middle, 0):
        del buf[i:i + SIGN]
    return bytes(buf)


def plan(text: bytes, doc_id, seed: int = 1) -> tuple[int, str, int, int]:
    """n units, form, the two cuts as byte offsets."""
    data = np.frombuffer(text, np.uint8)
    starts = unit_starts(data) if len(data) else np.zeros(0, np.int64)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or any(s in text for s in (PRE, SUF, MID)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(starts[i]) if i < n else len(text) for i in (a, b)]
    return n, "spm" if h4 % 100 < SPM_BELOW else "psm", *at


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


_COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def _transform_batches(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rows, size = b.schema.field("doc_id").type, [], 0

            def flush():
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_COLUMNS)
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, form, cut, cut2 = plan(text, doc_id, seed)
                chars = (None, None) if form == "plain" else (code_points(text[:cut]), code_points(text[cut:cut2]))
                out = transform(text, form, cut, cut2)
                rows.append((doc_id, n, form, *chars, out.decode()))
                size += len(out)
                if size >= BATCH_BYTES:
                    yield flush()
                    rows, size = [], 0
            yield flush()
    return run


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, form (plain, psm or spm), prefix_chars,
    middle_chars (code points, null if plain), output."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _transform_batches(seed),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, texts, size = 0, [], 0

        def flush(end):
            rest = b.slice(at, end - at)
            return pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())],
                                              names=[*b.schema.names, "restored"])
        for i, (out, form) in enumerate(zip(b.column("output"), b.column("form").to_pylist(), strict=True)):
            out = out.as_buffer().to_pybytes()
            texts.append(restore(out, form).decode())
            size += len(out)
            if size >= BATCH_BYTES:
                yield flush(i + 1)
                at, texts, size = i + 1, [], 0
        yield flush(b.num_rows)


def restore_texts(rows: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with ``restored``, the text, from output and form."""
    cols = rows.select(*_COLUMNS)
    kind = dict(rows.dtypes)["doc_id"]
    return cols.mapInArrow(
        _restore_batches, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, "
                          "output string, restored string")

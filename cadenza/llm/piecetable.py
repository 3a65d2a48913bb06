"""Fill-in-the-middle transformation over piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers
that never change: the text's UTF-8 bytes and the sentinels. Cutting splits
descriptors, an arrangement permutes them and puts sentinel descriptors
between them, the inverse permutation brings the text back. A hash streams the
descriptors' bytes; a text is only copied when the result's column is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import slices

TEXT, SENTINEL = 0, 1
#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Parts (0 prefix, 1 middle, 2 suffix) in the order of each form, each behind its sentinel.
ORDER = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
PLAIN = "plain"
#: Per cent of documents that are rearranged, and of those in suffix-first form.
FIM_PERCENT, SPM_PERCENT = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"): ord("Z") + 1] = _LETTER[ord("a"): ord("z") + 1] = True


class PieceTable:
    """Descriptors over an immutable text and the sentinels; offsets are bytes of UTF-8."""

    def __init__(self, text, pieces: list[tuple[int, int, int]] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *at: int) -> list[list[tuple[int, int, int]]]:
        """The descriptors of the parts between the ascending offsets ``at``; a descriptor across one is split."""
        parts: list[list[tuple[int, int, int]]] = [[]]
        cuts, done = list(at), 0
        for buffer, start, length in self.pieces:
            while cuts and cuts[0] <= done + length:
                head = cuts.pop(0) - done
                parts[-1].append((buffer, start, head))
                parts.append([])
                start, length, done = start + head, length - head, done + head
            parts[-1].append((buffer, start, length))
            done += length
        return parts + [[] for _ in cuts]

    def arrange(self, parts: list[list[tuple[int, int, int]]], form: str) -> PieceTable:
        """The parts in the form's order, each behind its sentinel."""
        pieces = []
        for mark, part in ORDER[form]:
            pieces += [(SENTINEL, SENTINELS.index(mark), len(mark)), *parts[part]]
        return PieceTable(self.buffers[TEXT], pieces)

    def restore(self, form: str) -> PieceTable:
        """The text's table from an output's: cut around the sentinels, their pieces left out, the permutation undone."""
        if form == PLAIN:
            return self
        text, order = bytes(self.buffers[TEXT]), ORDER[form]
        at = [i for mark, _ in order for i in (text.index(mark), text.index(mark) + len(mark))]
        parts = self.cut(*at)[2::2]  # the cuts leave: nothing, sentinel, part, sentinel, part, sentinel, part
        places = sorted(range(3), key=lambda i: order[i][1])
        return PieceTable(self.buffers[TEXT], [p for i in places for p in parts[i]])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start: start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.stream())


def units(text) -> np.ndarray:
    """Byte offsets at which the units begin: a run of ASCII letters, or any other single code point."""
    u = np.frombuffer(text, np.uint8)
    begins = (u & 0xC0) != 0x80
    letter = _LETTER[u]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def chars(text) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four unsigned 32-bit numbers from the document's number."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i: i + 4], "big") for i in range(0, 16, 4)]


def transform(text, doc_id: int | None, seed: int = 1, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> tuple[PieceTable, int, str, int | None, int | None]:
    """(output's piece table, units, form, code points of the prefix, of the middle) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    at, whole, table = units(text), bytes(text), PieceTable(text)
    n = len(at)
    if not n or any(m in whole for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return table, n, PLAIN, None, None
    low, high = (int(at[k]) if k < n else len(whole) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return table.arrange(table.cut(low, high), form), n, form, chars(text[:low]), chars(text[low:high])


def _bytes(column: pa.Array) -> Iterator[memoryview]:
    """Every value's bytes, without a copy; null is empty."""
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset: values.offset + len(values) + 1]
    data = memoryview(values.buffers()[2] or b"")
    for i, null in enumerate(values.is_null().to_pylist()):
        yield memoryview(b"") if null else data[offsets[i]: offsets[i + 1]]


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary()).cast(pa.large_string())


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.large_string()), ("output_sha256", pa.string())])


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256): every row of ``docs``, rearranged.

    * null text: the empty one; empty texts and texts that hold a sentinel: form plain, output as they are;
    * null doc_id: drawn as if its decimal were empty; equal ids draw the same numbers, so repeated rows come out alike;
    * very long texts: cut and hashed through descriptors, a task holds one slice of a few MB or one such text;
    * empty table: empty result; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            ids = b.column(0).to_pylist()
            got = [transform(t, i, seed, fim_percent, spm_percent) for i, t in zip(ids, _bytes(b.column(1)))]
            tables, n, forms, prefix, middle = zip(*got)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), _strings([bytes(t) for t in tables]),
                pa.array([t.sha256() for t in tables], pa.string())], schema=_OUT)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restore(rows: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """All columns of ``rows`` but the output, and (restored, restored_sha256): the texts, from output and form alone.

    The sentinels stand once each in a rearranged output, so they show where its parts begin. Null output: the
    empty text. Fails on a form that it doesn't know and on an output without its sentinels: it is not one of ours.
    """
    rest = [c for c in rows.columns if c not in (output_col, "restored", "restored_sha256")]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest]
                       + ["restored string", "restored_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__output"):
            forms = b.column(len(rest)).to_pylist()
            tables = [PieceTable(t).restore(f if len(t) else PLAIN) for f, t in zip(forms, _bytes(b.column(len(rest) + 1)))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(rest)], _strings([bytes(t) for t in tables]),
                 pa.array([t.sha256() for t in tables], pa.string())], names=[*rest, "restored", "restored_sha256"])

    return rows.select(*[F.col(f"`{c}`") for c in rest], F.col(form_col).alias("__form"),
                       F.col(output_col).alias("__output")).mapInArrow(run, schema)


#: The same in DuckDB, over ``documents``; what must come back is the text itself.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
             array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

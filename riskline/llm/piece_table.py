"""Fill-in-the-middle with piece tables.

A document is a list of descriptors (buffer, begin, end) over two immutable buffers: its text as UTF-8, and the
sentinels. Cutting splits descriptors, an arrangement permutes them, the inverse permutation restores the text; a
descriptor's bytes are copied only where a text is wanted, and hashes stream over the descriptors.

Units are words with the white space in front of them, and white space at the end of a text:
``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``. Their ends are found on a whole batch's bytes at once.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from riskline.llm.common import prepare, text_buffer, unused_name
from riskline.llm.words import NONSPACE, find_words

#: In front of the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 42
#: Per cent of the texts that are rearranged, and per cent of those whose suffix goes first.
RATE = 50
SUFFIX_FIRST = 80
PLAIN, PSM, SPM = "plain", "psm", "spm"
TEXT, MARKS = 0, 1


@dataclass(frozen=True)
class PieceTable:
    """Descriptors over a text and the sentinels; every operation gives a new table over the same buffers."""

    buffers: tuple[memoryview, memoryview]
    pieces: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, text: memoryview, marks: bytes) -> "PieceTable":
        return cls((text, memoryview(marks)), ((TEXT, 0, len(text)),))

    def cut(self, *places: int) -> "PieceTable":
        """The same bytes with a descriptor ending at each place (offsets into the table's bytes, ascending); a
        place at an end or named twice leaves an empty descriptor there, so n cuts always give n more."""
        out, at, left = [], 0, list(places)
        for buffer, begin, end in self.pieces:
            while left and left[0] <= at + end - begin:
                middle = begin + left.pop(0) - at
                out.append((buffer, begin, middle))
                at += middle - begin
                begin = middle
            out.append((buffer, begin, end))
            at += end - begin
        return PieceTable(self.buffers, tuple(out))

    def permute(self, order: tuple[int, ...]) -> "PieceTable":
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def with_marks(self, spans: tuple[tuple[int, int], ...]) -> "PieceTable":
        """A sentinel's span in front of every descriptor."""
        return PieceTable(self.buffers, tuple(p for (a, b), piece in zip(spans, self.pieces) for p in ((MARKS, a, b), piece)))

    def __iter__(self):
        for buffer, begin, end in self.pieces:
            yield self.buffers[buffer][begin:end]

    def text(self) -> bytes:
        return b"".join(self)

    def sha256(self) -> str:
        h = hashlib.sha256()
        for view in self:
            h.update(view)
        return h.hexdigest()


#: Where prefix, suffix and middle (0, 2, 1 in the text's order: prefix 0, middle 1, suffix 2) stand in each form.
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}


class Arranger:
    """Cuts and arranges texts; the same settings restore them."""

    def __init__(self, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                 sentinels: tuple[str, str, str] = SENTINELS):
        marks = [s.encode("utf-8") for s in sentinels]
        if any(not m or m in o for i, m in enumerate(marks) for j, o in enumerate(marks) if i != j) or any(
                m[k:] == o[:len(m) - k] for m in marks for o in marks for k in range(1, len(m))):
            raise ValueError("sentinels must not be empty, overlap or hold one another")
        self.seed, self.rate, self.suffix_first, self.marks = seed, rate, suffix_first, marks
        self.buffer = b"".join(marks)
        ends = np.cumsum([len(m) for m in marks]).tolist()
        prefix, suffix, middle = [(e - len(m), e) for m, e in zip(marks, ends)]
        of_part = (prefix, middle, suffix)  # by the part's place in the text
        self.spans = {form: tuple(of_part[i] for i in order) for form, order in ORDER.items()}

    def draws(self, id_: str | None) -> tuple[int, int, int, int]:
        """Four unsigned 32-bit numbers from the id; a null id counts as an empty one."""
        return struct.unpack(">4I", hashlib.sha256(f"{self.seed}:{id_ or ''}".encode()).digest()[:16])

    def arrange(self, id_: str | None, data: memoryview, ends: np.ndarray) -> tuple[str, tuple[int, int], PieceTable]:
        """Form, the two cuts in bytes and the arranged table; ``ends``: where the units of ``data`` end."""
        first, second, third, fourth = self.draws(id_)
        n = len(ends)
        low, high = sorted((first % (n + 1), second % (n + 1)))
        table = PieceTable.of(data, self.buffer)
        raw = bytes(data) if third % 100 < self.rate else b""
        if not raw or any(m in raw for m in self.marks):
            return PLAIN, (0, 0), table
        form = SPM if fourth % 100 < self.suffix_first else PSM
        cuts = tuple(int(ends[i - 1]) if i else 0 for i in (low, high))
        return form, cuts, table.cut(*cuts).permute(ORDER[form]).with_marks(self.spans[form])

    def restore(self, output: bytes, form: str) -> PieceTable:
        """The text's table over the bytes of ``output``: its parts between the sentinels, permuted back."""
        table = PieceTable.of(memoryview(output), self.buffer)
        if form == PLAIN:
            return table
        places, at = [], 0
        for a, b in self.spans[form]:
            begin = output.index(self.buffer[a:b], at)  # each stands once: texts that hold one are plain
            at = begin + b - a
            places += [begin, at]
        parts = table.cut(*places).permute((2, 4, 6))
        order = ORDER[form]
        return parts.permute(tuple(order.index(i) for i in range(3)))


def unit_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The texts' bytes, their offsets, and for each the ends of its units, from its own begin."""
    data, offsets = text_buffer(texts)
    _, ends, first = find_words(data, offsets, NONSPACE)
    out = []
    for begin, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
        mine = ends[a:b] - begin
        if end - begin > (int(mine[-1]) if len(mine) else 0):  # white space at the end
            mine = np.append(mine, end - begin)
        out.append(mine)
    return data, offsets, out


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


_FIELDS = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, {}>"


def arranged(id_: Column, text: Column, arranger: Arranger, digests: bool = False) -> Column:
    """A struct of ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain) and the ``output``;
    with ``digests`` its ``output_sha256`` and the ``restored_sha256`` of the text rebuilt from it instead."""
    last = "output_sha256: string, restored_sha256: string" if digests else "output: string"

    @arrow_udf(_FIELDS.format(last))
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        data, offsets, ends = unit_ends(texts)
        view = memoryview(data)
        rows: list[list] = [[] for _ in range(6 if digests else 5)]
        for i, id_ in enumerate(ids.to_pylist()):
            a, b = int(offsets[i]), int(offsets[i + 1])
            form, (p, q), table = arranger.arrange(id_, view[a:b], ends[i])
            plain = form == PLAIN
            row = [len(ends[i]), form, None if plain else _chars(data[a:a + p]), None if plain else _chars(data[a + p:a + q])]
            if digests:
                row += [table.sha256(), arranger.restore(table.text(), form).sha256()]
            else:
                row.append(table.text())
            for column, value in zip(rows, row):
                column.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string() if digests else pa.binary()] * (len(rows) - 4)
        arrays = [pa.array(column, kind) for column, kind in zip(rows, types)]
        if not digests:
            arrays[4] = arrays[4].cast(pa.string())
        names = ["n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digests else ["output"])]
        return pa.StructArray.from_arrays(arrays, names)

    return run(id_.cast("string"), text)


def fill_in_middle(docs: DataFrame, arranger: Arranger | None = None, id_col: str = "doc_id", text_col: str = "text",
                   digests: bool = False) -> DataFrame:
    """``docs`` with the columns of :func:`arranged`; existing columns of those names are replaced.

    One scan, no shuffle; the draws depend on id and seed alone, so rows with one id and one text are arranged
    alike however often they occur. A null text counts as an empty one, which stays plain with 0 units; so does
    a text that holds a sentinel, and a null id counts as an empty one. An empty table gives an empty one.
    A task holds one Arrow batch and one arranged text."""
    prepare(docs.sparkSession)
    names = ["n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digests else ["output"])]
    made = arranged(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), arranger or Arranger(), digests)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    held = unused_name(docs, "_fim")
    return docs.select(*kept, made.alias(held)).select(*kept, *[F.col(held).getField(c).alias(c) for c in names])


def restore(arranged_docs: DataFrame, arranger: Arranger | None = None, output_col: str = "output", form_col: str = "form",
            text_col: str = "restored") -> DataFrame:
    """The texts again, from ``output_col`` and ``form_col`` alone, in ``text_col`` (replaced if it exists).

    A null output gives null, a null form counts as plain; an output that lacks its form's sentinels is an error."""
    prepare(arranged_docs.sparkSession)
    with_ = arranger or Arranger()

    @arrow_udf("string")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([None if o is None else with_.restore(o.encode("utf-8"), f or PLAIN).text().decode("utf-8")
                         for o, f in zip(outputs.to_pylist(), forms.to_pylist())], pa.string())

    return arranged_docs.withColumn(text_col, run(F.col(f"`{output_col}`"), F.col(f"`{form_col}`")))

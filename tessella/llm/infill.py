"""Operator 12: fill-in-the-middle examples, made by DuckDB over the batches of mapInArrow.

Each task opens one in-memory database, registers every batch as a view and runs one statement
over it; no row is handled in Python. Texts are matched into runs of 64 code points, and only the
runs that a cut falls into are matched code point by code point, so that a list of runs takes
about as much memory as the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a run.
RUN = 64
#: Bytes that a task's database may take.
MEMORY = "1GB"


@dataclass(frozen=True)
class Form:
    """How examples are made: in percent, how many texts are rearranged, and how many of these put the suffix first."""

    seed: int = 1
    rearranged: int = 90
    suffix_first: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        if not all(self.marks) or any(a.find(b[0], 1) >= 0 for a in self.marks for b in self.marks) or len(set(self.marks)) < 3 or any(a != b and a in b for a in self.marks for b in self.marks):
            raise ValueError("marks differ, and no mark holds another one's first character but at its own start")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MACROS = f"""
CREATE MACRO points(run) AS regexp_extract_all(run, '(?s).');
CREATE MACRO number_of(hash, k) AS CAST('0x' || substr(hash, 8 * k - 7, 8) AS UBIGINT);
-- code points a to b (end exclusive) of a text in runs
CREATE MACRO stretch(runs, a, b) AS CASE
  WHEN a >= b THEN ''
  WHEN a // {RUN} = b // {RUN} THEN array_to_string(list_slice(points(runs[a // {RUN} + 1]), a % {RUN} + 1, b % {RUN}), '')
  ELSE concat(
    array_to_string(list_slice(points(runs[a // {RUN} + 1]), a % {RUN} + 1, {RUN}), ''),
    array_to_string(list_slice(runs, a // {RUN} + 2, b // {RUN}), ''),
    array_to_string(list_slice(points(runs[b // {RUN} + 1]), 1, b % {RUN}), '')) END;
"""


def _statement(form: Form) -> str:
    p, s, m = map(_quoted, form.marks)
    return f"""
WITH texts AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s).{{1,{RUN}}}') AS runs, sha256({_quoted(f"{form.seed}:")} || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM batch)),
counted AS (SELECT *, CAST(CASE WHEN len(runs) = 0 THEN 0 ELSE {RUN} * (len(runs) - 1) + len(points(runs[-1])) END AS BIGINT) AS n FROM texts),
cuts AS (SELECT *, CAST(number_of(hash, 1) % (n + 1) AS BIGINT) AS x, CAST(number_of(hash, 2) % (n + 1) AS BIGINT) AS y FROM counted),
forms AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE
    WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR number_of(hash, 3) % 100 >= {form.rearranged} THEN 'plain'
    WHEN number_of(hash, 4) % 100 < {form.suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form
    WHEN 'plain' THEN text
    WHEN 'psm' THEN concat({p}, stretch(runs, 0, a), {s}, stretch(runs, b, n), {m}, stretch(runs, a, b))
    ELSE concat({s}, stretch(runs, b, n), {p}, stretch(runs, 0, a), {m}, stretch(runs, a, b)) END AS output
FROM forms"""


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])
_TYPES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _rearranged(form: Form):
    statement = _statement(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # no spill folder: a text that does not fit fails and says so
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "arrow_large_buffer_size": True}) as base:
            base.execute(_MACROS)
            for batch in batches:
                base.register("batch", pa.Table.from_batches([batch]))
                for out in base.sql(statement).to_arrow_table().cast(_SCHEMA).to_batches():
                    yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) and c.nbytes < 2**31 else c for c in out.columns], names=_SCHEMA.names)
                base.unregister("batch")

    return run


def fill_in_middle(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, one row for each row of docs.

    A text of n code points is cut at two places that follow from its doc_id alone, and its
    parts are put in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each
    behind its mark. Form is plain, and the output the text, if the text is empty, holds a mark,
    or is among those that are left as they are. A null text is empty; a null doc_id is hashed as
    an empty string; rows that share a doc_id and a text come out alike. Very long texts are
    taken whole. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_rearranged(form), _TYPES)


def restored(output: Column, kind: Column, form: Form = Form()) -> Column:
    """The text that an output was made from: a mark's first place is where it was put, as the text holds none."""
    p, s, m = form.marks
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    behind = lambda text, mark: F.substring(text, F.lit(len(mark) + 1), F.char_length(text))
    psm = F.concat(behind(F.substring_index(head, s, 1), p), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, behind(F.substring_index(head, p, 1), s))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(output)

"""Fill-in-the-middle transformation (operator 13).

A text is cut into units (a run of ASCII letters, or any other single code
point).  Two hashed cut points part the units into prefix, middle and suffix,
which are written in the order prefix, suffix, middle (``psm``) or suffix,
prefix, middle (``spm``) behind the markers ``<P>``, ``<S>`` and ``<M>``.

The draws are Spark expressions; the cutting is a pyarrow.compute pipeline per
batch: split the units into list arrays, flatten them with their parent indices,
compute ordinals, filter by role, rebuild the lists, join the pieces.  Rows are
independent, so there is no shuffle.  Batches are worked on in slices of at most
``SLICE_BYTES`` of text (one text at least): memory is about 50 bytes a unit of a
slice.

Defined results: null text as empty; an empty text, a text that holds a marker
and the texts drawn to stay are ``plain``, the text itself, with null
prefix_chars and middle_chars.  A null id draws as an empty one.  Repeated rows
of one id draw alike.  Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<[PSM]>"
#: A unit as UTF-8 bytes: letters, another ASCII byte, or a longer sequence.
UNIT = rb"([A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*)"
#: A byte that no UTF-8 text holds.
BREAK = b"\xff"
SLICE_BYTES = 2 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four groups of eight digits of the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _rebuilt(flat: pa.Array, role: pa.Array, lengths: pa.Array) -> pa.Array:
    """The units of one role as one binary per text."""
    ends = pc.cumulative_sum(lengths)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(role)), pa.scalar(b"", pa.large_binary()))


def transform_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Columns doc_id, text, stays (plain whatever its draws), swap (spm), h1, h2 -> ``SCHEMA``."""
    text = batch["text"].cast(pa.large_string()).cast(pa.large_binary())
    # A break stands before every unit, so each list opens with an empty item.
    units = pc.split_pattern(pc.replace_substring_regex(text, UNIT, BREAK + b"\\1"), BREAK)
    n = pc.subtract(pc.list_value_length(units), 1).cast(pa.int64())
    cuts = [_modulo(batch[h], pc.add(n, 1)) for h in ("h1", "h2")]
    a, b = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)

    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    starts = units.offsets.cast(pa.int64())
    starts = pc.subtract(starts, starts[0])
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), starts.take(parent))
    first, second = a.take(parent), b.take(parent)
    in_prefix, in_suffix = pc.less_equal(ordinal, first), pc.greater(ordinal, second)
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    prefix = _rebuilt(flat, in_prefix, pc.add(a, 1))
    middle = _rebuilt(flat, in_middle, pc.subtract(b, a))
    suffix = _rebuilt(flat, in_suffix, pc.subtract(n, b))

    p, s, m, glue = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, glue)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, glue)
    plain = pc.or_(batch["stays"], pc.equal(n, 0))
    chars = [pc.if_else(plain, None, pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    output = pc.if_else(plain, text, pc.if_else(batch["swap"], spm, psm))
    form = pc.if_else(plain, "plain", pc.if_else(batch["swap"], "spm", "psm"))
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], n, form, *chars, output.cast(pa.large_string()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``SLICE_BYTES`` of text, or of one row."""
    size, start, held = pc.binary_length(batch["text"]).to_pylist(), 0, 0
    for i, x in enumerate(size):
        if i > start and held + x > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += x
    if batch.num_rows > start:
        yield batch.slice(start)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            yield transform_batch(part)


def fill_in_middle(
    docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output.  Of a hundred texts
    those drawn at ``plain_from`` or above stay; of the rest those below ``spm_below``
    open with their suffix."""
    limit_arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(marker)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        (marked | (h3 % 100 >= plain_from)).alias("stays"),
        (h4 % 100 < spm_below).alias("swap"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    return rows.mapInArrow(_transform, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The exact text again.  No text of the forms psm and spm holds a marker, and
    a marker can't arise across a joint: none begins with the end of another."""
    piece = F.split(output, MARKERS, -1)
    return (
        F.when(form == "psm", F.concat(piece[1], piece[3], piece[2]))
        .when(form == "spm", F.concat(piece[2], piece[3], piece[1]))
        .otherwise(output)
    )

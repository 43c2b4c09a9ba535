"""Arrays of structs to and from Arrow, column by column, a bounded piece of a batch at a time.

``pa.array`` on nested dicts takes about as long as rendering a mutant does.
"""

from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc

# Characters of results that a worker makes before it sends them, and those that an object counts for.
PIECE = 4 << 20
OBJECT = 512


def text_costs(texts):
    """Characters each text counts for, as int64."""
    return pc.add(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), OBJECT)


def pieces(costs, limit=PIECE):
    """(offset, length) of consecutive rows that cost at most ``limit`` together; a row that costs more is alone.

    A batch has thousands of rows and results are many times larger than rows,
    so a worker that held those of a batch would grow with the batch.
    """
    first, total = 0, 0
    for at, cost in enumerate(costs):
        if at > first and total + cost > limit:
            yield first, at - first
            first, total = at, 0
        total += cost
    if first < len(costs):
        yield first, len(costs) - first


def to_arrow(groups, kind):
    """``groups``, lists of dicts or None, as an array of type ``kind``, a list of structs."""
    rows = [row for group in groups for row in group or ()]
    fields = list(kind.value_type)
    columns = [pa.array([row[f.name] for row in rows], f.type) for f in fields]
    offsets, end = [], 0
    for group in groups:
        offsets.append(None if group is None else end)
        end += len(group or ())
    values = pa.StructArray.from_arrays(columns, fields=fields)
    return pa.ListArray.from_arrays(pa.array([*offsets, end], pa.int32()), values)


def from_arrow(array):
    """Lists of dicts; a null list comes back empty."""
    flat = array.flatten()
    names = [f.name for f in flat.type]
    columns = [flat.field(name).to_pylist() for name in names]
    rows = (dict(zip(names, values)) for values in zip(*columns))
    return [list(islice(rows, n or 0)) for n in array.value_lengths().to_pylist()]

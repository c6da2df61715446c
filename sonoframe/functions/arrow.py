"""Between Arrow and numpy. Arrow UDFs keep NaN (undefined) apart from null (not computed), which pandas would merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def signals(arr) -> Iterator:
    """Each element of an array of channels as an array (channels, samples); None for a null one and for one without
    channels. Samples are not copied through Python objects; a null sample is NaN."""
    import numpy as np

    offsets, inner = arr.offsets.to_numpy(), arr.values
    starts, flat = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
    null = arr.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(arr)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if null[i] or a == b:
            yield None
            continue
        sizes = np.diff(starts[a : b + 1])
        if (sizes != sizes[0]).any():
            raise ValueError("channels of a clip differ in length")
        yield flat[starts[a] : starts[b]].reshape(b - a, int(sizes[0])).astype("float64", copy=False)


def arrow_column(f: Callable, schema: str, *inputs: Column) -> Column:
    """``f`` (Arrow arrays -> Arrow array) as a column."""
    import pyarrow as pa

    names = f.__code__.co_varnames[: f.__code__.co_argcount]
    f.__annotations__ = {n: pa.Array for n in names} | {"return": pa.Array}
    return F.arrow_udf(f, schema)(*inputs)


def doubles(rows: list[list], names: list[str]):
    """A struct array of double columns; None is null, NaN stays."""
    import pyarrow as pa

    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))], names=names)

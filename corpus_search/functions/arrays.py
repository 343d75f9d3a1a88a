"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`. A plain reference inside an array
    function would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_lengths(values: Column) -> Column:
    """Distinct values of an array with their counts, as array<struct<value, count>>.

    Counting inside the row keeps a per-row histogram free of shuffles. Null for an empty array.
    """

    def counted(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda at: (at == 0) | (F.get(ordered, at) != F.get(ordered, at - 1)),
        )
        return bind(
            starts,
            lambda first: F.zip_with(
                first,
                F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(ordered))),
                lambda start, end: F.struct(
                    F.get(ordered, start).alias("value"), (end - start).alias("count")
                ),
            ),
        )

    # The check for an empty array is inside, or the array would be computed twice.
    return bind(F.sort_array(values), lambda s: F.when(F.size(s) > 0, counted(s)))


def word_counts(words: Column) -> Column:
    """`run_lengths` of an array of strings in no order, counted for a whole batch of rows at a time.
    Empty for an empty array."""

    @F.arrow_udf("array<struct<value:string,count:int>>")
    def counted(lists: pa.Array) -> pa.Array:
        n_rows = len(lists)
        coded = lists.flatten().dictionary_encode()
        n_codes = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(n_rows), pc.list_value_length(lists).fill_null(0).to_numpy())
        cell, count = np.unique(row * n_codes + coded.indices.to_numpy(), return_counts=True)
        ends = np.cumsum(np.bincount(cell // n_codes, minlength=n_rows))
        found = pa.StructArray.from_arrays(
            [coded.dictionary.take(pa.array(cell % n_codes)), pa.array(count.astype(np.int32))],
            ["value", "count"],
        )
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), found)

    return counted(words)

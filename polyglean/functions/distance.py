"""Edit distance with its matrix and one best edit path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def matrix(a: Column, b: Column) -> Column:
    """All rows of the distance matrix, natively: each row is folded from the one before."""
    n = F.length(b)
    first = F.sequence(F.lit(0), n)

    def row(rows: Column, i: Column) -> Column:
        above = F.element_at(rows, -1)

        def cell(acc: Column, j: Column) -> Column:
            left = F.element_at(acc, -1)
            change = (F.substr(a, i, F.lit(1)) != F.substr(b, j, F.lit(1))).cast("int")
            return F.concat(acc, F.array(F.least(left + 1, F.element_at(above, j + 1) + 1, F.element_at(above, j) + change)))

        cols = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.concat(rows, F.array(F.aggregate(cols, F.array(i), cell)))

    lines = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(lines, F.array(first), row)


EDIT_SCHEMA = "word1 STRING, word2 STRING, distance INT, step INT, op STRING, cost INT, char1 STRING, char2 STRING, from_i INT, from_j INT, to_i INT, to_j INT"


def edit_paths(pairs: DataFrame) -> DataFrame:
    """One row per edit operation of each (word1, word2), first to last: match or substitute before delete before insert.

    Walking back through the matrix is sequential, so it runs in Arrow batches. Pairs with a NULL are left out, pairs
    of empty words have no operation.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b in zip(pdf["word1"], pdf["word2"]):
                cost = [list(range(len(b) + 1))]
                for i, x in enumerate(a, 1):
                    line = [i]
                    for j, y in enumerate(b, 1):
                        line.append(min(line[-1] + 1, cost[-1][j] + 1, cost[-1][j - 1] + (x != y)))
                    cost.append(line)
                at, back = (len(a), len(b)), []
                while at != (0, 0):
                    i, j = at
                    here = cost[i][j]
                    if i and j and here == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                        same = a[i - 1] == b[j - 1]
                        step = ("match" if same else "substitute", int(not same), a[i - 1], b[j - 1], i - 1, j - 1)
                    elif i and here == cost[i - 1][j] + 1:
                        step = ("delete", 1, a[i - 1], None, i - 1, j)
                    else:
                        step = ("insert", 1, None, b[j - 1], i, j - 1)
                    back.append((*step, i, j))
                    at = step[4], step[5]
                out += [(a, b, cost[-1][-1], n, *s) for n, s in enumerate(reversed(back), 1)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDIT_SCHEMA.split(", ")])

    return pairs.select("word1", "word2").where("word1 IS NOT NULL AND word2 IS NOT NULL").mapInPandas(run, EDIT_SCHEMA)

"""Writers of the report formats. Rows come to the driver one at a time, in order; large tables are written by Spark instead."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def csv_text(df: DataFrame, path: str, newline_at_end: bool = False) -> None:
    """Header and rows, comma-separated, with or without a line end after the last."""
    with open(path, "w") as out:
        out.write(",".join(df.columns))
        for row in df.toLocalIterator():
            out.write("\n" + ",".join("" if x is None else str(x) for x in row))
        out.write("\n" * newline_at_end)


def csv_files(df: DataFrame, path: str) -> None:
    """Header and rows by Spark's own writer, as many files as partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def preprocessed_csv(baskets: DataFrame, path: str) -> None:
    """Baskets of readers.retail_baskets() as DATE-CUSTOMER_ID,PRODUCT_ID, by Spark's own writer."""
    csv_files(baskets.select(baskets.basket.alias("DATE-CUSTOMER_ID"), baskets.item.alias("PRODUCT_ID")), path)


def print_table(df: DataFrame, rows: int = 10) -> None:
    """Header and the first rows on standard output, comma-separated."""
    print(",".join(df.columns))
    for row in df.limit(rows).collect():  # as many as asked for
        print(",".join("" if x is None else str(x) for x in row))


def timed(task: Callable, *args):
    """What a task returns; its whole seconds go to standard output."""
    began = time.perf_counter()
    out = task(*args)
    print(f"Duration: {int(time.perf_counter() - began)}")
    return out


def json_report(values: dict, path: str) -> None:
    """One object of scalars, pairs and nested objects."""
    with open(path, "w") as out:
        json.dump(values, out)


def itemset_text(sets: Iterable[tuple]) -> str:
    """Item sets by size, each size on a line, members quoted; sizes apart by an empty line."""
    by_size: dict[int, list[tuple]] = {}
    for s in sets:
        by_size.setdefault(len(s), []).append(tuple(sorted(map(str, s))))
    return "\n\n".join(",".join("(" + ", ".join(f"'{x}'" for x in s) + ")" for s in sorted(by_size[n])) for n in sorted(by_size))


def itemset_report(candidates: Iterable[tuple], frequent: Iterable[tuple], path: str) -> None:
    with open(path, "w") as out:
        out.write(f"Candidates:\n{itemset_text(candidates)}\n\nFrequent Itemsets:\n{itemset_text(frequent)}")


def community_lines(communities: Iterable[Iterable], path: str) -> None:
    """A community on each line, members quoted and sorted; by size, then first member."""
    rows = sorted((sorted(map(str, c)) for c in communities), key=lambda c: (len(c), c[:1]))
    with open(path, "w") as out:
        out.writelines(", ".join(f"'{x}'" for x in c) + "\n" for c in rows)


def betweenness_lines(edges: DataFrame, path: str) -> None:
    """('a', 'b'),x on each line; highest first, then by members. edges: (src, dst, betweenness)."""
    with open(path, "w") as out:
        for r in edges.orderBy(edges.betweenness.desc(), "src", "dst").toLocalIterator():
            out.write(f"('{r.src}', '{r.dst}'),{r.betweenness}\n")


def cluster_report(rounds: list[list[int]], assigned: DataFrame, path: str) -> None:
    """Counts of each round, then id,cluster of every point. assigned: (id, cluster)."""
    with open(path, "w") as out:
        out.write("The intermediate results:\n")
        out.writelines(f"Round {k}: {','.join(map(str, r))}\n" for k, r in enumerate(rounds, 1))
        out.write("\nThe clustering results:\n")
        for r in assigned.orderBy("id").toLocalIterator():
            out.write(f"{r.id},{r.cluster}\n")

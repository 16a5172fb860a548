"""Hilbert-curve order of documents by several metadata dimensions, cut into equal runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import cut, fresh, shared_dir

#: A piece of a curve cell, which one task sorts, has about so many rows.
PIECE_ROWS = 10_000


def is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date") or kind.startswith(("decimal", "timestamp"))


def order_code(col: Column, kind: str) -> Column:
    """A double that follows the order of a number, date or time."""
    return F.unix_micros(col.cast("timestamp")).cast("double") if kind.startswith("timestamp") or kind == "date" else col.cast("double")


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The position on the Hilbert curve of a point with `bits` bits in each dimension (Skilling's transform)."""
    n = len(cells)
    point = F.array(*[c.cast("bigint") for c in cells])
    levels = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>")
    dims = F.array(*[F.lit(i) for i in range(n)])

    def bit(x: Column, q: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, q).bitwiseAND(F.lit(1).cast("bigint"))

    def undo(x: Column, level: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1

        def step(a: Column, i: Column) -> Column:
            first, own = F.get(a, F.lit(0)), F.get(a, i)
            t = first.bitwiseXOR(own).bitwiseAND(low)
            flipped = F.transform(a, lambda v, j: F.when(j == 0, first.bitwiseXOR(low)).otherwise(v))
            swapped = F.transform(a, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(t)).otherwise(v))
            return F.when(bit(own, level) == 1, flipped).otherwise(swapped)

        return F.aggregate(dims, x, step)

    x = F.aggregate(levels, point, undo)
    gray = F.transform(x, lambda _, i: F.aggregate(F.slice(x, 1, i + 1), F.lit(0).cast("bigint"), lambda a, v: a.bitwiseXOR(v)))
    last = F.get(gray, F.lit(n - 1))
    turn = F.aggregate(levels, F.lit(0).cast("bigint"), lambda t, q: F.when(bit(last, q) == 1, t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), q) - 1)).otherwise(t))
    out = F.lit(0).cast("bigint")
    every = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    # x and turn are read many times, so they are named once through one-element arrays
    return F.get(
        F.transform(F.array(F.struct(gray.alias("g"), turn.alias("t"))), lambda s: F.aggregate(every, out, lambda h, q: F.aggregate(s["g"], h, lambda a, v: F.call_function("shiftleft", a, F.lit(1)) + bit(v.bitwiseXOR(s["t"]), q)))),
        F.lit(0),
    )


def number_cells(docs: DataFrame, dims: list[str], bits: int) -> dict[str, Column]:
    """For each dimension of numbers the cell of a row, by cut points that deal the rows over 2^bits cells as evenly as
    ties allow."""
    if not dims:
        return {}
    kinds, shares = dict(docs.dtypes), [i / 2**bits for i in range(1, 2**bits)]
    row = docs.agg(*[F.percentile_approx(order_code(docs[d], kinds[d]), shares, 10_000).alias(f"q{i}") for i, d in enumerate(dims)]).first()
    out = {}
    for i, d in enumerate(dims):
        cell = F.lit(0)
        for c in sorted(set(row[f"q{i}"] or [])):
            cell = cell + (order_code(docs[d], kinds[d]) > F.lit(float(c))).cast("int")
        out[d] = F.coalesce(cell, F.lit(0))
    return out


def text_cells(docs: DataFrame, dim: str, bits: int) -> DataFrame:
    """value, cell: each different value of a dimension of texts, whole, with its cell: equal shares of the rows along the
    values' order. A value's share starts where those before it end, so that equal values have one cell.

    The running count goes over a row for each value: by ranges, whose totals (a row each) are added up first, so that no
    task has all values."""
    counts = cut(docs.groupBy(F.col(dim).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null"))
    ranged = cut(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("all"))  # a row for each partition
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = totals.agg(F.sum("all").alias("rows"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(ahead), "part").join(F.broadcast(whole))
    return placed.select("value", F.floor((F.col("ahead") + F.col("inside")) * 2**bits / F.col("rows")).cast("int").alias("cell"))


#: Cells of texts are broadcast up to so many values; beyond, they are joined over SALTS, as one value may be hot.
BROADCAST_VALUES, SALTS = 100_000, 64


def with_text_cell(docs: DataFrame, dim: str, bits: int, name: str) -> DataFrame:
    cells = cut(text_cells(docs, dim, bits))
    value, salt, at = fresh(docs, "_value", "_salt", "_at")
    found = cells.select(F.col("value").alias(value), F.col("cell").alias(name))
    if cells.count() <= BROADCAST_VALUES:
        joined = docs.join(F.broadcast(found), docs[dim].cast("string") == F.col(value), "left").drop(value)
    else:
        dealt = docs.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(SALTS)).cast("int"))
        copies = found.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(copies, (F.col(dim).cast("string") == F.col(value)) & (F.col(salt) == F.col(at)), "left").drop(value, salt, at)
    return joined.withColumn(name, F.coalesce(name, F.lit(0)))


def curve(df: DataFrame, cells: list[str], bits: int) -> DataFrame:
    """cells and hilbert: the curve's index of each cell there is. At most 2^(bits * dims) rows: the index is worked out for
    cells, not for rows."""
    return df.select(*cells).distinct().select(*cells, hilbert_index([F.col(c) for c in cells], bits).alias("hilbert"))


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 8, bits: int = 4) -> DataFrame:
    """Order docs along a Hilbert curve over dims and cut the order into shards whose row counts differ by one at most.

    Each dimension is quantised to 2^bits cells by its own quantiles (texts by the running count of their whole values), so
    a file of a shard has narrow minima and maxima in all of them. The rank in the order is exact and needs no global sort:
    rows are counted by curve cell and by a hash of the whole row within it, those counts are summed along the curve, and
    only the rows of one such piece are sorted together. The number of pieces grows with the rows, so a cell that holds a
    third of them is as many tasks as it needs; rows of one doc_id, or of none, are dealt over pieces by their other columns.

    Adds hilbert, position (0 to rows - 1), shard and slot (gapless from 0). Null in a dimension: cell 0. Null doc_id:
    first in its piece. Ties (repeated rows): any order among equals; rows equal in all columns are one piece. Null, empty
    and very long texts: as any. Empty table: no rows. Columns of docs that have the added names are replaced; no other
    name clashes.
    """
    shared_dir(docs.sparkSession)
    named = docs.drop("hilbert", "position", "shard", "slot")
    columns, kinds = named.columns, dict(named.dtypes)
    names = fresh(named, *[f"_cell{i}" for i in range(len(dims))])
    numbers = number_cells(named, [d for d in dims if is_number(kinds[d])], bits)
    named = named.withColumns({n: numbers[d] for n, d in zip(names, dims, strict=True) if d in numbers})
    for n, d in zip(names, dims, strict=True):
        if d not in numbers:
            named = with_text_cell(named, d, bits, n)
    piece, n, before, rank, parts = fresh(named, "_piece", "_n", "_before", "_rank", "_parts")
    counts = cut(named.groupBy(*names).agg(F.count(F.lit(1)).alias(n)))  # a row for each cell: 2^(bits * dims) at most
    total = counts.agg(F.sum(n)).first()[0] or 0
    starts = F.coalesce(F.sum(n).over(Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cut(counts.join(F.broadcast(curve(counts, names, bits)), names).withColumn(parts, F.ceil(F.col(n) / F.lit(PIECE_ROWS)).cast("int")).withColumn(before, starts).drop(n))
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.col(parts))
    dealt = named.join(F.broadcast(cells.drop(before)), names).withColumn(piece, hashed).drop(parts, *names)
    # a row for each piece, summed up within its cell; cells' own starts are known
    along = F.coalesce(F.sum(n).over(Window.partitionBy("hilbert").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = dealt.groupBy("hilbert", piece).agg(F.count(F.lit(1)).alias(n)).withColumn(n, along)
    ahead = pieces.join(F.broadcast(cells.select("hilbert", before)), "hilbert").select("hilbert", piece, (F.col(n) + F.col(before)).alias(before))
    order = [F.col("doc_id")] if "doc_id" in columns else []
    inside = Window.partitionBy("hilbert", piece).orderBy(*order, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    ranked = dealt.withColumn(rank, F.row_number().over(inside) - 1).join(ahead, ["hilbert", piece])
    placed = ranked.withColumn("position", F.col(before) + F.col(rank)).drop(piece, before, rank)
    # integer arithmetic: the shard of position p is the largest s with ceil(s * n / shards) <= p
    placed = placed.withColumn("shard", F.expr(f"cast((position * {shards}) div {max(1, total)} as int)"))
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("position") - start).select(*[F.col(f"`{c}`") for c in columns], "hilbert", "position", "shard", "slot")

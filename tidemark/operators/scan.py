"""Linear recurrences y[t] = a[t] * y[t-1] + b[t] by a scan over blocks, without Python.

Affine maps compose, so the rows of a symbol are cut into blocks, each block's prefix maps are folded by
itself, the blocks' last maps are chained in two steps, of which each sees few rows, and each row's value
is its block's prefix map at the value that enters the block. The work grows with the number of rows;
all of it, like every window by symbol, needs one shuffle by symbol and none of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import by_time, keys

#: Rows that a block has on average, blocks that are chained at once, and rows that a fold's list grows to.
BLOCK, FAN, CHUNK = 256, 256, 16


class _Maps:
    """SQL for the maps of several recurrences at once: text, as a plan of it is built much faster than of Columns."""

    def __init__(self, n: int):
        self.names = [f"m{i}" for i in range(n)]
        self.type = "struct<" + ",".join(f"{m}:struct<a:double,b:double,f:double>" for m in self.names) + ">"

    def compose(self, p: str, e: str) -> str:
        """The maps e of one stretch of rows after the maps p of another (null: none). f: the value if nothing came before."""
        one = [f"'{m}', named_struct('a', {e}.{m}.a * {p}.{m}.a, 'b', {e}.{m}.a * {p}.{m}.b + {e}.{m}.b, 'f', if({p}.{m}.f is null, {e}.{m}.f, {e}.{m}.a * {p}.{m}.f + {e}.{m}.b))" for m in self.names]
        return f"if({p} is null, {e}, named_struct({', '.join(one)}))"

    def prefixes(self, maps: str) -> str:
        """Each element after all before it; for short lists only, as the list is copied as it grows."""
        return f"aggregate({maps}, cast(array() as array<{self.type}>), (acc, e) -> concat(acc, transform(array(try_element_at(acc, -1)), p -> {self.compose('p', 'e')})))"

    def scanned(self, df: DataFrame, maps: str, out: str) -> DataFrame:
        """Adds prefixes of a long list: of chunks, then of the chunks' ends."""
        chunks = f"transform(sequence(0, cast(ceil(size({maps}) / {CHUNK}) as int) - 1), c -> {self.prefixes(f'slice({maps}, c * {CHUNK} + 1, {CHUNK})')})"
        df = df.withColumn("_c", F.expr(chunks)).withColumn("_d", F.expr(self.prefixes("transform(_c, c -> element_at(c, -1))")))
        before = f"concat(array(cast(null as {self.type})), slice(_d, 1, size(_d) - 1))"
        return df.withColumn(out, F.expr(f"flatten(zip_with(_c, {before}, (c, p) -> transform(c, e -> {self.compose('p', 'e')})))")).drop("_c", "_d")

    def value(self, m: str, e: str, y: str) -> str:
        return f"if({y} is null, {e}.{m}.f, {e}.{m}.a * {y} + {e}.{m}.b)"


def affine_scan(df: DataFrame, maps: dict[str, tuple[Column, ...]], block: int = BLOCK) -> DataFrame:
    """Adds a column y for each name in maps: (a, b) or (a, b, f).

    y is null before the first row with a value, where it is f (b if not given), and a[t] * y[t-1] + b[t]
    after that. Null b stands for a row without a value: y is carried over it. a, b and f may use windows.
    """
    sql, key = _Maps(len(maps)), keys()
    by = ", ".join(key)
    parts = [F.struct(F.when(b.isNull(), F.lit(1.0)).otherwise(a).cast("double").alias("a"), F.coalesce(b.cast("double"), F.lit(0.0)).alias("b"), F.when(b.isNotNull(), (f[0] if f else b).cast("double")).alias("f")).alias(n) for n, (a, b, *f) in zip(sql.names, maps.values(), strict=True)]
    given = df.select(*key, (F.row_number().over(by_time()) - 1).alias("_n"), F.struct(*parts).alias("_m"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    blocks = given.groupBy(*key, F.expr(f"_n div {block}").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("_n", "_m", "_row"))).alias("_x"))
    blocks = sql.scanned(blocks, "_x._m", "_p")
    # the ends of the blocks before in a group of FAN blocks, and those of the groups before
    blocks = blocks.selectExpr("*", "element_at(_p, -1) as _e", f"_k div {FAN} as _g")
    blocks = blocks.selectExpr("*", f"collect_list(_e) over (partition by {by}, _g order by _k rows between unbounded preceding and 1 preceding) as _b")
    blocks = blocks.selectExpr("*", f"if(_k % {FAN} = {FAN - 1}, aggregate(concat(_b, array(_e)), cast(null as {sql.type}), (p, e) -> {sql.compose('p', 'e')}), null) as _w")
    blocks = blocks.selectExpr("*", f"collect_list(_w) over (partition by {by} order by _k rows between unbounded preceding and 1 preceding) as _h")
    carry = [f"aggregate(concat(_h, _b), cast(null as double), (y, e) -> {sql.value(m, 'e', 'y')}) as {m}" for m in sql.names]
    rows = blocks.selectExpr("_x", "_p", *carry)
    values = ", ".join(f"'{m}', {sql.value(m, 'p', m)}" for m in sql.names)
    rows = rows.select(F.expr(f"explode(zip_with(_x, _p, (x, p) -> named_struct('row', x._row, {values})))").alias("_r"))
    return rows.select("_r.row.*", *[F.col(f"_r.{m}").alias(name) for m, name in zip(sql.names, maps, strict=True)])


def ewm(df: DataFrame, averages: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """Adds exponentially weighted means: name -> (values, alpha), the first value being the start.

    Null before the first value; a null later keeps the mean.
    """
    maps = {}
    for name, (x, alpha) in averages.items():
        c = (F.col(x) if isinstance(x, str) else x).cast("double")
        maps[name] = (F.lit(1.0 - alpha), c * alpha, c)
    return affine_scan(df, maps)


def span(n: int) -> float:
    return 2.0 / (n + 1)


#: A step of an operator: the frame it has come to and the means it wants on it.
Steps = Iterator[tuple[DataFrame, dict[str, tuple[str | Column, float]]]]
_numbers = count()


def fresh(name: str) -> str:
    """A column name that no other step has."""
    return f"_{name}_{next(_numbers)}"


def recurrent(steps: Callable[..., Steps]) -> Callable[..., DataFrame]:
    """An operator written as a generator that yields (frame, means) where it needs exponential means, gets
    the frame with them and returns the last frame. It runs alone or, through together(), with others."""

    @wraps(steps)
    def alone(df: DataFrame, *args, **kwargs) -> DataFrame:
        return together(df, [lambda d: steps(d, *args, **kwargs)])

    alone.steps = steps
    return alone


def together(df: DataFrame, operators: list[Callable[[DataFrame], Steps]]) -> DataFrame:
    """Run operators on one frame, the means that they want at the same step in one scan."""
    waiting: list[Steps] = []
    wanted: dict = {}
    for op in operators:
        g = op(df)
        df, more = next(g)
        wanted |= more
        waiting.append(g)
    while waiting:
        df = ewm(df, wanted) if wanted else df
        wanted, still = {}, []
        for g in waiting:
            try:
                df, more = g.send(df)
            except StopIteration as done:
                df = done.value
            else:
                wanted |= more
                still.append(g)
        waiting = still
    return df

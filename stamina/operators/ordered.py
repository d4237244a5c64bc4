"""Ordered per-key computation that stays parallel and exact when one key is huge.

A plain ``Window.partitionBy(run).orderBy(t)`` sends each run to one task. Here the rows of
a key with more than ``limit`` rows are range-partitioned by (key, order), which cuts them by
row count whatever the type, spread or ties of the order columns; every window then runs per
(key, segment), and what a segment needs to know about the segments before it arrives through
a carry table. Keys within the limit go through the plain window. The limit is the same at
every data size, and the same path runs on small tables and large ones.

Finding the hot keys is one count over the key columns, and it is done once for each table of keys: what a chain of operators adds to
the rows doesn't change their keys, Spark prunes it from a plan of the keys alone, and a plan that gives the same rows as one counted
before takes that answer (``find_hot``). ``within`` says that rows are some of those of an operator before, under the same or finer
keys, so that no count is needed where that one found none. The hot rows are written once to the
checkpoint folder with their segment, since a range partitioning may come out differently when it
is computed again; so are the carry tables. Nothing is collected. Tables about hot keys are
broadcast up to ``MAX_BROADCAST_ROWS`` counted rows and joined by a shuffle beyond.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stamina.session import cut_lineage, rows_per_segment

SEG = "__seg"
MAX_BROADCAST_ROWS = 100_000


def hinted(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


_counted: OrderedDict = OrderedDict()
REMEMBERED = 512
#: Steps of a plan that add no rows to a key.
NO_MORE_ROWS = {"Filter", "Window", "Sort", "Project"}


def _plans(df: DataFrame, keys: list[str]):
    """The optimised plan of the keys, and the same without the steps that only drop rows or add columns."""
    plan = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])._jdf.queryExecution().optimizedPlan()
    yield plan
    child = plan
    while child.children().size() == 1 and (child := child.children().head()).nodeName() in NO_MORE_ROWS and child.children().size() == 1 and \
            plan.references().subsetOf(child.children().head().outputSet()):
        plan = plan.withNewChildren(child.children())
        child = plan
        yield plan


def _recall(plan, n_keys: int, per: int, app: str):
    """(known, hot) of a plan that gives the same rows as ``plan``."""
    at = (app, plan.semanticHash(), n_keys, per)
    for known, hot in _counted.get(at, []):
        if known.sameResult(plan):
            _counted.move_to_end(at)
            return True, hot
    return False, None


def find_hot(df: DataFrame, keys: list[str], per_segment: int | None = None) -> DataFrame | None:
    """(keys, __n): keys with more rows than one task should take, or None.

    Answers are kept by the optimised plan of the keys and compared by Spark's own test of equal results; where no key is hot, none is among
    fewer rows or under finer keys. An answer about a table that was replaced meanwhile may be out of date; then a key is cut where it
    need not be, or not where it might, and results are the same.
    """
    spark = df.sparkSession
    per, app = per_segment or rows_per_segment(spark), spark.sparkContext.applicationId
    own = None
    for some in range(len(keys), 0, -1):
        for plan in _plans(df, keys[:some]):
            own = own or plan
            known, hot = _recall(plan, some, per, app)
            if known and hot is None:
                return None
            if known and plan is own:
                return hot.toDF(*keys, "__n")
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > per)
    hot = None if hot.isEmpty() else cut_lineage(hot)
    _counted.setdefault((app, own.semanticHash(), len(keys), per), []).append((own, hot))
    if len(_counted) > REMEMBERED:
        _counted.popitem(last=False)
    return hot


def join_keyed(df: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, null keys included; columns of ``table`` other than the keys are added."""
    renamed = table.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [df[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    out = df.join(renamed, on, how)
    return out.drop(*[f"__k_{k}" for k in keys])


class Ordered:
    """Rows of ``df`` ordered by ``order`` within ``keys``; methods append columns.

    ``order`` must identify rows uniquely within a key. ``prefix sum``, ``last``, ``lag``,
    ``lead``, ``since`` and ``total`` equal the plain window functions over the whole key.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 per_segment: int | None = None, within: Ordered | None = None):
        self.keys, self.order = list(keys), list(order)
        self.per_segment = per_segment
        self.cold, self.warm = df, None
        if within is not None and within.warm is None and set(within.keys) <= set(self.keys):
            return
        hot = find_hot(df, self.keys, per_segment)
        if hot is None:
            return
        per = per_segment or rows_per_segment(df.sparkSession)
        parts = -(-2 * hot.agg(F.sum("__n")).first()[0] // per)
        names = hinted(hot.select(*self.keys))
        self.cold = join_keyed(df, names, self.keys, "left_anti")
        rows = join_keyed(df, names, self.keys, "left_semi")
        self.warm = cut_lineage(rows.repartitionByRange(parts, *self.keys, *self.order).withColumn(SEG, F.spark_partition_id()))

    # -- building blocks -------------------------------------------------
    def _window(self, warm: bool):
        return Window.partitionBy(*self.keys, *([SEG] if warm else [])).orderBy(*self.order)

    def _rank(self) -> Column:
        return F.struct(*self.order)

    def _carry(self, summary: dict[str, Column], scan: Callable) -> None:
        """Join per-segment values computed from the segments of the same hot key."""
        if self.warm is None:
            return
        table = self.warm.groupBy(*self.keys, SEG).agg(
            *[v.alias(k) for k, v in summary.items()])
        along = Window.partitionBy(*self.keys).orderBy(SEG)
        for name, col in scan(along).items():
            table = table.withColumn(name, col)
        keep = [c for c in table.columns if c.startswith("__c_")]
        # written once, so that chained operators stay a chain and do not nest their branches
        carry = cut_lineage(table.select(*self.keys, SEG, *keep))
        self.warm = join_keyed(self.warm, hinted(carry), [*self.keys, SEG], "left")

    def _finish(self, make: Callable) -> "Ordered":
        """``make(warm)`` gives the columns to add to the cold rows and to the hot ones."""
        self.cold = self.cold.withColumns(make(False))
        if self.warm is not None:
            warm = self.warm.withColumns(make(True))
            self.warm = warm.drop(*[c for c in warm.columns if c.startswith("__c_")])
        return self

    # -- row-level derivations ------------------------------------------
    def with_columns(self, **cols: Column) -> "Ordered":
        return self._finish(lambda warm: cols)

    def drop(self, *names: str) -> "Ordered":
        self.cold = self.cold.drop(*names)
        self.warm = None if self.warm is None else self.warm.drop(*names)
        return self

    def running_sum(self, **cols: Column) -> "Ordered":
        """Inclusive running sums; nulls add nothing."""
        self._carry({f"__s_{k}": F.sum(v) for k, v in cols.items()},
                    lambda w: {f"__c_{k}": F.sum(f"__s_{k}").over(
                        w.rowsBetween(Window.unboundedPreceding, -1)) for k in cols})

        def make(warm: bool) -> dict[str, Column]:
            run = self._window(warm).rowsBetween(Window.unboundedPreceding, 0)
            out = {}
            for k, v in cols.items():
                local = F.sum(v).over(run)
                carry = F.col(f"__c_{k}") if warm else None
                out[k] = F.coalesce(local + carry, local, carry, F.lit(0)) if warm else F.coalesce(local, F.lit(0))
            return out
        return self._finish(make)

    def row_number(self, name: str) -> "Ordered":
        return self.running_sum(**{name: F.lit(1).cast("bigint")})

    def last(self, include_current: bool = True, **cols: Column) -> "Ordered":
        """Latest non-null value up to (or strictly before) the current row."""
        rank = self._rank()
        self._carry(
            {f"__s_{k}": F.max_by(v, F.when(v.isNotNull(), rank)) for k, v in cols.items()},
            lambda w: {f"__c_{k}": F.last(f"__s_{k}", ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, -1)) for k in cols})

        def make(warm: bool) -> dict[str, Column]:
            run = self._window(warm).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
            local = {k: F.last(v, ignorenulls=True).over(run) for k, v in cols.items()}
            return {k: F.coalesce(v, F.col(f"__c_{k}")) if warm else v for k, v in local.items()}
        return self._finish(make)

    def _shift(self, step: int, cols: dict[str, Column]) -> "Ordered":
        boxed = {k: F.struct(v.alias("v")) for k, v in cols.items()}
        edge = F.max_by if step < 0 else F.min_by
        move = F.lag if step < 0 else F.lead
        self._carry({f"__s_{k}": edge(v, self._rank()) for k, v in boxed.items()},
                    lambda w: {f"__c_{k}": move(f"__s_{k}", 1).over(w) for k in cols})

        def make(warm: bool) -> dict[str, Column]:
            local = {k: move(v, 1).over(self._window(warm)) for k, v in boxed.items()}
            return {k: (F.coalesce(v, F.col(f"__c_{k}")) if warm else v)["v"] for k, v in local.items()}
        return self._finish(make)

    def lag(self, **cols: Column) -> "Ordered":
        return self._shift(-1, cols)

    def lead(self, **cols: Column) -> "Ordered":
        return self._shift(1, cols)

    def since(self, name: str, active: Column, reset: Column, value: Column) -> "Ordered":
        """``value`` at the first active row after the latest reset row, else null.

        A reset row ends a streak and must not be active itself; rows that are neither
        change nothing.
        """
        self.last(False, __st=F.when(active, 1).when(reset, 0))
        opens = active & (F.coalesce("__st", F.lit(0)) == 0)
        box = F.struct(value.alias("v"))
        # a reset leaves a boxed null, so that a closed streak is not mistaken for an open one
        closed = F.struct(F.when(F.lit(False), value).alias("v"))
        self.last(**{name: F.when(opens, box).when(reset, closed)})
        return self._finish(lambda warm: {name: F.col(name)["v"]}).drop("__st")

    def _totals(self, table: DataFrame, cold: dict[str, Column], keys: list[str]) -> "Ordered":
        """Columns of ``table`` (keys, __c_..) for the hot rows, window functions for the others."""
        self.warm = join_keyed(self.warm, hinted(cut_lineage(table)), keys, "left")
        return self._finish(lambda warm: {k: F.col(f"__c_{k}") for k in cold} if warm else cold)

    def total(self, by: tuple[str, ...] = (), **cols: Column) -> "Ordered":
        """Aggregates of the whole key, or of its rows with equal ``by``, next to every row (``F.max(..)`` and so on)."""
        keys = [*self.keys, *by]
        cold = {k: v.over(Window.partitionBy(*keys)) for k, v in cols.items()}
        if self.warm is None:
            return self._finish(lambda warm: cold)
        return self._totals(self.warm.groupBy(*keys).agg(*[v.alias(f"__c_{k}") for k, v in cols.items()]), cold, keys)

    def total_median(self, **cols: Column) -> "Ordered":
        """Exact whole-key medians next to every row."""
        from stamina.operators.quantiles import distributed_quantile
        for k, v in cols.items():
            cold = {k: F.percentile(v, F.lit(0.5)).over(Window.partitionBy(*self.keys))}
            if self.warm is None:
                self._finish(lambda warm, cold=cold: cold)
            else:
                self._totals(distributed_quantile(self.warm, self.keys, v, f"__c_{k}", 0.5, self.per_segment), cold, self.keys)
        return self

    def result(self) -> DataFrame:
        return self.cold if self.warm is None else self.cold.unionByName(self.warm.drop(SEG))


def haloed(df: DataFrame, keys: list[str], x: str, width: float, reach: float
           ) -> tuple[DataFrame, list[str]]:
    """Cut ``x`` into buckets and copy rows near an edge to the neighbour bucket.

    Frames that look at most ``reach`` (<= ``width``) away then lie inside one
    bucket. Rows with ``__home`` true are the originals.
    """
    b = F.floor(F.col(x) / F.lit(width))
    low, high = b * F.lit(width) + F.lit(reach), (b + 1) * F.lit(width) - F.lit(reach)
    copies = F.array_compact(F.array(
        F.struct(b.alias("b"), F.lit(True).alias("home")),
        F.when(F.col(x) <= low, F.struct((b - 1).alias("b"), F.lit(False).alias("home"))),
        F.when(F.col(x) >= high, F.struct((b + 1).alias("b"), F.lit(False).alias("home")))))
    out = (df.withColumn("__cp", F.explode(copies))
           .withColumn("__bucket", F.col("__cp.b")).withColumn("__home", F.col("__cp.home"))
           .drop("__cp"))
    return out, [*keys, "__bucket"]

"""Report totals and control breaks over rows in an order.

A group is a run of rows whose reset expression, or that of a group around it, doesn't change.  Where the order
begins with the groups' expressions, runs are keys and whole runs a plain aggregation.  In general, and for totals so far, the order is
cut into blocks of consecutive rows, which one shuffle brings together: what crosses a block's edge is the row before it and
one row a block with the sums so far.  The one window over the latter runs in one task, over one in ``BLOCK`` rows; no window spans all rows,
and a run of any length is spread over its blocks.  All totals and run numbers are computed together.

The blocks are read twice (for the sums that cross them, and for the rows), so rows that are dear to compute should be stored, as numbered rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError

#: Rows of a block of consecutive rows.
BLOCK = 16_384

# What an empty maximum and minimum show.
LEAST, MOST = -1.7e308, 1.7e308
KINDS = ("sum", "count", "average", "max", "min")


@dataclass(frozen=True)
class Group:
    """A level of control breaks; without an expression it breaks on every row."""

    name: str
    expression: Column | None = None


@dataclass(frozen=True)
class Total:
    """kind of KINDS over a numeric expression, restarting with each run of a group (None: never).

    condition: the row counts only if it is true ("true") or if its value differs from the row's before ("change").
    """

    name: str
    kind: str
    expression: Column | None = None
    reset: str | None = None
    condition: Column | None = None
    on: str = "true"


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def with_previous(df: DataFrame, columns: dict[str, Column], order: str = "_seq", block: int = BLOCK) -> DataFrame:
    """Adds to each row (order: 1, 2, 3, …) the values that columns had in the row before, ``_first``, and its ``_block``."""
    here = F.floor((F.col(order) - 1) / block)
    if not columns:
        return df.withColumn("_block", here).withColumn("_first", F.col(order) == 1)
    rows = df.withColumns({f"_now_{k}": c for k, c in columns.items()})
    held = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (order, *(f"_now_{k}" for k in columns)) else F.col(f"`{f.name}`") for f in rows.schema]
    # the last row of each block also stands, as a guest, before the next block
    guests = rows.filter(F.col(order) % block == 0).select(*held).withColumn("_block", F.floor(F.col(order) / block)).withColumn("_guest", F.lit(True))
    w = Window.partitionBy("_block").orderBy(order)
    both = rows.withColumn("_block", here).withColumn("_guest", F.lit(False)).unionByName(guests)
    both = both.withColumns({f"_before_{k}": F.lag(f"_now_{k}").over(w) for k in columns})
    return both.filter(~F.col("_guest")).withColumn("_first", F.col(order) == 1).drop("_guest", *(f"_now_{k}" for k in columns))


def running(df: DataFrame, values: dict[str, tuple[str, Column]], begins: dict[str, Column] | None = None, order: str = "_seq", block: int = BLOCK) -> DataFrame:
    """Running sums, maxima or minima (name: (function, value)) up to and including each row, all in one go.

    begins says by name with which rows a total starts anew; the others run through all rows.  A ``_block`` that the rows have is used and dropped.
    """
    begins = begins or {}
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    join = {"sum": lambda a, i: F.coalesce(a + i, a, i), "max": F.greatest, "min": F.least}
    rows = df if "_block" in df.columns else df.withColumn("_block", F.floor((F.col(order) - 1) / block))
    rows = rows.withColumns({f"_v_{k}": v for k, (_, v) in values.items()})
    # Totals that start anew with the same rows share the count of these, inside of the block.
    flags: dict[str, Column] = {}
    counts = {}
    for k, flag in begins.items():
        flags[str(flag)] = flag
        counts[k] = f"_s_{list(flags).index(str(flag))}"
    so_far = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s_{j}": F.sum(F.coalesce(flag, F.lit(False)).cast("long")).over(so_far) for j, flag in enumerate(flags.values())})
    inside = {k: Window.partitionBy("_block", counts[k]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) if k in counts else so_far for k in values}
    rows = rows.withColumns({f"_i_{k}": agg[f](f"_v_{k}").over(inside[k]) for k, (f, _) in values.items()})
    # A block's last row has all that the next block needs of it.
    starts = [f"_s_{j}" for j in range(len(flags))]
    ends = rows.groupBy("_block").agg(F.max_by(F.struct(*starts, *(f"_i_{k}" for k in values)), order).alias("_end")).select("_block", "_end.*")
    blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({f"_g{s}": F.sum((F.col(s) > 0).cast("long")).over(blocks) for s in starts})
    since = {k: Window.partitionBy(f"_g{counts[k]}").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0) if k in counts else blocks for k in values}
    ends = ends.withColumns({f"_a_{k}": agg[f](f"_i_{k}").over(since[k]) for k, (f, _) in values.items()})
    ends = ends.select("_block", *(F.lag(f"_a_{k}").over(Window.orderBy("_block")).alias(f"_a_{k}") for k in values))
    rows = rows.join(ends, "_block")
    before = {k: F.when(F.col(counts[k]) == 0, F.col(f"_a_{k}")) if k in counts else F.col(f"_a_{k}") for k in values}
    rows = rows.withColumns({k: join[f](before[k], F.col(f"_i_{k}")) for k, (f, _) in values.items()})
    return rows.drop("_block", *starts, *(f"_{x}_{k}" for k in values for x in "vai"))


def running_in_keys(df: DataFrame, values: dict[str, tuple[str, Column]], keys: list[Column], order: str = "_seq", block: int = BLOCK) -> DataFrame:
    """Running sums, maxima or minima within keys that are runs: partial sums a key and block, and windows inside of these.

    A key of many rows is spread over its blocks.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    join = {"sum": lambda a, i: F.coalesce(a + i, a, i), "max": F.greatest, "min": F.least}
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.withColumns({"_block": F.floor((F.col(order) - 1) / block)} | dict(zip(names, keys, strict=True)) | {f"_v_{k}": v for k, (_, v) in values.items()})
    parts = rows.groupBy(*names, "_block").agg(*(agg[f](f"_v_{k}").alias(f"_p_{k}") for k, (f, _) in values.items()))
    ahead = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(n).alias(f"{n}_") for n in (*names, "_block")), *(agg[f](f"_p_{k}").over(ahead).alias(f"_a_{k}") for k, (f, _) in values.items()))
    inside = Window.partitionBy(*names, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_i_{k}": agg[f](f"_v_{k}").over(inside) for k, (f, _) in values.items()})
    rows = rows.join(parts, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in (*names, "_block")])
    rows = rows.withColumns({k: join[f](F.col(f"_a_{k}"), F.col(f"_i_{k}")) for k, (f, _) in values.items()})
    return rows.drop("_block", "_block_", *names, *(f"{n}_" for n in names), *(f"_{x}_{k}" for k in values for x in "vai"))


def replace(report: Report, running_totals: list[Total]) -> Report:
    """The report with some of its totals, and the others that count changes (for their marks)."""
    others = [t for t in report.totals if t not in running_totals and t.condition is not None and t.on == "change"]
    return Report(report.rows, report.groups, [*running_totals, *others], report.order, report.sorted_by_groups)


class Report:
    """Groups from the outermost to the innermost, and totals, over rows numbered by ``order``.

    sorted_by_groups: the order begins with the groups' expressions, so that runs are keys.
    """

    def __init__(self, rows: DataFrame, groups: list[Group] | None = None, totals: list[Total] | None = None, order: str = "_seq", sorted_by_groups: bool = False):
        self.rows, self.groups, self.totals, self.order = rows, groups or [], totals or [], order
        self.sorted_by_groups = sorted_by_groups and all(g.expression is not None for g in self.groups)
        names = {g.name for g in self.groups}
        for t in self.totals:
            if t.kind not in KINDS or t.reset is not None and t.reset not in names:
                raise EngineError("report", f"total {t.name}: unknown kind or group")

    def _level(self, name: str | None) -> int:
        """Number of group levels whose runs a total or a table follows."""
        return 0 if name is None else 1 + next(i for i, g in enumerate(self.groups) if g.name == name)

    def _marked(self) -> DataFrame:
        """Rows with first_change and, for each total that counts changes, whether the row counts; in their blocks."""
        changed = {t.name: t.condition for t in self.totals if t.condition is not None and t.on == "change"}
        watched = {f"g{i}": g.expression for i, g in enumerate(self.groups) if g.expression is not None} | {f"c_{k}": v for k, v in changed.items()}
        rows = with_previous(self.rows, watched, self.order)
        level: Column = F.lit(0)
        for i in reversed(range(len(self.groups))):
            g = self.groups[i]
            new = F.lit(True) if g.expression is None else F.col("_first") | _differs(g.expression, F.col(f"_before_g{i}"))
            level = F.when(new, F.lit(i + 1)).otherwise(level)
        rows = rows.withColumn("first_change", level)
        for name, condition in changed.items():
            t = next(t for t in self.totals if t.name == name)
            # the first row of a run always counts
            start = F.col("_first") | self._begins(self._level(t.reset))
            rows = rows.withColumn(f"_counts_{name}", start | _differs(condition, F.col(f"_before_c_{name}")))
        return rows.drop(*(c for c in rows.columns if c.startswith("_before_")))

    @staticmethod
    def _begins(level: int) -> Column:
        """Whether a run of a level begins with the row."""
        return F.col("first_change").between(1, level)

    def _numbers(self) -> dict[str, tuple[str, Column]]:
        return {f"run_{g.name}": ("sum", self._begins(i + 1).cast("long")) for i, g in enumerate(self.groups)}

    @property
    def _by_key(self) -> bool:
        """Whether runs are keys throughout, so that they need no numbers."""
        return self.sorted_by_groups and not any(t.condition is not None and t.on == "change" for t in self.totals)

    def broken(self) -> DataFrame:
        """Rows with run_<group> (number of the run, or the group's key where runs are keys), and first_change.

        first_change is the level (from 1, outermost) of the outermost group that begins with the row, 0 if none does.
        """
        if self._by_key:
            return self.rows.withColumns({f"run_{g.name}": g.expression for g in self.groups}) if self.groups else self.rows
        rows = self._marked()
        return running(rows, self._numbers(), order=self.order) if self.groups else rows.drop("_block")

    def first_changes(self) -> DataFrame:
        """Rows with first_change, also where runs are keys."""
        return Report(self.rows, self.groups, self.totals, self.order).broken()

    def _value(self, t: Total) -> Column:
        x = F.lit(1) if t.expression is None else t.expression
        counts = None if t.condition is None else F.col(f"_counts_{t.name}") if t.on == "change" else F.coalesce(t.condition, F.lit(False))
        return x if counts is None else F.when(counts, x)

    def _aggregate(self, t: Total) -> Column:
        """A whole run's total; of nothing: average 0, sum 0, maximum and minimum the ends of the number range."""
        x = self._value(t)
        match t.kind:
            case "sum":
                return F.coalesce(F.sum(x), F.lit(0)).alias(t.name)
            case "count":
                counted = F.lit(1) if t.condition is None else F.when(self._value(Total(t.name, "count", None, None, t.condition, t.on)).isNotNull(), 1)
                return F.count(counted).alias(t.name)
            case "average":
                return F.coalesce(F.avg(x), F.lit(0.0)).alias(t.name)
            case "max":
                return F.coalesce(F.max(x.cast("double")), F.lit(LEAST)).alias(t.name)
        return F.coalesce(F.min(x.cast("double")), F.lit(MOST)).alias(t.name)

    def _keys(self, level: int) -> list[str]:
        """Columns that name a run of a level."""
        if self._by_key:
            return [f"run_{g.name}" for g in self.groups[:level]]
        return [f"run_{self.groups[level - 1].name}"] if level else []

    def with_running(self) -> DataFrame:
        """Rows with each total's value so far in its run."""
        values: dict[str, tuple[str, Column]] = {}
        level_of: dict[str, int] = {}
        for t in self.totals:
            x, own = self._value(t), {}
            if t.kind in ("max", "min"):
                own[f"_t_{t.name}"] = (t.kind, x.cast("double"))
            if t.kind in ("sum", "average"):
                own[f"_t_{t.name}"] = ("sum", x)
            if t.kind in ("count", "average"):
                n = x.isNotNull() if t.kind == "average" or t.condition is not None else F.lit(True)
                own[f"_n_{t.name}"] = ("sum", n.cast("long"))
            values |= own
            level_of |= dict.fromkeys(own, self._level(t.reset))
        if self._by_key:
            rows = self.broken()
            for level in sorted(set(level_of.values())):
                rows = running_in_keys(rows, {k: v for k, v in values.items() if level_of[k] == level}, [g.expression for g in self.groups[:level]], self.order)
        else:
            rows = running(self._marked(), self._numbers() | values, {k: self._begins(level) for k, level in level_of.items() if level}, self.order)
        for t in self.totals:
            s, n = F.col(f"_t_{t.name}"), F.col(f"_n_{t.name}")
            shown = {"sum": lambda: F.coalesce(s, F.lit(0)), "count": lambda: n, "average": lambda: F.when(n > 0, s / n).otherwise(0.0), "max": lambda: F.coalesce(s, F.lit(LEAST)), "min": lambda: F.coalesce(s, F.lit(MOST))}[t.kind]()  # noqa: B023
            rows = rows.withColumn(t.name, shown)
        return rows.drop(*values)

    def with_lookahead(self) -> DataFrame:
        """Rows with each total's value of the whole run, known from its first row on."""
        rows = self.broken()
        for level in sorted({self._level(t.reset) for t in self.totals}):
            totals, keys = [t for t in self.totals if self._level(t.reset) == level], self._keys(level)
            # aggregated, then joined back: a run is never gathered in one task
            whole = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(*map(self._aggregate, totals))
            if keys:
                condition = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
                rows = rows.join(whole, condition).drop(*(f"_k{i}" for i in range(len(keys))))
            else:
                rows = rows.crossJoin(F.broadcast(whole))  # one row
        return rows

    def table(self, group: str | None, columns: list[str]) -> DataFrame:
        """The output table: one row for each break of a group (one in all if None).

        Holds the columns as they are in the run's last row, and the totals: those that restart with an outer group
        have their value so far.
        """
        level = self._level(group)
        inner = [t for t in self.totals if self._level(t.reset) == level]
        outer = [t for t in self.totals if self._level(t.reset) < level]
        if any(self._level(t.reset) > level for t in self.totals):
            raise EngineError("report", "a total restarts inside the group of the table")
        # the outer totals so far come with the runs; a total that counts changes needs its marks in any case
        rows = replace(self, outer).with_running() if outer else self.broken()
        keys = self._keys(level)
        last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns), *(t.name for t in outer), F.col(self.order)), self.order).alias("_last")
        out = rows.groupBy(*keys).agg(last, *map(self._aggregate, inner))
        return out.select(F.col(f"_last.{self.order}").alias(self.order), *(F.col(f"_last.`{c}`").alias(c) for c in columns), *(F.col(t.name) if t in inner else F.col(f"_last.{t.name}").alias(t.name) for t in self.totals))

    def levels(self, columns: dict[str, Column] | None = None) -> DataFrame:
        """The totals of the runs of every group, and of all rows, in one aggregation; needs groups that are keys.

        Holds the groups' expressions by their names (null in rows of outer groups), ``level`` (0: all rows) and the totals, which mustn't restart.
        """
        if not self._by_key or any(t.reset for t in self.totals):
            raise EngineError("report", "totals of all levels need rows sorted by the groups")
        names = [g.name for g in self.groups]
        rows = self.rows.withColumns({g.name: g.expression for g in self.groups})
        out = rows.rollup(*names).agg(F.grouping_id().alias("_out"), *map(self._aggregate, self.totals))
        # grouping_id has a bit for each group that is summed over, from the innermost on
        return out.withColumn("level", F.lit(len(names)) - F.bit_count("_out").cast("int")).drop("_out")

    def summary(self) -> DataFrame:
        """The grand totals, one row."""
        whole = Report(self.rows, [], [Total(t.name, t.kind, t.expression, None, t.condition, t.on) for t in self.totals], self.order)
        rows = whole.broken()
        return rows.agg(*map(whole._aggregate, whole.totals))

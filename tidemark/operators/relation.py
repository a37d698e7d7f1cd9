"""Relations: a tree of tables, read as one composite record.

A relation has one master; every other node looks its records up by an expression over the composite above it.  All
lookups become equi-joins, whose strategy Spark chooses; the only windows and aggregates are those that pick
the first match of an exact lookup.

Columns of a composite are named ``alias__field``; a node's record number is ``alias___recno`` and is null
where the node is blank.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError, ExpressionError, RelationTerminated
from ..plans.compiler import Compiler, Typed, directed, field_value
from ..plans.explain import pushed_filters
from ..plans.sequence import numbered
from ..plans.storage import materialise
from ..plans.syntax import conjuncts, names, parse
from ..types import NUM, blank, field_of
from .table import DELETED, RECNO, Table

EXACT, SCAN, APPROX = "exact", "scan", "approx"
BLANK, SKIP, TERMINATE = "blank", "skip", "terminate"
#: Ranges of keys of an approximate lookup at most, and bytes of a slave for each, as the optimizer estimates them.
RANGES, RANGE_BYTES = 4096, 128 << 20


@dataclass
class Node:
    """A table of a relation. key is over the tables above it; without a tag it is a record number."""

    table: Table
    key: str | None = None
    tag: str | None = None
    type: str = EXACT
    action: str = BLANK
    match_length: int | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def alias(self) -> str:
        return self.table.name

    def walk(self) -> list[Node]:
        return [self, *(n for c in self.children for n in c.walk())]

    def slave(self, table: Table, key: str, tag: str | None = None, type: str = EXACT, action: str = BLANK, match_length: int | None = None) -> Node:
        """Adds a table looked up from this one, and returns its node."""
        if type not in (EXACT, SCAN, APPROX) or action not in (BLANK, SKIP, TERMINATE):
            raise EngineError("relation", f"unknown type or action: {type}, {action}")
        child = Node(table, key, tag, type, action, match_length)
        self.children.append(child)
        return child


class Relation:
    """A tree of lookups with a filter and a sort order. blank_mode: "null" or "blank" for fields of blank nodes."""

    def __init__(self, master: Table, tag: str | None = None, blank_mode: str = "null"):
        self.root = Node(master, tag=tag)
        self.blank_mode = blank_mode
        self.filter_text: str | None = None
        self.sort_text: str | None = None
        self.callback: Callable[[str, str], str] | None = None
        self._kept: DataFrame | None = None

    # Building.

    @property
    def nodes(self) -> list[Node]:
        """Nodes in pre-order."""
        return self.root.walk()

    def node(self, alias: str) -> Node:
        found = next((n for n in self.nodes if n.alias.upper() == alias.upper()), None)
        if found is None:
            raise ExpressionError("unknown alias", alias)
        return found

    def slave(self, *args, **options) -> Node:
        node = self.root.slave(*args, **options)
        self._checked()
        return node

    def _checked(self) -> None:
        aliases = [n.alias.upper() for n in self.nodes]
        if len(set(aliases)) < len(aliases):
            raise EngineError("relation", "a table occurs twice; use a clone with another name")

    def query(self, text: str | None) -> Relation:
        """Sets the filter; None or blank clears it."""
        text = self.callback("query", text or "") if self.callback else text
        self.filter_text = text if text and text.strip() else None
        if self.filter_text:
            self._compiler(True).where(self.filter_text)
        self._kept = None
        return self

    def sort(self, text: str | None) -> Relation:
        """Sets the sort expression; None or blank goes back to the natural order."""
        self.sort_text = text if text and text.strip() else None
        if self.sort_text:
            self._compiler(True).sort_keys(self.sort_text)
        self._kept = None
        return self

    def on_query(self, callback: Callable[[str, str], str]) -> Relation:
        """A hook that may rewrite filters when they are set."""
        self.callback = callback
        return self

    # Expressions over the composite.

    def _compiler(self, substitute: bool, within: list[Node] | None = None) -> Compiler:
        """substitute: fields of blank nodes are blanks instead of null."""
        nodes = within or self.nodes

        def resolve(name: str, alias: str | None) -> Typed:
            some = [n for n in nodes if alias is None or n.alias.upper() == alias.upper()]
            if not some:
                raise ExpressionError("unknown alias", alias or "")
            for n in some:
                info = next((f for f in n.table.fields if f.name.upper() == name.upper()), None)
                if info is None:
                    continue
                dtype = n.table.df.schema[info.name].dataType
                column = F.col(f"`{n.alias}__{info.name}`")
                if substitute and self._may_be_blank(n):
                    column = F.when(F.col(f"`{n.alias}__{RECNO}`").isNull(), blank(info.kind, dtype)).otherwise(column)
                return field_value(column, info.kind, dtype, info.width, info.decimals)
            raise ExpressionError("no field", name)

        calcs = {k: v for n in nodes for k, v in n.table.calcs.items()}
        record = {"deleted": F.coalesce(F.col(f"`{self.root.alias}__{DELETED}`"), F.lit(False)), "recno": F.col(f"`{self.root.alias}__{RECNO}`")}
        return Compiler(resolve, self.root.table.settings, calcs, record=record)

    def _may_be_blank(self, node: Node) -> bool:
        """Whether a composite can lack the node's record; an inner lookup under inner ones never does."""
        path = self._path(node)
        for parent, n in zip(path, path[1:], strict=False):
            if n.action == BLANK or n.type == APPROX or sum(c.type == SCAN for c in parent.children) > 1:
                return True
        return False

    def _path(self, node: Node) -> list[Node]:
        def go(n: Node, above: list[Node]):
            if n is node:
                return [*above, n]
            return next((p for c in n.children if (p := go(c, [*above, n]))), None)

        return go(self.root, []) or []

    # Lookups.

    @staticmethod
    def _columns(table: Table, df: DataFrame, keys: dict[str, Column]) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(f"{table.name}__{c}") for c in table.df.columns), *(k.alias(n) for n, k in keys.items()))

    def _sides(self, node: Node, rows: DataFrame, above: list[Node]) -> tuple[DataFrame, DataFrame, Column]:
        """Masters with _mk, slaves with _sk and the join condition; text keys are compared without trailing blanks."""
        # A blank composite has blank keys, which may match blank keys.
        master = self._compiler(True, above).compile(node.key)
        table = node.table
        if node.tag is None:
            if master.kind != NUM:
                raise ExpressionError("type", f"{node.key} isn't a record number")
            slaves = self._columns(table, table.df, {"_sk": F.col(RECNO)})
            return rows.withColumn("_mk", master.column.cast("long")), slaves, F.col("_mk") == F.col("_sk")
        tag = table.tag(node.tag)
        key = table.key(tag)
        if (key.is_text, key.kind if not key.is_text else "") != (master.is_text, master.kind if not master.is_text else ""):
            raise ExpressionError("type", f"{node.key} isn't of the type of tag {tag.name}")
        if key.is_text:
            mk, sk = F.rtrim(master.column), F.rtrim(key.column)
            if node.match_length:
                mk, sk = (F.substring(F.rpad(c, node.match_length, " "), 1, node.match_length) for c in (mk, sk))
        elif node.match_length:
            raise EngineError("relation", "a match length needs a text tag")
        elif master.plain is not None and key.plain is not None:
            mk, sk = master.plain, key.column
        else:
            mk, sk = master.column, key.column.cast("double") if master.kind == NUM else key.column
        slaves = self._columns(table, table.entries(node.tag), {"_sk": sk})
        # Null matches null only if both sides can be null.
        above_fields = [(a, f) for a in above for f in a.table.fields]
        used = {n.field.upper() for n in names(parse(node.key))}
        slave_used = {n.field.upper() for n in names(parse(tag.key))}
        both = any(f.nullable and f.name.upper() in used for _, f in above_fields) and any(f.nullable and f.name.upper() in slave_used for f in table.fields)
        declared = any("xtype" in (a.table.df.schema[f.name].metadata or {}) for a, f in above_fields if f.name.upper() in used) and both
        condition = F.col("_mk").eqNullSafe(F.col("_sk")) if declared else F.col("_mk") == F.col("_sk")
        return rows.withColumn("_mk", mk), slaves, condition

    def _first_of_key(self, node: Node, slaves: DataFrame) -> DataFrame:
        """The first record of each key in tag order; an aggregation, with partial results before the shuffle.

        Dropped where the tag is unique by its rule, as there is nothing to pick.
        """
        tag = node.table.tag(node.tag) if node.tag else None
        if tag is None or tag.unique and not node.match_length:
            return slaves
        recno = F.col(f"`{node.alias}__{RECNO}`")
        columns = [c for c in slaves.columns if c != "_sk"]
        row = F.struct(*(F.col(f"`{c}`") for c in columns))
        if node.match_length:
            full = node.table.key(tag).column  # the key itself orders the matches of a prefix
            ranked = self._columns(node.table, node.table.entries(node.tag), {"_full": full}).select("_full", f"`{node.alias}__{RECNO}`")
            slaves = slaves.join(ranked, f"{node.alias}__{RECNO}")
            order = F.struct("_full", recno)
        else:
            order = recno
        pick = F.max_by(row, order) if tag.descending else F.min_by(row, order)
        return slaves.groupBy("_sk").agg(pick.alias("_row")).select("_sk", *(F.col(f"_row.`{c}`").alias(c) for c in columns))

    def _lookup(self, node: Node, rows: DataFrame, above: list[Node]) -> DataFrame:
        """Exact and approximate lookups: one record for each composite."""
        if node.type == APPROX:
            return self._approx(node, rows, above)
        masters, slaves, condition = self._sides(node, rows, above)
        slaves = self._first_of_key(node, slaves)
        how = "inner" if node.action == SKIP else "left"
        found = masters.join(slaves, condition, how).drop("_mk", "_sk")
        return self._cut(node, found, above)

    def _cut(self, node: Node, found: DataFrame, above: list[Node]) -> DataFrame:
        """Of a terminating lookup, the composites before the first miss in the order of the nodes above it."""
        if node.action != TERMINATE:
            return found
        missing = F.col(f"`{node.alias}__{RECNO}`").isNull()
        order = F.struct(*(F.col(f"`{c}`") for c in self._order_columns(above)))
        first = found.filter(missing).agg(F.min(order).alias("_stop"))  # one row
        return found.join(F.broadcast(first)).filter(F.col("_stop").isNull() | (order < F.col("_stop"))).drop("_stop")

    def _order_columns(self, above: list[Node]) -> list[str]:
        return [f"{n.alias}__{RECNO}" for n in above]

    def _approx(self, node: Node, rows: DataFrame, above: list[Node]) -> DataFrame:
        """The record of the key or of the next greater one; beyond the last key it is blank.

        The next key is found once for each key of the masters, then joined to them by key, so that many masters of one
        key are spread as in any join.  Keys are cut into ranges by quantiles of the slave keys, more of them where there are more keys.  Inside a range
        the next key comes from a window over both sides' keys; a range whose masters find none there takes the first key of the ranges behind, of
        which there is one row a range.  So no window spans the whole order.
        """
        masters, slaves, _ = self._sides(node, rows, above)
        if node.tag is None:
            return masters.join(slaves, F.col("_mk") == F.col("_sk"), "left").drop("_mk", "_sk")
        slaves = slaves.filter("_sk IS NOT NULL")
        size = int(str(slaves._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        slaves = self._first_of_key(node, slaves)
        columns = [c for c in slaves.columns if c != "_sk"]
        names_ = [c for c in masters.columns if c != "_mk"]
        kind = dict(slaves.dtypes)["_sk"]
        bounds = self._bounds(slaves.select("_sk"), size)
        cuts = F.array(*(F.lit(c).cast(kind) for c in bounds)) if bounds else None
        place = lambda c: F.size(F.filter(cuts, lambda b: b < c)) if bounds else F.lit(0)
        right = slaves.select(F.col("_sk").alias("_k"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")).withColumn("_range", place(F.col("_k")))
        left = masters.select(F.col("_mk").cast(kind).alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_range", place(F.col("_k")))
        firsts = right.groupBy("_range").agg(F.min_by("_row", "_k").alias("_next"))
        behind = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        # the first key of the nearest range behind that has any: one row a range
        ranges = rows.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_range")).join(firsts, "_range", "left")
        ranges = ranges.select("_range", F.last("_next", ignorenulls=True).over(behind).alias("_later"))
        a = left.select("_range", "_k", F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_row"].dataType).alias("_row"))
        b = right.select("_range", "_k", F.lit(0).alias("_side"), "_row")
        # Going down the keys, the last slave seen at or before a master's place; slaves come first at equal keys.
        down = Window.partitionBy("_range").orderBy(F.col("_k").desc(), F.col("_side").asc()).rowsBetween(Window.unboundedPreceding, 0)
        met = a.unionByName(b).withColumn("_found", F.last("_row", ignorenulls=True).over(down)).filter("_side = 1")
        met = met.join(F.broadcast(ranges), "_range", "left").select("_k", F.coalesce("_found", "_later").alias("_found"))
        met = masters.withColumn("_mk", F.col("_mk").cast(kind)).join(met, F.col("_mk") == F.col("_k"), "left")
        return met.select(*(F.col(f"`{c}`") for c in names_), *(F.col(f"_found.`{c}`").alias(c) for c in columns))

    @staticmethod
    def _bounds(keys: DataFrame, size: int) -> list:
        """Bounds that cut distinct keys into ranges, out of a sample of least hashes; they only balance the ranges."""
        parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES, size // RANGE_BYTES))
        sample = sorted(r["_sk"] for r in keys.withColumn("h", F.xxhash64("_sk")).orderBy("h").limit(40 * parts).select("_sk").collect())
        return sample[39::40][:-1] if len(sample) > 40 else []

    def _blank(self, rows: DataFrame, nodes: list[Node]) -> DataFrame:
        """Adds the columns of nodes as null."""
        return rows.select("*", *(F.lit(None).cast(c.dataType).alias(f"{n.alias}__{c.name}") for n in nodes for c in n.table.df.schema))

    def _expand(self, node: Node, rows: DataFrame, above: list[Node]) -> DataFrame:
        above = [*above, node]
        for child in node.children:
            if child.type != SCAN:
                rows = self._expand(child, self._lookup(child, rows, above), above)
                above = [*above, *child.walk()]
        scans = [c for c in node.children if c.type == SCAN]
        if len(scans) == 1:
            masters, slaves, condition = self._sides(scans[0], rows, above)
            how = "inner" if scans[0].action == SKIP else "left"
            found = self._cut(scans[0], masters.join(slaves, condition, how).drop("_mk", "_sk"), above)
            return self._expand(scans[0], found, above)
        if not scans:
            return rows
        # Several scans take turns: while one runs through its matches the others, with all below them, are blank.
        parts = []
        for child in scans:
            masters, slaves, condition = self._sides(child, rows, above)
            hit = self._expand(child, masters.join(slaves, condition, "inner").drop("_mk", "_sk"), above)
            parts.append(self._blank(hit, [n for other in scans if other is not child for n in other.walk()]))
        if all(c.action == BLANK for c in scans):
            none = rows
            for child in scans:
                masters, slaves, condition = self._sides(child, none, above)
                none = masters.join(slaves.select("_sk"), condition, "left_anti").drop("_mk")
            parts.append(self._blank(none, [n for c in scans for n in c.walk()]))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # Results.

    def composites(self) -> DataFrame:
        """All composites, unordered, with the filter applied and fields of blank nodes as null (or blank)."""
        if self._kept is not None:
            return self._kept
        table = self.root.table
        rows = self._columns(table, table.entries(self.root.tag), {})
        if not self.filter_text:
            rows = self._expand(self.root, rows, [])
        else:
            # Conjuncts over the master alone hold before any lookup; the others see the finished composite.
            early, late = [], []
            for part in conjuncts(parse(self.filter_text)):
                own = all(n.alias is None and any(f.name.upper() == n.field.upper() for f in table.fields) or (n.alias or "").upper() == table.name.upper() for n in names(part))
                (early if own and not self._stops() else late).append(part)
            for part in early:
                rows = rows.filter(self._compiler(True, [self.root]).where(part))
            rows = self._expand(self.root, rows, [])
            for part in late:
                rows = rows.filter(self._compiler(True).where(part))
        if self.blank_mode == "blank":
            for n in self.nodes[1:]:
                if self._may_be_blank(n):
                    none = F.col(f"`{n.alias}__{RECNO}`").isNull()
                    rows = rows.withColumns({f"{n.alias}__{c.name}": F.when(none, blank(field_of(c).kind, c.dataType)).otherwise(F.col(f"`{n.alias}__{c.name}`")) for c in n.table.df.schema if c.name not in (RECNO, DELETED)})
        return rows

    def _stops(self) -> bool:
        return any(n.action == TERMINATE for n in self.nodes)

    def order(self, reverse: bool = False) -> list[Column]:
        """The relation's order: its sort expression, then each node's place in pre-order."""
        keys = self._compiler(True).sort_parts(self.sort_text) if self.sort_text else []
        for n in self.nodes:
            tag = n.table.tag(n.tag) if n.tag else None
            recno = F.col(f"`{n.alias}__{RECNO}`")
            down = bool(tag and tag.descending) and (n is self.root or n.type == SCAN)
            keys.append((recno.isNull(), False))  # blank nodes come last: the first sibling's rows are first
            if tag is not None and (n is self.root or n.type == SCAN):
                own = self._compiler(False, [n]).compile(tag.key)
                keys.append((own.plain if own.plain is not None else own.column, down))
            keys.append((recno, down))
        return [directed(c, down != reverse) for c, down in keys]

    def ordered(self, reverse: bool = False) -> DataFrame:
        return self.composites().orderBy(*self.order(reverse))

    def sequenced(self, name: str = "_seq", columns: list[Column] | None = None) -> DataFrame:
        """Composites (or some columns of them) numbered from 1 in the relation's order."""
        return numbered(self.composites(), self.order(), name, columns)

    def select(self, **expressions: str) -> DataFrame:
        """Expressions over the composites."""
        rows = self.composites()
        compiler = self._compiler(self.blank_mode == "blank")
        return rows.select(*(compiler.compile(e).column.alias(n) for n, e in expressions.items()))

    def column(self, text: str) -> Column:
        return self._compiler(self.blank_mode == "blank").compile(text).column

    def count(self) -> int:
        """Number of composites. Without a filter, lookups that neither drop nor multiply masters aren't made."""
        if self._kept is None and not self.filter_text and all(n.type != SCAN and n.action == BLANK for n in self.nodes[1:]):
            return self.root.table.entries(self.root.tag).count()
        return self.composites().count()

    def top(self) -> DataFrame:
        return self.ordered().limit(1)

    def bottom(self) -> DataFrame:
        return self.ordered(reverse=True).limit(1)

    def skip(self, n: int) -> DataFrame:
        """The composite n places after the first (from the last if negative)."""
        return self.ordered(reverse=n < 0).offset(n if n >= 0 else -n - 1).limit(1)

    def is_empty(self) -> bool:
        return self.composites().isEmpty()

    def distinct_masters(self) -> DataFrame:
        """One composite of each master record, the first in natural order."""
        rows = self.composites()
        master = f"{self.root.alias}__{RECNO}"
        if len(self.nodes) == 1:
            return rows
        order = F.struct(*(x for n in self.nodes[1:] for x in (F.col(f"`{n.alias}__{RECNO}`").isNull(), F.col(f"`{n.alias}__{RECNO}`"))))
        row = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != master))
        return rows.groupBy(master).agg(F.min_by(row, order).alias("_row")).select(master, "_row.*")

    def do_all(self, recno: int) -> DataFrame:
        """Composites of one master record; no filter."""
        table = self.root.table
        return self._expand(self.root, self._columns(table, table.go(recno), {}), [])

    def do_one(self, recno: int, alias: str) -> DataFrame:
        """The lookup of one direct slave from one master record."""
        table = self.root.table
        node = replace(self.node(alias), children=[])
        rows = self._columns(table, table.go(recno), {})
        if node.type != SCAN:
            return self._lookup(node, rows, [self.root])
        masters, slaves, condition = self._sides(node, rows, [self.root])
        return masters.join(slaves, condition, "inner" if node.action == SKIP else "left").drop("_mk", "_sk")

    def strict(self) -> Relation:
        """Raises if a terminating lookup misses anywhere, instead of stopping there."""
        for n in self.nodes:
            if n.action == TERMINATE:
                probe = Relation(self.root.table, self.root.tag)
                probe.root.children = [replace(n, action=BLANK, children=[])]
                if not probe.composites().filter(F.col(f"`{n.alias}__{RECNO}`").isNull()).isEmpty():
                    raise RelationTerminated("terminated", f"a lookup of {n.alias} found nothing")
        return self

    def semi(self, alias: str) -> DataFrame:
        """Masters that have a record in a slave."""
        return self._matching(alias, "left_semi")

    def anti(self, alias: str) -> DataFrame:
        """Masters that have none."""
        return self._matching(alias, "left_anti")

    def _matching(self, alias: str, how: str) -> DataFrame:
        table = self.root.table
        rows = self._columns(table, table.entries(self.root.tag), {})
        masters, slaves, condition = self._sides(self.node(alias), rows, [self.root])
        return masters.join(slaves.select("_sk"), condition, how).drop("_mk")

    def retain(self) -> Relation:
        """Keeps the composites cached for the calls to come."""
        self._kept = self.composites().cache()
        return self

    def lock(self) -> Relation:
        """Reads a snapshot from now on: the composites as they are, kept in the shared folder."""
        self._kept = materialise(self.composites())
        return self

    def free(self) -> Relation:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None
        return self

    def rows(self, prefetch: bool = True, cancel: Callable[[int], bool] | None = None, every: int = 1000):
        """Composites in order, one after another, a partition at a time.

        cancel is asked before the first row and then every some rows, with the number of rows so far; if it says so, the relation ends
        there, and partitions not yet begun are not computed.
        """
        found = self.ordered().toLocalIterator(prefetchPartitions=prefetch)
        return found if cancel is None else self._until(found, cancel, every)

    @staticmethod
    def _until(found, cancel: Callable[[int], bool], every: int):
        for n, row in enumerate(found):
            if n % every == 0 and cancel(n):
                return
            yield row

    def optimizeable(self) -> bool:
        """Whether a part of the filter reaches a scan."""
        if not self.filter_text:
            return False
        return bool(pushed_filters(self.composites()))

    # Definitions.

    def save(self) -> str:
        """The definition as JSON; tables are named, not stored."""

        def tell(n: Node) -> dict:
            return {"table": n.alias, "key": n.key, "tag": n.tag, "type": n.type, "action": n.action, "match_length": n.match_length, "children": [tell(c) for c in n.children]}

        return json.dumps({"root": tell(self.root), "filter": self.filter_text, "sort": self.sort_text, "blank_mode": self.blank_mode})

    @classmethod
    def load(cls, text: str, tables: dict[str, Table]) -> Relation:
        told = json.loads(text)
        relation = cls(tables[told["root"]["table"]], told["root"]["tag"], told["blank_mode"])

        def build(node: Node, data: dict) -> None:
            for c in data["children"]:
                build(node.slave(tables[c["table"]], c["key"], c["tag"], c["type"], c["action"], c["match_length"]), c)

        build(relation.root, told["root"])
        relation._checked()
        return relation.query(told["filter"]).sort(told["sort"])

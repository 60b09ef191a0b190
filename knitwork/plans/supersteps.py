"""Synchronous supersteps of message passing on hypergraphs.

One kind of element is the *unique* side, the other the *replica* side. In the
first half of a superstep active replicas send along their incidence to uniques,
in the second half active uniques send back. A half-step is

    active senders JOIN incidence -> GROUP BY receiver -> LEFT JOIN receivers

with a pre-aggregated (map-side combined) reduction where a receiver may be hot, so
that it gets one row per task. Where none is, and each task has messages for nearly
as many receivers as messages, they are dealt first and reduced once. Programs are column expressions and stay inside Catalyst; a reduction
that has no such expression may be a Python function over Arrow columns, which is
applied before and after the exchange.

A state has any number of fields, a message too, and an inbox any number of
aggregates over messages. Messages usually go to all neighbours; a side that
names a receiver chooses, for each of its incidences, whom to write to and what.

The incidences are dealt by sender once, and states of elements that are just their ends
are made where they lie. States and incidences stay so
through all supersteps: a checkpoint keeps the partitioning, so a half-step has
one exchange, of a row per message or per receiver and task, and what it moves
follows the active set. A few senders with a large part of all incidences (hubs) would each
fill one task; their incidences stay spread out, and their few messages are
broadcast instead.

While few elements are active, states are not written anew: a half-step looks up
those that heard something in the last full state, held as columns, and writes only what changed. The
changes lie over the last full state, a few tables deep; deeper ones are merged,
and once they are a large part of it, the full state is written again.

Incidences are kept as columns, sorted by sender within partitions, in chunks of
some rows. Spark keeps the least and the largest sender of each chunk; a small
active set names a bounded number of ranges of senders, and chunks beyond these
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce as fold

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from knitwork.sources.hypergraph import Hypergraph, frequent
from knitwork.sources.shared import delete, shared_root

VERTEX, EDGE = "hypervertex", "hyperedge"
#: A sender is a hub if it has more incidences than this and than an even share of a partition; so hubs are no more than partitions.
HUB_INCIDENCES = 1_000_000
#: Incidences in a chunk, whose range of senders is kept.
CHUNK = 1000
#: Messages for each receiver and task, on average over all incidences, from which they are reduced before the exchange although no receiver is hot.
REPEATED = 4
#: Share of active elements below which only changes are written, tables of changes at most, and their share of the full state at most.
SPARSE, DEEPEST, GROWTH = 0.05, 3, 0.25
#: Elements below which full states are always written: looking changes up takes longer than writing so few rows.
MANY_ELEMENTS = 1_000_000
#: Active senders whose ids are looked at to choose ranges of chunks, and ranges at most.
FEW_SENDERS, RANGES = 4096, 32
#: Ids and numbers below this fit in one long in pairs.
SMALL = 1 << 31
#: Rows that a Python reduction holds before it reduces them.
MERGED_AT = 200_000

Fields = Column | Mapping[str, Column]


def _named(given: Fields, name: str) -> dict[str, Column]:
    return dict(given) if isinstance(given, Mapping) else {name: given}


@dataclass(frozen=True)
class Side:
    """What the elements of one side do. Expressions may use id, weight, degree (out), high (largest out-neighbour), what ``around`` adds, the
    fields of the state, and in ``apply`` and ``activate`` also those of the inbox.

    ``initial`` gives the fields of the state by name, or one column, which is then called value; ``state`` may declare names and types.
    ``message`` likewise gives the fields of a message, or one called message. ``apply`` gives the new values of fields, of value if it is one
    column; other fields stay. ``can_send`` says whether an active element has anything to say; ``after_send`` gives values of fields
    afterwards, and without it nothing changes.

    ``around`` adds aggregates over an element's own incidences, of dst and of attributes that incidences have. ``to`` makes messages addressed:
    it and ``message`` are evaluated for each incidence, with dst and its attributes in scope, and ``to`` is the id of the receiver, of any
    element of the other side, or null for no message. Messages to ids that do not exist are lost. ``inbox`` gives what this side hears as
    several aggregates by name, over the fields of the messages that it gets; their names are not those of its state. ``due`` is a number that
    says when an active element sends, in programs with buckets.
    """

    initial: Callable[[], Fields]
    message: Callable[[Column], Fields]
    apply: Callable[[], Fields]
    activate: Callable[[], Column]
    after_send: Callable[[], Fields] | None = None
    stays_active: bool = False
    starts_active: Callable[[], Column] = field(default=lambda: F.lit(True))
    can_send: Callable[[], Column] = field(default=lambda: F.lit(True))
    to: Callable[[], Column] | None = None
    around: Callable[[], Mapping[str, Column]] = field(default=dict)
    state: str | None = None
    inbox: Callable[[], Mapping[str, Column]] | None = None
    due: Callable[[], Column] | None = None

    def starting(self) -> dict[str, Column]:
        """Start values by field, with the declared types."""
        values = _named(self.initial(), "value")
        if self.state is None:
            return values
        declared = {f.name: f.dataType for f in _struct(self.state)}
        if list(declared) != list(values):
            raise ValueError(f"declared fields {list(declared)}, start values for {list(values)}")
        return {name: value.cast(declared[name]) for name, value in values.items()}


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


@dataclass(frozen=True)
class HyperProgram:
    """A pair of sides and the reduction of the messages to one receiver.

    ``reduce`` turns the column ``message`` into an aggregate, which is called inbox, for sides that do not name an inbox of their own.
    ``combine``, where given, replaces the whole grouping of (dst, message) rows into (dst, inbox); ``combine_small`` may do the same faster for
    messages that are ids, and is used where all ids are from 0 to below ``SMALL`` and incidences are fewer than that. ``merge`` is a Python function from an
    Arrow table of dst and message fields to one with the same columns and one row for each dst; it has to be associative, as it is applied
    to parts of the rows before the exchange and to their results after it. The aggregates then see its rows.

    With ``bucket``, a superstep lets only those active elements send that are due within the bucket, of that width, of the least one due;
    the others stay active.
    """

    vertex: Side
    edge: Side
    reduce: Callable[[Column], Column] | None = None
    combine: Callable[[DataFrame], DataFrame] | None = None
    combine_small: Callable[[DataFrame], DataFrame] | None = None
    needs_limit: bool = False
    merge: Callable[[pa.Table], pa.Table] | None = None
    bucket: float | None = None


@dataclass(frozen=True)
class Result:
    """Final (id, fields of the state, active) of both sides, the number of supersteps, whether nothing was active at the end, activity
    counts, and for each superstep how many rows of states it wrote and, if they were counted, how many messages it sent."""

    vertices: DataFrame
    hyperedges: DataFrame
    supersteps: int
    converged: bool
    trace: DataFrame | None
    written: tuple[int, ...] = ()
    messages: tuple[int, ...] = ()

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Both sides, and the trace if there is one, as Parquet."""
        for name in ("vertices", "hyperedges", "trace"):
            if (table := getattr(self, name)) is not None:
                table.write.mode(mode).parquet(f"{path}/{name}")


@contextmanager
def _fixed_plans(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """Plans made here keep the partitioning that they start from: it is chosen once, for states and incidences alike."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.inMemoryColumnarStorage.batchSize": str(CHUNK)}
    if parts is not None:
        wanted["spark.sql.shuffle.partitions"] = str(parts)
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class _Kept:
    """A table checkpointed in the shared folder, with the number of its rows and other sums over it that came with the writing."""

    def __init__(self, table: DataFrame, **sums: Column) -> None:
        seen = Observation()
        wanted = {"rows": F.count("*"), **{k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}}
        self.table = table.observe(seen, *(v.alias(k) for k, v in wanted.items())).checkpoint(eager=True)
        self.sums: dict[str, int] = {k: seen.get[k] for k in wanted}

    held = False

    def hold(self) -> None:
        """Kept as columns from its next use on, for many small lookups."""
        self.table.persist(StorageLevel.MEMORY_AND_DISK)
        self.held = True

    def give_back(self) -> None:
        if self.held:
            self.table.unpersist()
            self.held = False

    def drop(self) -> None:
        self.give_back()
        file = self.table._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete(self.table.sparkSession, file.get())


def ranges_of(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all ids, apart where the gaps between ids are widest."""
    ids = sorted(set(ids))
    gaps = sorted(range(1, len(ids)), key=lambda k: ids[k - 1] - ids[k])[: most - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


@dataclass(frozen=True)
class Incidence:
    """(src, dst) and attributes: plain rows, or sorted and dealt by sender, but for those of hubs."""

    dealt: DataFrame
    hubs: tuple[int, ...] = ()
    spread: DataFrame | None = None

    @staticmethod
    def of(rows: DataFrame, state: DataFrame, total: int, parts: int, floor: int, stored: bool = False) -> Incidence:
        """Kept in memory and on disk, recomputed from the source if an executor is lost. ``state`` has the degrees, of those that may be hubs at
        least. ``stored`` rows already lie in ``parts`` buckets by sender."""
        most = max(floor, total // parts)
        hubs = tuple(r["id"] for r in state.filter(F.col("degree") > most).select("id").collect()) if total > floor else ()
        own = F.col("src").isin(*hubs) if hubs else F.lit(False)
        keep = lambda x: x.persist(StorageLevel.MEMORY_AND_DISK)
        others = rows.filter(~own) if hubs else rows
        dealt = (others if stored else others.repartition(parts, "src")).sortWithinPartitions("src")
        return Incidence(keep(dealt), hubs, keep(rows.filter(own).repartition(parts, "src", "dst").sortWithinPartitions("src")) if hubs else None)

    def rows(self) -> DataFrame:
        """All incidences, as they are kept."""
        return self.dealt if self.spread is None else self.dealt.unionByName(self.spread)

    def deliver(self, speaking: DataFrame, ids: list[int] | None = None) -> DataFrame:
        """Columns of ``speaking``, which has src, by the receivers dst of each, with the attributes of incidences. ``ids``, where given, are
        all senders; chunks of others are left out where they lie together."""
        dealt = self.dealt
        if ids is not None:
            dealt = dealt.filter(fold(lambda x, y: x | y, [F.col("src").between(a, b) for a, b in ranges_of(ids)], F.lit(False)))
        sent = dealt.join(speaking, "src")
        if self.spread is None:
            return sent
        few = F.broadcast(speaking.filter(F.col("src").isin(*self.hubs)))
        return sent.unionByName(self.spread.join(few, "src"))

    def release(self) -> None:
        for x in (self.dealt, self.spread):
            if x is not None:
                x.unpersist()


def _merging(merge: Callable[[pa.Table], pa.Table], sorted_rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies ``merge`` to some rows at a time. Of rows sorted by dst, those of the last dst wait for the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, MERGED_AT
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = merge(pa.Table.from_batches(held)).combine_chunks()
            if sorted_rows:
                last = pc.max(table.column("dst")).as_py()
                done = pc.less(table.column("dst"), last)
                yield from table.filter(done).to_batches()
                table = table.filter(pc.invert(done))
            elif table.num_rows > MERGED_AT // 2:  # little to merge here: what is left to do is done after the exchange
                yield from table.to_batches()
                table = table.slice(0, 0)
            held, rows = table.to_batches(), table.num_rows
            limit = max(MERGED_AT, 2 * rows)
        if rows:
            yield from merge(pa.Table.from_batches(held)).to_batches()

    return run


def gather(sent: DataFrame, program: HyperProgram, receiver: Side, parts: int | None = None) -> tuple[DataFrame, Column]:
    """(dst, inbox fields), one row for each receiver, and whether a receiver heard anything, for use after a left join. With ``parts``,
    messages are dealt into so many partitions by receiver before anything is reduced; not for a ``merge``, which has passes of its own."""
    if parts is not None and program.merge is None:
        sent = sent.repartition(parts, "dst")
    if program.combine is not None:
        return program.combine(sent), F.col("inbox").isNotNull()
    if program.merge is not None:
        # the first pass works on what each task has, so the exchange moves a row for each receiver and task at most
        part = sent.mapInArrow(_merging(program.merge, False), sent.schema)
        sent = part.repartition("dst").sortWithinPartitions("dst").mapInArrow(_merging(program.merge, True), sent.schema)
    if receiver.inbox is None:
        return sent.groupBy("dst").agg(program.reduce(F.col("message")).alias("inbox")), F.col("inbox").isNotNull()
    return sent.groupBy("dst").agg(F.lit(True).alias("heard_"), *(v.alias(k) for k, v in receiver.inbox().items())), F.col("heard_").isNotNull()


def even(elements: int, incidences: int, most: int, parts: int, hub_incidences: int = HUB_INCIDENCES) -> bool:
    """Whether no element has far more incidences than others, of which the largest number is ``most``, and tasks have few for any one of them."""
    return most <= max(hub_incidences, incidences // parts) and incidences <= REPEATED * parts * elements


def messages(active: DataFrame, incidence: Incidence, sender: Side, superstep: int = 0, ids: list[int] | None = None) -> DataFrame:
    """(dst, message fields) of the active elements."""
    speaking = active.filter(sender.can_send())
    if sender.to is None:
        said = _named(sender.message(F.lit(superstep)), "message")
        sent = incidence.deliver(speaking.select(F.col("id").alias("src"), *(v.alias(k) for k, v in said.items())), ids)
        return sent.select("dst", *said)
    each = incidence.deliver(speaking.withColumns({"src": F.col("id")}), ids)
    said = _named(sender.message(F.lit(superstep)), "message")
    return each.select(sender.to().alias("dst"), *(v.alias(k) for k, v in said.items())).filter("dst IS NOT NULL")


def _received(joined: DataFrame, receiver: Side, heard: Column, columns: list[str]) -> DataFrame:
    """``columns`` of elements beside their inboxes, with the new values of fields and the active mark."""
    new = {name: F.when(heard, value).otherwise(F.col(name)) for name, value in _named(receiver.apply(), "value").items()}
    new["active"] = F.col("active") | (heard & F.coalesce(receiver.activate(), F.lit(False)))
    return joined.withColumns(new).select(*columns)


def half_step(senders: DataFrame, incidence: Incidence, receivers: DataFrame, sender: Side, receiver: Side, program: HyperProgram, superstep: int = 0, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Senders and receivers after the active senders have sent along ``incidence``; ``parts`` as for ``gather``."""
    inbox, heard = gather(messages(senders.filter("active"), incidence, sender, superstep), program, receiver, parts)
    received = _received(receivers.join(inbox.withColumnRenamed("dst", "id"), "id", "left"), receiver, heard, receivers.columns)
    return _sent(senders, sender), received


def _sent(senders: DataFrame, sender: Side, bound: float | None = None) -> DataFrame:
    """Senders afterwards. Those that are due later have not sent."""
    now = F.lit(True) if bound is None else sender.due() < bound
    after = {} if sender.after_send is None else _named(sender.after_send(), "value")
    after = {name: F.when(F.col("active") & now & sender.can_send(), value).otherwise(F.col(name)) for name, value in after.items()}
    return senders.withColumns({**after, "active": F.col("active") & (~now | F.lit(sender.stays_active))})


def initial_state(elements: DataFrame | None, incidence: DataFrame, side: Side) -> DataFrame:
    """id, weight, degree, high, aggregates around, fields and active of every element; ``incidence`` is (src, dst) with these as senders.
    Without ``elements`` they are the senders."""
    around = {"degree": F.count("*"), "high": F.max("dst"), **side.around()}
    out = incidence.groupBy(F.col("src").alias("id")).agg(*(v.alias(k) for k, v in around.items()))
    if elements is None:
        state = out.select("id", F.lit(None).cast("string").alias("weight"), *around).sortWithinPartitions("id")
    else:
        state = elements.join(out, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return state.withColumns({**side.starting(), "active": side.starts_active()})


class _Population:
    """The elements of one side while a program runs: a full state, and while few are active the changes since and the active ones."""

    def __init__(self, elements: DataFrame | None, incidence: DataFrame, side: Side) -> None:
        self.side = side
        self.base = _Kept(initial_state(elements, incidence, side), degrees=F.sum("degree"), most=F.max("degree"), active=F.count_if("active"), least=F.min("id"), largest=F.max("id"))
        self.small = 0 <= self.base.sums["least"] and max(self.base.sums["largest"], self.base.sums["degrees"]) < SMALL
        self.total, self.active = self.base.sums["rows"], self.base.sums["active"]
        self.degrees, self.most = self.base.sums["degrees"], self.base.sums["most"]
        self.table: DataFrame | None = self.base.table  # full state; None while only changes are written
        self.changes: list[_Kept] = []
        self.retired: list[_Kept] = []  # merged into others, but active elements may still be read from them
        self.front: DataFrame | None = None  # active elements, while only changes are written
        self.fronts: list[_Kept] = []  # the table that they are in, if it is of their own
        self.first: float | None = None  # when the first of them is due, once it is known

    @property
    def columns(self) -> list[str]:
        return self.base.table.columns

    def even(self, parts: int, hub_incidences: int) -> bool:
        return even(self.total, self.degrees, self.most, parts, hub_incidences)

    def speakers(self) -> DataFrame:
        return self.front if self.table is None else self.table.filter("active")

    def whole(self) -> DataFrame:
        """The full state, put together if need be."""
        if self.table is not None:
            return self.table
        found = self.base.table.select("id", self._packed().alias("base_"))
        state = self._with_changes(found).drop("active").join(self.front.select("id", F.lit(True).alias("active")), "id", "left")
        return state.withColumn("active", F.coalesce("active", F.lit(False))).select(*self.columns)

    def _packed(self) -> Column:
        return F.struct(*(c for c in self.columns if c != "id"))

    def _with_changes(self, found: DataFrame) -> DataFrame:
        """``found`` has id and the packed state ``base_``; of several changes the last one holds."""
        states = []
        for k, change in enumerate(reversed(self.changes)):
            found = found.join(change.table.select("id", self._packed().alias(f"change_{k}_")), "id", "left")
            states.append(F.col(f"change_{k}_"))
        found = found.withColumn("base_", F.coalesce(*states, F.col("base_")))
        rest = [c for c in found.columns if not (c.startswith("change_") and c.endswith("_")) and c != "base_"]
        return found.select(*rest, *(F.col("base_")[c].alias(c) for c in self.columns if c != "id"))

    def narrow(self) -> None:
        """From now on only changes are written."""
        if self.table is None:
            return
        if self.sent and self.side.after_send is not None:
            self._keep(self.table)
        self.front, self.table = self.table.filter("active"), None
        self.base.hold()

    def widen(self) -> None:
        """Full states again."""
        if self.table is None:
            self._keep(self.whole())
            for change in (*self.changes, *self.retired, *self.fronts):
                change.drop()
            self.changes, self.retired, self.fronts, self.front = [], [], [], None

    #: Whether the side has sent since its state was written, and whether the active ones are read from several tables of changes.
    sent = quiet = False

    def _keep(self, table: DataFrame) -> int:
        before, self.base = self.base, _Kept(table, active=F.count_if("active"))
        before.drop()
        self.table, self.sent, self.first = self.base.table, False, None
        self.active = self.base.sums["active"]
        return self.total

    def hear_all(self, inbox: DataFrame, heard: Column) -> int:
        """Rows written: all."""
        return self._keep(_received(self.table.join(inbox.withColumnRenamed("dst", "id"), "id", "left"), self.side, heard, self.columns))

    def hear_few(self, inbox: DataFrame, heard: Column) -> int:
        """Rows written: those that changed or became active, and at times all changes merged."""
        inbox = inbox.withColumnRenamed("dst", "id")
        # packed after the join, as only few rows are found
        base = {c: f"base_{c}_" for c in self.columns if c != "id"}
        found = inbox.join(self.base.table.withColumnsRenamed(base), "id").withColumn("base_", F.struct(*(F.col(x).alias(c) for c, x in base.items()))).drop(*base.values())
        found = self._with_changes(found).drop("active")
        if self.active:
            found = found.join(self.front.select("id", F.lit(True).alias("active")), "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
        else:
            found = found.withColumn("active", F.lit(False))
        fields = list(_named(self.side.apply(), "value"))
        before = found.withColumns({"before_": F.struct(*fields), "was_": F.col("active")})
        new = _received(before, self.side, heard, [*self.columns, "before_", "was_"])
        changed = _Kept(new.filter(F.col("active") | ~F.struct(*fields).eqNullSafe(F.col("before_"))).drop("before_"), active=F.count_if("active"), was=F.count_if("was_"))
        self.quiet = self.active > 0
        self.first = None
        if self.quiet:  # those that were active and heard nothing stay so; in a table of their own, or each step would look through all before it
            quiet = self.front.join(changed.table.select("id"), "id", "left_anti").select(*self.columns)
            before, self.fronts = self.fronts, [_Kept(quiet.unionByName(changed.table.filter("active").select(*self.columns)))]
            self.front, self.quiet = self.fronts[0].table, False
        else:
            before, self.fronts = self.fronts, []
            self.front = changed.table.filter("active").select(*self.columns)
        for front in before:
            front.drop()
        self.active += changed.sums["active"] - changed.sums["was"]
        return self._add(changed)

    def _add(self, change: _Kept) -> int:
        if not (written := change.sums["rows"]):
            return 0
        self.changes.append(change)
        if sum(c.sums["rows"] for c in self.changes) > GROWTH * self.total:
            self.widen()
            self.front, self.table = self.table.filter("active"), None
            self.base.hold()
            return written + self.total
        if len(self.changes) > DEEPEST:
            parts = [c.table.select("id", F.lit(k).alias("turn_"), self._packed().alias("state_")) for k, c in enumerate(self.changes)]
            last = fold(DataFrame.unionByName, parts).groupBy("id").agg(F.max_by("state_", "turn_").alias("state_"))
            merged = _Kept(last.select(*(F.col("state_")[c].alias(c) if c != "id" else F.col("id") for c in self.columns)))
            # the active ones are read from the table that was written last, so that one stays, and if some heard nothing, from any
            self.retired += self.changes[:-1]
            if not self.quiet:
                for change in self.retired:
                    change.drop()
                self.retired = []
            self.changes = [merged, self.changes[-1]]
            return written + merged.sums["rows"]
        return written

    def due(self) -> float | None:
        """When the first of the active ones is due."""
        if self.first is None and self.active:
            self.first = self.speakers().agg(F.min(self.side.due())).collect()[0][0]
        return self.first if self.active else None

    def has_sent(self, bound: float | None = None) -> int:
        """Active elements have sent, if they were due. Rows written."""
        waiting = 0 if bound is None else self.speakers().filter(self.side.due() >= bound).count()
        self.first = None
        if self.table is not None:
            self.table, self.sent = _sent(self.table, self.side, bound), True
            self.active = self.active if self.side.stays_active else waiting
            return 0
        written = 0
        front = self.front if bound is None else self.front.filter(self.side.due() < bound)
        if self.side.after_send is not None and self.active > waiting:
            written = self._add(_Kept(_sent(front, self.side)))
        self.front, self.active = self.front.filter(F.lit(False) if bound is None else self.side.due() >= bound), waiting
        return written


def run(graph: Hypergraph, program: HyperProgram, unique_side: str = EDGE, limit: int | None = None, trace: bool = False, hub_incidences: int = HUB_INCIDENCES, sparse: float | None = None, count_messages: bool = False) -> Result:
    """Run supersteps until nothing is active or ``limit`` of them are done; programs that never settle need a limit.

    A superstep is two jobs, each of which checkpoints the side that received, all of it or what changed, and counts its active elements on
    the way. Checkpoints that are no longer needed are deleted, and the incidences are given back at the end. Only changes are written while
    less than ``sparse`` of all elements are active, and again until twice as many are; not by programs whose elements stay active. Without
    it, that is ``SPARSE`` from ``MANY_ELEMENTS`` on, and never with fewer.
    """
    if unique_side not in (VERTEX, EDGE):
        raise ValueError(f"unique_side must be {VERTEX!r} or {EDGE!r}")
    if program.needs_limit and limit is None:
        raise ValueError("this program never settles: give a superstep limit")
    spark = graph.v2e.sparkSession
    shared_root(spark)
    v2e = graph.v2e.withColumnsRenamed({"v": "src", "e": "dst"})
    e2v = graph.e2v.withColumnsRenamed({"e": "src", "v": "dst"})
    v, e = ((None if graph.mirrored and side in graph.ends else x, inc, does) for side, x, inc, does in (("v", graph.vertices, v2e, program.vertex), ("e", graph.hyperedges, e2v, program.edge)))
    plain = graph.mirrored and {"v", "e"} <= set(graph.ends)  # all incidences have elements at both ends
    parts = graph.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    settles = not (program.vertex.stays_active or program.edge.stays_active)
    rows, done, settled, held, written, n_sent = [], 0, False, [], [], []
    with _fixed_plans(spark, parts):
        try:
            both = []
            for elements, inc, side in (v, e) if unique_side == EDGE else (e, v):
                inc = inc if side.to is not None or side.around() else inc.select("src", "dst")
                total = both[0].degrees if both and plain else inc.count()
                # incidences are dealt first, and degrees come from them as they lie; hubs are found without counting for every element
                hubs = frequent(inc.select(F.col("src").alias("id")), ["id"], max(hub_incidences, total // parts)) if total > hub_incidences else inc.limit(0)
                held.append(Incidence.of(inc, hubs.withColumnsRenamed({"n": "degree"}), total, parts, hub_incidences, graph.buckets > 0))
                both.append(_Population(elements, held[-1].rows(), side))
            rep, uni = both
            if program.combine_small is not None and rep.small and uni.small:
                program = replace(program, combine=program.combine_small)
            narrow = False
            if sparse is None:
                sparse = SPARSE if rep.total + uni.total >= MANY_ELEMENTS else 0.0
            while limit is None or done < limit:
                counts, wrote, said, bound = [], 0, 0, None
                if program.bucket is not None and (first := [t for t in (rep.due(), uni.due()) if t is not None]):
                    bound = (min(first) // program.bucket + 1) * program.bucket
                for sender, receiver, incidence in ((rep, uni, held[0]), (uni, rep, held[1])):
                    share = (rep.active + uni.active) / max(1, rep.total + uni.total)
                    if settles and share < (2 * sparse if narrow else sparse):
                        narrow = True
                        rep.narrow()
                        uni.narrow()
                    else:
                        narrow = False
                        rep.widen()
                        uni.widen()
                    counts.append(sender.active)
                    if sender.active and (bound is None or sender.due() < bound):
                        active = sender.speakers() if bound is None else sender.speakers().filter(sender.side.due() < bound)
                        ids = [r["id"] for r in active.select("id").collect()] if narrow and sender.active <= FEW_SENDERS else None
                        sent = messages(active, incidence, sender.side, done, ids)
                        if count_messages:
                            sent = sent.observe(seen := Observation(), F.count("*").alias("n"))
                        # a receiver gets as many messages as it could send, if they go to neighbours and incidences to both sides are the same
                        deal = graph.mirrored and sender.side.to is None and receiver.even(parts, hub_incidences)
                        inbox, heard = gather(sent, program, receiver.side, parts if deal else None)
                        wrote += receiver.hear_few(inbox, heard) if narrow else receiver.hear_all(inbox, heard)
                        said += seen.get["n"] if count_messages else 0
                        wrote += sender.has_sent(bound)
                rows.append((done, counts[0], rep.total, counts[1], uni.total))
                written.append(wrote)
                n_sent.append(said)
                done += 1
                if not (rep.active or uni.active):
                    settled = True
                    break
            replicas, uniques = rep.whole(), uni.whole()
            for population in both:
                population.base.give_back()
        finally:
            for incidence in held:
                incidence.release()
    of = {VERTEX: (uniques, uni) if unique_side == VERTEX else (replicas, rep), EDGE: (uniques, uni) if unique_side == EDGE else (replicas, rep)}
    shown = {side: table.select("id", *population.side.starting(), "active") for side, (table, population) in of.items()}
    counts = spark.createDataFrame(rows, "superstep int, active_replicas long, total_replicas long, active_uniques long, total_uniques long") if trace else None
    return Result(shown[VERTEX], shown[EDGE], done, settled, counts, tuple(written), tuple(n_sent) if count_messages else ())

"""Window panes with revisions: a stateful aggregation whose snapshots, one for each batch, are differenced.

Rows arrive in batches.  A pane is a kind and an hour of event time; its totals are the state of a
streaming aggregation over a RocksDB store, and the watermark forgets panes that are closed.  The
store's changes bring each batch's snapshot out of the one before; a snapshot is a table, and is
differenced with that of the batch before: a pane whose totals changed after it was emitted gives a
`retract` of the old and a `replace` by the new totals.  Changes of any number of batches are read at
once, since each opening of a store costs an executor memory that it doesn't get back.
What was emitted, and in which batch, is in a table of its own (lifecycle), a folder for each batch.
Rows of closed panes are written as `late`, one by one, and never reach the state.

Everything lies in a new folder under spark.checkpoint.dir: the batches, the stream's feed and
checkpoint, records and lifecycle.  A batch's records and lifecycle are overwritten as a whole, so a
repeated step changes nothing.  Rows go through scans, a shuffle by click_id and the aggregation,
which sums up before it shuffles; the driver sees one number, the largest event time, for each batch.
State and lifecycle have as many rows as there are panes, whatever the number of clicks.

Defined cases: rows without ts are dropped; of rows that share a click_id the least by (ts,
arrived_at, kind, value), nulls first, stays; a null click_id is one id, never delayed; a null
arrived_at is that of the ts; null, infinite and NaN values are worth 0 cents; a null kind is the
kind `none`, with those that are called so; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions
from .sql_pieces import crc32, crc_table

BATCHES = 10
HOUR = 3_600_000_000  #: microseconds
DUE_HOURS, CLOSED_HOURS = 12, 48
#: State is as small as the number of panes, so its partitions don't follow the session's.
STATE_PARTITIONS = 16
#: A stream's watermark starts at 1970, and event times may lie before it: the stream sees them 12,000 years later.
SHIFT_HOURS = 12_000 * 8_766
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
LIFECYCLE = "hour long, kind string, batch long"
PANES = "hour long, kind string, n_rows long, cents long"
CHANGES = f"own long, gone boolean, {PANES}"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone; no zone takes part."""
    ts = ts.cast("timestamp_ntz")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * (24 * HOUR) + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000 + second


def batches(clicks: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """Each click once: click_id, kind, cents, at (event time in microseconds), hour, batch."""
    rows = clicks.select("click_id", F.struct("ts", F.coalesce("arrived_at", "ts").alias("arrived"), "kind", "value").alias("r")).where("r.ts IS NOT NULL")
    rows = rows.groupBy("click_id").agg(F.min("r").alias("r"))
    day = F.unix_date(F.col("r.arrived").cast("date")).cast("long")
    turn = F.pmod(day, F.lit(n_batches))
    delay = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    value = F.col("r.value")
    cents = F.when(F.abs(value) < F.lit(float("inf")), F.floor(value * 100 + 0.5).cast("long"))
    rows = rows.select(
        "click_id", F.coalesce("r.kind", F.lit("none")).alias("kind"), F.coalesce(cents, F.lit(0).cast("long")).alias("cents"),
        (micros(F.col("r.ts")) - (day - turn) * (24 * HOUR)).alias("at"), F.least(F.lit(n_batches - 1), turn + delay).cast("int").alias("batch"),
    )
    return rows.withColumn("hour", F.expr(f"(at - pmod(at, {HOUR})) div {HOUR}"))


def _reached(hours: int, mark: int | None) -> Column:
    """Whether the mark is so many hours beyond the end of the row's pane."""
    return F.lit(False) if mark is None else (F.col("hour") + 1 + hours) * HOUR <= F.lit(mark)


class PaneStream:
    """A stream of batches, with its folder; advance() takes the next one, settle() writes the records of those since the last call."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.mark, self.turn = root, None, 0
        self.open: list[tuple[int, int | None, int]] = []  # of batches not settled: turn, mark before it, the stream's own last batch
        self.settled = -1  # of the stream's own batches
        # A session of its own, so that the store's provider and partitions are set for this stream alone.
        self.session = spark.newSession()
        for name, value in {
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each start is a run of its own, whose stores would else stay on executors' disks
            "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # for settle()
            "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # file systems keep checksums of their own
            "spark.sql.streaming.noDataMicroBatches.enabled": "false",
            "spark.sql.shuffle.partitions": str(min(STATE_PARTITIONS, partitions(spark))),
        }.items():
            self.session.conf.set(name, value)

    def advance(self, rows: DataFrame) -> None:
        """rows of this batch: click_id, kind, cents, at, hour.  Writes those that are late, and adds the others to the state."""
        feed, seen = f"{self.root}/feed", Observation()
        rows.select("kind", "cents", "at").observe(seen, F.max("at").alias("top")).write.mode("append").parquet(feed)
        self._run(feed)
        self._late(rows).select(*self._fields(self.turn)).write.mode("overwrite").parquet(f"{self.root}/late/of={self.turn}")
        self.open.append((self.turn, self.mark, self._committed()))
        top = seen.get["top"]
        self.mark = top if self.mark is None else self.mark if top is None else max(self.mark, top)
        self.turn += 1

    def settle(self, last: bool = False) -> None:
        """Writes snapshots, records and lifecycle of the batches since the last call, one after the other.  last: the stream ends with them."""
        if not self.open:
            return
        changes = f"{self.root}/changes/of={self.open[-1][0]}"
        self._changes(self.open[-1][2]).coalesce(STATE_PARTITIONS).write.mode("overwrite").parquet(changes)
        final = self.open[-1][0]
        for turn, mark, done in self.open:
            own = self.session.read.schema(CHANGES).parquet(changes).where(F.col("own").between(self.settled + 1, done))
            self._snapshot(own, turn).coalesce(STATE_PARTITIONS).write.mode("overwrite").parquet(self._state_at(turn))
            # There are no more records than panes: few files hold them.
            self._records(turn, mark, last and turn == final).select(*self._fields(turn)).coalesce(STATE_PARTITIONS).write.mode("overwrite").parquet(f"{self.root}/records/of={turn}")
            emitted = self.session.read.schema(RECORDS).parquet(f"{self.root}/records/of={turn}").where("record = 'emit'")
            emitted.select("hour", "kind", "batch").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lifecycle/of={turn}")
            self.settled = done
        self.open = []

    @staticmethod
    def _fields(turn: int) -> list:
        return [F.lit(turn).cast("long").alias("batch"), *[c.split()[0] for c in RECORDS.split(", ")[1:]]]

    def records(self, session: SparkSession | None = None) -> DataFrame:
        """All records of batches that are settled."""
        paths = [f"{self.root}/{kind}/of={t}" for kind in ("late", "records") for t in range(self.turn - len(self.open))]
        return (session or self.session).read.schema(RECORDS).parquet(*paths)

    def _run(self, feed: str) -> None:
        """Starts the query on its checkpoint, lets it take what is new in the feed, and waits for its end."""
        event = F.timestamp_micros(F.col("at") + SHIFT_HOURS * HOUR)
        rows = self.session.readStream.schema("kind string, cents long, at long").parquet(feed).select("kind", "cents", event.alias("event"))
        rows = rows.withWatermark("event", f"{CLOSED_HOURS} hours")
        if self.mark is not None:  # a row of a closed pane is late
            end = F.timestamp_micros(F.lit(self.mark - self.mark % HOUR + (SHIFT_HOURS - CLOSED_HOURS) * HOUR))
            rows = rows.where(F.col("event") >= end)
        panes = rows.groupBy(F.window("event", "1 hour"), "kind").agg(F.count("*").alias("n_rows"), F.sum("cents").alias("cents"))
        writer = panes.writeStream.format("noop").outputMode("update").option("checkpointLocation", self._checkpoint).trigger(availableNow=True)
        query = writer.start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    @property
    def _checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def _committed(self) -> int:
        """The last of the stream's own batches that it has committed, or -1."""
        jvm = self.session.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self._checkpoint}/commits")
        fs = where.getFileSystem(self.session.sparkContext._jsc.hadoopConfiguration())
        return max([int(n) for n in (f.getPath().getName() for f in fs.listStatus(where)) if n.isdigit()] if fs.exists(where) else [], default=-1)

    def _changes(self, done: int) -> DataFrame:
        """What the stream's own batches after the last settled one, up to done, changed in the state."""
        if done == self.settled:
            return self.session.createDataFrame([], CHANGES)
        feed = self.session.read.format("statestore").option("readChangeFeed", True)
        state = feed.option("changeStartBatchId", self.settled + 1).option("changeEndBatchId", done).load(self._checkpoint)
        hour = F.expr(f"unix_micros(key.window.start) div {HOUR} - {SHIFT_HOURS}")
        gone = F.col("change_type") == "delete"
        return state.select(F.col("batch_id").alias("own"), gone.alias("gone"), hour.alias("hour"), F.col("key.kind").alias("kind"), F.col("value.count").alias("n_rows"), F.col("value.sum").alias("cents"))

    def _snapshot(self, changes: DataFrame, turn: int) -> DataFrame:
        """The panes after a batch: those of the batch before, with its changes.  A pane's rows only grow in number, until it is gone."""
        panes = changes.select("hour", "kind", "n_rows", "cents", "gone")
        if turn:
            panes = panes.union(self.session.read.schema(PANES).parquet(self._state_at(turn - 1)).withColumn("gone", F.lit(False)))
        panes = panes.groupBy("hour", "kind").agg(F.max(F.struct("n_rows", "cents")).alias("total"), F.max("gone").alias("gone"))
        return panes.where(~F.col("gone")).select("hour", "kind", "total.n_rows", "total.cents")

    def _state_at(self, turn: int) -> str:
        return f"{self.root}/panes/of={turn}"

    def _records(self, turn: int, mark: int | None, last: bool) -> DataFrame:
        """The snapshots before and after this batch, and what was emitted, meet by pane in one aggregation."""
        read, turns = self.session.read, range(turn)
        names = {"old_rows": None, "old_cents": None, "new_rows": None, "new_cents": None, "emitted": None}
        part = lambda df, **has: df.select("hour", "kind", *[(F.col(has[n]) if n in has else F.lit(None)).cast("long").alias(n) for n in names])
        parts = [part(read.schema(PANES).parquet(self._state_at(turn)), new_rows="n_rows", new_cents="cents")]
        if turns:
            parts.append(part(read.schema(PANES).parquet(self._state_at(turn - 1)), old_rows="n_rows", old_cents="cents"))
            parts.append(part(read.schema(LIFECYCLE).parquet(*[f"{self.root}/lifecycle/of={t}" for t in turns]), emitted="batch"))
        panes = reduce(DataFrame.union, parts).groupBy("hour", "kind").agg(*[F.max(n).alias(n) for n in names])
        old, new = (F.struct(F.col(f"{w}_rows").alias("n_rows"), F.col(f"{w}_cents").alias("cents")) for w in ("old", "new"))
        total = F.when(F.col("new_rows").isNotNull(), new).otherwise(old)
        held = F.coalesce("new_rows", "old_rows").isNotNull()  # else it is closed and forgotten
        due, out = _reached(DUE_HOURS, mark), F.col("emitted").isNotNull()
        changed = out & (F.col("new_rows") > F.col("old_rows"))  # totals change with rows only
        said = [(held & ~out & due, "emit", total), (changed, "retract", old), (changed, "replace", new)]
        if last:
            said.append((held & ~out & ~due, "final", total))
        rows = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(record).alias("record"), of.alias("total"))) for cond, record, of in said]))
        rows = panes.select("hour", "kind", F.explode(rows).alias("r"))
        return rows.select("hour", F.lit(-1).cast("long").alias("click_id"), "r.total.n_rows", "r.total.cents", "r.record", "kind")

    def _late(self, rows: DataFrame) -> DataFrame:
        rows = rows.where(_reached(CLOSED_HOURS, self.mark))
        return rows.select("hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind")


def revisions(clicks: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """All records of all batches: batch, hour, click_id, n_rows, cents, record, kind."""
    spark = clicks.sparkSession
    root = new_path(spark, "panes")
    batches(clicks, n_batches).write.partitionBy("batch").parquet(f"{root}/batches")
    stream = PaneStream(spark, root)
    schema = "click_id long, kind string, cents long, at long, hour long, batch int"
    arrived = stream.session.read.schema(schema).parquet(f"{root}/batches")
    for turn in range(n_batches):
        stream.advance(arrived.where(F.col("batch") == turn))
    stream.settle(last=True)
    return stream.records(spark)


SQL = f"""
WITH {crc_table()},
once AS (
  SELECT click_id, ts, coalesce(arrived_at, ts) AS arrived, coalesce(kind, 'none') AS kind,
         CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents
  FROM clicks WHERE ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, coalesce(arrived_at, ts), kind NULLS FIRST, value NULLS FIRST) = 1
), days AS (
  SELECT *, date_diff('day', DATE '1970-01-01', arrived::DATE) AS d, CASE WHEN click_id IS NULL THEN 0 ELSE {crc32("click_id::VARCHAR")} END AS crc
  FROM once, crc_steps
), timed AS (
  SELECT click_id, kind, cents, (d % {BATCHES} + {BATCHES}) % {BATCHES} AS q, crc, epoch_us(ts) - (d - (d % {BATCHES} + {BATCHES}) % {BATCHES}) * {24 * HOUR} AS event FROM days
), placed AS (
  SELECT click_id, kind, cents, event, (event - (event % {HOUR} + {HOUR}) % {HOUR}) // {HOUR} AS hour, least({BATCHES - 1}, q + greatest(0, crc % 30 - 23))::BIGINT AS batch FROM timed
), marks AS (
  SELECT b.batch, (SELECT max(event) FROM placed p WHERE p.batch < b.batch) AS mark FROM (SELECT unnest(range({BATCHES}))::BIGINT AS batch) b
), panes AS (
  SELECT hour, kind,
         (SELECT min(batch) FROM marks WHERE mark >= (hour + 1 + {DUE_HOURS}) * {HOUR}) AS due,
         coalesce((SELECT min(batch) FROM marks WHERE mark >= (hour + 1 + {CLOSED_HOURS}) * {HOUR}), {BATCHES}) AS closed
  FROM (SELECT DISTINCT hour, kind FROM placed)
), added AS (
  SELECT p.hour, p.kind, p.due, p.closed, r.batch, count(*) AS n, sum(r.cents)::BIGINT AS c
  FROM panes p JOIN placed r USING (hour, kind) WHERE r.batch < p.closed GROUP BY ALL
), grown AS (
  SELECT *, sum(n) OVER w AS n_rows, sum(c) OVER w AS cents, min(batch) OVER (PARTITION BY hour, kind) AS first
  FROM added WINDOW w AS (PARTITION BY hour, kind ORDER BY batch)
), turns AS (SELECT *, greatest(due, first) AS emitted FROM grown WHERE due IS NOT NULL),
found AS (
  SELECT r.batch, r.hour, r.click_id, 1 AS n_rows, r.cents, 'late' AS record, r.kind FROM placed r JOIN panes p USING (hour, kind) WHERE r.batch >= p.closed
  UNION ALL SELECT emitted, hour, -1, arg_max(n_rows, batch), arg_max(cents, batch), 'emit', kind FROM turns WHERE batch <= emitted GROUP BY emitted, hour, kind
  UNION ALL SELECT batch, hour, -1, n_rows - n, cents - c, 'retract', kind FROM turns WHERE batch > emitted
  UNION ALL SELECT batch, hour, -1, n_rows, cents, 'replace', kind FROM turns WHERE batch > emitted
  UNION ALL SELECT {BATCHES - 1}, hour, -1, max(n_rows), arg_max(cents, batch), 'final', kind FROM grown WHERE due IS NULL GROUP BY hour, kind
)
SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM found
"""

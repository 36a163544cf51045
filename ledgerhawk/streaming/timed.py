"""Stream processors whose results follow event time.

Files and topics bring events in any order.  ``EventTimeOrder`` keeps a key's
events in list state until the watermark has passed them, then hands them on in
(time, id) order; a result therefore depends on the events alone and equals the
batch twin.  Timers are event-time ones: one for a key's earliest waiting event
and one for the end of its state's life, so state goes when it has expired
although its key is never seen again.  An event at or before the watermark
cannot be put in order any more; it leaves as a ``late`` row (side output).

State is kept by the state store per key in typed states (list, map, value),
never as one blob, and a micro-batch is worked on frame by frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.credit import INITIAL_LIMIT, INITIAL_TRUST, step
from .state import CALLS_PER_HOUR, ERRORS_PER_HOUR, RESPONSE_HISTORY, SLOW_FACTOR, SLOW_SECONDS

HOUR_US = 3_600_000_000
#: How long an hour's counters stay, and response times after the last one.
COUNTERS_LIVE_US = 24 * HOUR_US
RESPONSES_LIVE_US = HOUR_US

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Typed states need the RocksDB state store; a session that names another
    provider keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKSDB)


def _event_us(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


class EventTimeOrder(StatefulProcessor):
    """Base: input rows need ``event_us`` (event time, microseconds) and an id;
    subclasses say what waits (``FIELDS``), how due events move their state
    (``fold``) and until when that state lives (``expire``)."""

    FIELDS: list[tuple[str, str]] = []
    ID = "event_id"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        names = [("event_us", "long"), (self.ID, "long"), *self.FIELDS]
        self.names = [n for n, _ in names]
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in names))
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, key, due: list[tuple]) -> list[tuple]:
        """Output rows of events in order."""
        raise NotImplementedError

    def expire(self, watermark_us: int) -> int | None:
        """Drop what is past its life; time (microseconds) of the next look, if any."""
        raise NotImplementedError

    def late(self, key, row: tuple) -> tuple:
        raise NotImplementedError

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for pdf in rows:
            late, new = [], []
            for row in pdf[self.names].itertuples(index=False, name=None):
                row = tuple(None if v is None or v != v else v for v in row)
                (late if row[0] // 1000 <= passed else new).append(row)
            if new:
                self.waiting.appendList(new)
                least = min(r[0] for r in new) // 1000
                first = least if first is None else min(first, least)
            if late:
                yield self.frame([self.late(key, r) for r in late])
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] // 1000 <= passed), key=lambda r: r[:2])
        if due:
            rest = [r for r in held if r[0] // 1000 > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest) // 1000)
            else:
                self.waiting.clear()
            out = self.fold(key, due)
            if out:
                yield self.frame(out)
        again = self.expire(passed * 1000)
        if again is not None and again // 1000 > passed:
            self.handle.registerTimer(again // 1000)

    def close(self) -> None:
        pass


# --- log anomalies ---------------------------------------------------------------

ANOMALY_OUT = "kind string, event_id long, user_id string, ts timestamp, anomaly_type string, severity string"


class Anomalies(EventTimeOrder):
    """Counters per (user, hour) in map state, the latest response times in
    list state; the same rules as ``state.anomalies``."""

    FIELDS = [("status_code", "int"), ("response_time", "double")]

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", "hour long", "calls long, errors long")
        self.recent = handle.getListState("recent", "us long, response_time double")

    def fold(self, key, due: list[tuple]) -> list[tuple]:
        recent = list(self.recent.get()) if self.recent.exists() else []
        hours: dict[int, list[int]] = {}
        out = []
        for us, event, status, rt in due:
            hour = us // HOUR_US
            if hour not in hours:
                hours[hour] = list(self.hours.getValue((hour,)) or (0, 0))
            n = hours[hour]
            n[0] += 1
            n[1] += status is not None and status >= 400
            if rt is not None and rt > 0:
                if recent and us - recent[-1][0] >= RESPONSES_LIVE_US:
                    recent = []
                recent = (recent + [(us, float(rt))])[-RESPONSE_HISTORY:]
            found = []
            if status is not None and status >= 500 and n[1] > ERRORS_PER_HOUR:
                found.append(("high_error_rate", "medium"))
            if rt is not None and rt > SLOW_SECONDS and rt > SLOW_FACTOR * sum(r for _, r in recent) / len(recent):
                found.append(("unusual_response_time", "low"))
            if n[0] > CALLS_PER_HOUR:
                found.append(("high_api_frequency", "high"))
            out += [("anomaly", event, key[0], us, kind, severity) for kind, severity in found]
        for hour, n in hours.items():
            self.hours.updateValue((hour,), tuple(n))
        if recent:
            self.recent.put(recent)
        return out

    def expire(self, watermark_us: int) -> int | None:
        ends = []
        if self.hours.exists():
            for (hour,) in list(self.hours.keys()):
                end = (hour + 1) * HOUR_US + COUNTERS_LIVE_US
                if end <= watermark_us:
                    self.hours.removeKey((hour,))
                else:
                    ends.append(end)
        if self.recent.exists():
            end = list(self.recent.get())[-1][0] + RESPONSES_LIVE_US
            if end <= watermark_us:
                self.recent.clear()
            else:
                ends.append(end)
        return min(ends, default=None)

    def late(self, key, row: tuple) -> tuple:
        return "late", row[1], key[0], row[0], None, None

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["kind", "event_id", "user_id", "ts", "anomaly_type", "severity"])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        return out


def anomaly_stream(logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Anomaly rows (kind ``anomaly``) and events that came after the watermark
    (kind ``late``) of a stream of log rows (event_id, user_id, ts,
    status_code, response_time).  Rows without a user or a time have no
    anomalies and do not enter."""
    use_rocksdb(logs.sparkSession)
    rows = logs.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select("user_id", F.col("event_id").cast("long").alias("event_id"), _event_us("ts").alias("event_us"),
                       F.col("status_code").cast("int").alias("status_code"), F.col("response_time").cast("double").alias("response_time"))
    return rows.groupBy("user_id").transformWithStateInPandas(Anomalies(), ANOMALY_OUT, "append", "eventTime")


# --- credit ----------------------------------------------------------------------

CREDIT_OUT = ("kind string, agency_id long, txn_id long, action string, old_limit double, new_limit double, "
              "utilized_credit double, trust_score double, status string")
#: An agency without a decision for this long starts anew.
CREDIT_LIVE_US = 365 * 24 * HOUR_US


class Credit(EventTimeOrder):
    """Limit, trust, utilised credit and status of an agency in value state;
    the same transition as the batch fold.  Initial rows seed known agencies."""

    FIELDS = [("risk", "double"), ("amount", "double"), ("chargeback_rate", "double")]
    ID = "txn_id"

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", "lim double, trust double, utilized double, status string, last_us long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.account.update((float(row["current_limit"]), float(row["trust_score"]), float(row["utilized_credit"]), "ACTIVE", 0))

    def fold(self, key, due: list[tuple]) -> list[tuple]:
        if self.account.exists():
            lim, trust, utilized, status, _ = self.account.get()
            s = {"limit": lim, "trust": trust, "utilized": utilized, "status": status}
        else:
            s = {"limit": INITIAL_LIMIT, "trust": INITIAL_TRUST, "utilized": 0.0, "status": "ACTIVE"}
        out = []
        for us, txn, risk, amount, chargeback in due:
            r = step(s, risk, amount, chargeback)
            out.append(("decision", int(key[0]), txn, r["action"], r["old_limit"], r["new_limit"], r["utilized_credit"],
                        r["trust_score"], r["status"]))
        self.account.update((s["limit"], s["trust"], s["utilized"], s["status"], due[-1][0]))
        return out

    def expire(self, watermark_us: int) -> int | None:
        if not self.account.exists():
            return None
        last = self.account.get()[4]
        if last and last + CREDIT_LIVE_US <= watermark_us:
            self.account.clear()
            return None
        return last + CREDIT_LIVE_US if last else None

    def late(self, key, row: tuple) -> tuple:
        return ("late", int(key[0]), row[1], *[None] * 6)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CREDIT_OUT.split(", ")])
        return out.astype({c: "float64" for c in ("old_limit", "new_limit", "utilized_credit", "trust_score")})


def credit_stream(decided: DataFrame, agencies: DataFrame, initial_states: DataFrame | None = None,
                  delay: str = "10 minutes") -> DataFrame:
    """Live credit decisions per agency, in event-time order.

    Rows without an agency, a transaction id, a time, a risk or an amount carry
    no decision and do not enter; a missing chargeback rate is 0.
    ``initial_states`` (agency_id, current_limit, trust_score,
    utilized_credit) seeds agencies that are known."""
    use_rocksdb(decided.sparkSession)
    need = ["agency_id", "txn_id", "ts", "overall_risk", "amount"]
    d = decided.dropna(subset=need).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    d = d.select(F.col("agency_id").cast("long").alias("agency_id"), F.col("txn_id").cast("long").alias("txn_id"), _event_us("ts").alias("event_us"),
                 F.col("overall_risk").cast("double").alias("risk"), F.col("amount").cast("double").alias("amount"))
    rates = agencies.select(F.col("agency_id").cast("long").alias("agency_id"), F.col("chargeback_rate").cast("double").alias("chargeback_rate"))
    d = d.join(rates, "agency_id", "left").withColumn("chargeback_rate", F.coalesce("chargeback_rate", F.lit(0.0)))
    seeds = None
    if initial_states is not None:
        seeds = initial_states.select(F.col("agency_id").cast("long").alias("agency_id"), F.col("current_limit").cast("double").alias("current_limit"),
                                      F.col("trust_score").cast("double").alias("trust_score"),
                                      F.col("utilized_credit").cast("double").alias("utilized_credit")).groupBy("agency_id")
    return d.groupBy("agency_id").transformWithStateInPandas(Credit(), CREDIT_OUT, "append", "eventTime", initialState=seeds)


# --- retention -------------------------------------------------------------------

class Retention:
    """One definition of how long rows are kept (E14): a row lives while its
    time is later than ``now - keep``.  ``of_table`` filters a table as of a
    moment, ``of_stream`` gives the watermark that makes a stream forget at
    the same moment, ``expired`` the rows that go."""

    def __init__(self, ts: str, hours: int):
        self.ts, self.hours = ts, hours

    def _lives(self, now):
        return F.col(self.ts) > now - F.expr(f"INTERVAL {self.hours} HOURS")

    def of_table(self, rows: DataFrame, now=None) -> DataFrame:
        """Rows alive at ``now`` (a column or literal; default: the table's
        last time).  A null time is never alive."""
        if now is None:
            last = rows.agg(F.max(self.ts).alias("_now"))
            return rows.crossJoin(F.broadcast(last)).where(self._lives(F.col("_now"))).drop("_now")
        return rows.where(self._lives(now))

    def of_stream(self, rows: DataFrame) -> DataFrame:
        """The stream with event times whose watermark trails by ``hours``."""
        return rows.withColumn(self.ts, F.col(self.ts).cast("timestamp")).withWatermark(self.ts, f"{self.hours} hours")


class History(StatefulProcessor):
    """Rows of a key that are still alive: list state, trimmed by event-time
    timers; every batch that changes a key emits how many are alive."""

    def __init__(self, hours: int):
        self.keep_us = hours * HOUR_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, amount double")

    def _trim(self, key, passed_ms: int) -> pd.DataFrame:
        held = list(self.rows.get()) if self.rows.exists() else []
        # the watermark trails the newest event by the time kept, so rows at or before it are dead
        alive = [r for r in held if r[0] // 1000 > passed_ms]
        if alive:
            self.rows.put(alive)
            self.handle.registerTimer(min(r[0] for r in alive) // 1000)
        elif held:
            self.rows.clear()
        return pd.DataFrame([(key[0], len(alive), sum(r[1] for r in alive))], columns=["key", "alive", "amount"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.rows.appendList([(int(u), float(a)) for u, a in zip(pdf["event_us"], pdf["amount"])])
        yield self._trim(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._trim(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_history(rows: DataFrame, key: str, amount: str, keep: Retention) -> DataFrame:
    """(key, alive, amount): rows of each key within the time kept, updated
    whenever it changes; the last row per key counts."""
    use_rocksdb(rows.sparkSession)
    d = keep.of_stream(rows.where(F.col(key).isNotNull() & F.col(keep.ts).isNotNull()))
    d = d.select(F.col(key).cast("string").alias("key"), _event_us(keep.ts).alias("event_us"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount"))
    return d.groupBy("key").transformWithStateInPandas(History(keep.hours), "key string, alive long, amount double", "update", "eventTime")


# --- live degrees ----------------------------------------------------------------

def live_degrees(events: DataFrame, source: str = "source_user", target: str = "target_entity") -> DataFrame:
    """Distinct neighbours per node of a stream of events (J21, L7).  New pairs
    are told from known ones per (node, neighbour), so a hub's neighbours are
    spread over all tasks, and only new pairs are counted.  Self-pairs and
    pairs with a null end are no relation."""
    e = events.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    ends = F.explode(F.array(F.struct(F.col(source).cast("string").alias("node"), F.col(target).cast("string").alias("nbr")),
                             F.struct(F.col(target).cast("string").alias("node"), F.col(source).cast("string").alias("nbr"))))
    pairs = e.select(ends.alias("p")).select("p.node", "p.nbr").dropDuplicates(["node", "nbr"])
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))

"""Continuous forms of change detection, the anomaly guard, the throttle, the digest and the price history.

The stateful operators put one key's rows of one micro-batch in order in memory; the size of a
micro-batch (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricelake.functions.running import Past

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "site_id long, item_id long, seen_at timestamp, old_price double, new_price double"


#: The last row of an item as state holds it, and the groups into which a site's items are dealt.
LAST = np.dtype([("item_id", "i8"), ("price", "f8"), ("at", "i8"), ("tie1", "i8"), ("tie2", "i8")])
ITEM_GROUPS = 8


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    site, nameless = key[:2]
    last = {item: row for item, *row in np.frombuffer(state.get[0], LAST).tolist()} if state.exists else {}
    out = []
    items = lambda rows: [0] * len(rows) if nameless else rows["item_id"].tolist()
    for item, seen, a, b, price in sorted(row for rows in batches for row in zip(items(rows), *(rows[c].tolist() for c in ("seen_at", "tie1", "tie2", "price")), strict=True)):
        place, old = [seen.value, int(a), int(b)], last.get(item)
        if old is not None and place <= old[1:]:
            continue  # older than what is stored
        if old is not None and old[0] != price:
            out.append((site, None if nameless else item, seen, old[0], price))
        last[item] = [float(price), *place]
    if last:
        state.update((np.array([(item, *row) for item, row in last.items()], LAST).tobytes(),))
    if out:
        yield pd.DataFrame(out, columns=["site_id", "item_id", "seen_at", "old_price", "new_price"])


def change_stream(points: DataFrame) -> DataFrame:
    """STR-1: price changes of every (site_id, item_id) against its last price; snapshots older than the stored one are dropped.

    Most items have a few rows and a call for each would cost more than its rows, so a call takes an eighth of a site's
    items, whose last prices are one state; items without an id have one of their own.
    """
    dealt = points.withColumn("nameless", F.col("item_id").isNull()).withColumn("item_group", F.pmod(F.xxhash64("item_id"), F.lit(ITEM_GROUPS)))
    return dealt.groupBy("site_id", "nameless", "item_group").applyInPandasWithState(_changes, CHANGE, "last binary", "append", GroupStateTimeout.NoTimeout)


class Guard(StatefulProcessor):
    """STR-2: flags a price against the median and median deviation of the item's last prices."""

    def __init__(self, keep: int = 500, z: float = 6.0, least: int = 6):
        self.keep, self.z, self.least = keep, z, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = [p[0] for p in self.past.get()]
        past = Past(self.keep, stored[-self.keep :])
        batch = pd.concat(list(rows)).sort_values(["fetched_at", "run_id"])
        flags, new = [], []
        for price in batch["price"].astype(float):
            flags.append(past.outlier(price, self.z, self.least))
            past.add(price)
            new.append((price,))
        # New prices are appended; the state is written anew only when half of it has expired.
        if len(stored) + len(new) <= 2 * self.keep:
            self.past.appendList(new)
        else:
            self.past.put([(p,) for p in past.arrived])
        yield pd.DataFrame({"site_id": batch["site_id"], "run_id": batch["run_id"], "outlier": flags})

    def close(self) -> None:
        pass


def guard_stream(points: DataFrame, keep: int = 500) -> DataFrame:
    """STR-2 over a stream of site_id, run_id, fetched_at, price."""
    return points.groupBy("site_id").transformWithStateInPandas(Guard(keep), "site_id long, run_id long, outlier boolean", "Append", "None")


def _throttle(minutes: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["created_at", "alert_id"])
        out = []
        for at, n in zip(rows["created_at"], rows["alert_id"], strict=True):
            if last is None or at.value >= last + minutes * 60_000_000_000:
                out.append((key[0], n, at))
                last = at.value
        # What comes after the silence is allowed anyway, so its end is the end of the state.
        ends = last // 1_000_000 + minutes * 60_000
        if ends > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["dedup_key", "alert_id", "created_at"])

    return run


def throttle_stream(alerts: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """STR-3: alerts (dedup_key, alert_id, created_at) unless one of the same key was sent in the last minutes.

    Alerts later than the watermark are dropped; a key's state goes once the watermark has passed its silence.
    """
    return alerts.withWatermark("created_at", late).groupBy("dedup_key").applyInPandasWithState(_throttle(minutes), "dedup_key string, alert_id long, created_at timestamp", "last_sent long", "append", GroupStateTimeout.EventTimeTimeout)


class Snapshots(StatefulProcessor):
    """Compares each snapshot of a site with the one before, once the watermark says that it is whole.

    last holds the items of the newest compared snapshot and is replaced as a whole, open those of snapshots that may
    still grow and is appended to; of an item's rows in a snapshot the last to arrive counts. A batch's rows of a snapshot
    are one JSON text in state, as every row of state costs a message to the worker and back at each timer.
    """

    FIELDS = ("price", "availability")

    #: A timer this much after a snapshot fires when the watermark lies beyond it.
    BEYOND_MS = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, rows string")
        self.open = handle.getListState("open", "at long, rows string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of a batch table: the snapshot that the first one of the stream is compared with."""
        rows = zip(*(initialState[c].tolist() for c in ("item_key", "price", "availability")), strict=True)
        self.last.update((int(initialState["at"].max().value // 1_000_000), json.dumps([(item, _plain(price), _plain(stock)) for item, price, stock in rows])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        done = None if last is None else last[0]
        new: dict[int, list[tuple]] = {}
        for batch in rows:
            times = (batch["at"].to_numpy("datetime64[ns]").astype("int64") // 1_000_000).tolist()
            for ms, item, price, stock, arrival in zip(times, *(batch[c].tolist() for c in ("item_key", "price", "availability", "arrival")), strict=True):
                if item is not None and (done is None or ms > done):
                    new.setdefault(ms, []).append((item, _plain(price), _plain(stock), int(arrival)))
        if new:
            self.open.appendList([(ms, json.dumps(found)) for ms, found in new.items()])
            for ms in new:
                self.handle.registerTimer(ms + self.BEYOND_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() - self.BEYOND_MS
        held = [tuple(row) for row in self.open.get()]
        new = {row[0]: tuple(row[1:3]) for row in sorted((r for ms, found in held if ms == at for r in json.loads(found)), key=lambda r: r[3])}
        last = self.last.get()
        old = {} if last is None else {item: tuple(values) for item, *values in json.loads(last[1])}
        site, seen, out = key[0], pd.Timestamp(at, unit="ms"), []
        if last is not None:
            out += [(site, seen, i, "_new_item", None, i) for i in new if i not in old]
            out += [(site, seen, i, "_removed_item", i, None) for i in old if i not in new]
            out += [(site, seen, i, f, _text(a), _text(b)) for i in new if i in old for f, a, b in zip(self.FIELDS, old[i], new[i], strict=True) if a != b]
        self.last.update((at, json.dumps([(i, *values) for i, values in new.items()])))
        rest = [(ms, found) for ms, found in held if ms > at]
        self.open.put(rest) if rest else self.open.clear()
        yield pd.DataFrame(out, columns=["site_id", "at", "item_key", "field", "old_value", "new_value"])

    def close(self) -> None:
        pass


def _plain(value):
    """A value as state holds it: null for what pandas calls missing."""
    return None if value is None or value != value else value


def _text(value) -> str | None:
    return None if value is None else str(value)


def snapshot_changes(records: DataFrame, wait: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """STR-1 over snapshots: changed fields, new and removed items between a site's successive snapshots.

    records: site_id, at (timestamp of the snapshot), item_key, price, availability, arrival (long). A snapshot is
    compared once others are newer by the wait, for which its rows may come in; later ones are dropped. The first snapshot is
    compared with the initial one (site_id, item_key, at, price, availability) of a batch table, if there is any.
    """
    first = None if initial is None else initial.groupBy("site_id")
    changes = "site_id long, at timestamp, item_key string, field string, old_value string, new_value string"
    return records.withWatermark("at", wait).groupBy("site_id").transformWithStateInPandas(Snapshots(), changes, "Append", "EventTime", first)


def digest_stream(changes: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """STR-4: changes per site in windows of some hours; rows later than the watermark are dropped."""
    windows = changes.withWatermark("changed_at", late).groupBy(F.window("changed_at", f"{hours} hours"), "site_id").agg(F.count("*").alias("changes"))
    return windows.select("site_id", F.col("window.start").alias("start"), "changes")


def history_append(points: DataFrame, path: str, checkpoint: str, key: Column):
    """STR-5: a query that appends positive prices with a product key to the history."""
    rows = points.withColumn("product_key", key).where((F.col("price") > 0) & F.col("product_key").isNotNull())
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and returns the rows that it wrote."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

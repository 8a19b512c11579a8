"""Change log of features, from snapshots or from a stream of changes.

Rules: inserts, updates and deletes of top-level features are logged. An update
that leaves the modification date as it was is dropped. A termination date
turns any logged insert or update into TERMINATE. A delete carries the last
known values, no feature id and no reason.

The stream keeps, for each feature, the last known values and the number of its
last change. Where changes are numbered per feature (``version`` 1, 2, 3, ...), one
that comes early waits in the state until those before it are there, so files in any
order give the log of the right order; one that comes again, or after its place was
passed, is set apart (``late``). Without versions a micro-batch is ordered by ``seq``,
and what lies behind the last ``seq`` of its feature is late.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from urbanframe.operators.filters import toplevel_only
from urbanframe.operators.ids import dense_id
from urbanframe.schema import FEATURE_CHANGELOG_DDL, GEOMETRY_DDL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

LOG_DDL = f"id long, {FEATURE_CHANGELOG_DDL}, late boolean"
# Values of a feature that a delete still knows, and what else a change brings; dates as microseconds.
_KNOWN = ["objectclass_id", "objectid", "identifier", "identifier_codespace", "envelope"]
_CHANGE_DDL = (
    "id long, seq long, version long, op string, at long, modified long, terminated long, objectclass_id int, "
    "objectid string, identifier string, identifier_codespace string, envelope string, db_user string, reason_for_update string"
)
_OUT = ["id", "feature_id", *_KNOWN, "transaction_type", "at", "db_user", "reason_for_update", "late"]
_OUT_DDL = (
    "id long, feature_id long, objectclass_id int, objectid string, identifier string, identifier_codespace string, "
    "envelope string, transaction_type string, at long, db_user string, reason_for_update string, late boolean"
)


def changelog_from_snapshots(
    old: DataFrame, new: DataFrame, objectclass: DataFrame, extra: list[str] | None = None,
    at: Column | None = None, user: str | None = None, after: int | None = None,
) -> DataFrame:
    """Log rows between two snapshots of the feature table.

    With ``extra`` = identifier, identifier_codespace and envelope, the date ``at``, the
    ``user`` and the last id in use ``after``, rows have all columns of the log.
    """
    extra = extra or []
    carried = ["objectclass_id", "objectid", *extra]
    cols = ["id", "last_modification_date", "termination_date", "reason_for_update", *carried]
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in cols])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in cols])
    both = o.join(n, F.col("o_id") == F.col("n_id"), "full_outer")
    deleted, inserted = F.col("n_id").isNull(), F.col("o_id").isNull()
    unchanged = ~deleted & ~inserted & F.col("o_last_modification_date").eqNullSafe(F.col("n_last_modification_date"))
    op = (
        F.when(deleted, "DELETE").when(F.col("n_termination_date").isNotNull(), "TERMINATE")
        .when(inserted, "INSERT").otherwise("UPDATE")
    )
    rows = both.where(~unchanged).select(
        F.when(~deleted, F.col("n_id")).alias("feature_id"),
        *[F.when(deleted, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in carried],
        op.alias("transaction_type"), F.when(~deleted, F.col("n_reason_for_update")).alias("reason_for_update"),
        *([F.coalesce("n_id", "o_id").alias("_id")] if after is not None else []),
    )
    rows = toplevel_only(rows, objectclass)
    if at is not None:
        rows = rows.withColumn("transaction_date", at)
    if user is not None:
        rows = rows.withColumn("db_user", F.lit(user))
    return rows if after is None else dense_id(rows, ["_id"], "id", after + 1).drop("_id")


def transitions(rows: list[dict], last: dict | None) -> tuple[list[dict], dict]:
    """Log rows of one feature's changes in their order, and its state after them.

    One pass with the values of the last change that counted: a feature has few
    changes in a batch, and there are many features.
    """
    state = dict(last) if last else {"alive": False, "modified": None, **dict.fromkeys(_KNOWN)}
    out = []
    for r in rows:
        op, alive = r["op"], state["alive"]
        if op == "DELETE":
            if alive:
                out.append({
                    "id": r["seq"], "feature_id": None, **{c: state[c] for c in _KNOWN}, "transaction_type": op,
                    "at": r["at"], "db_user": r["db_user"], "reason_for_update": None,
                })
            state["alive"] = False
        elif op == "INSERT" or (op == "UPDATE" and alive):
            if op == "INSERT" or r["modified"] != state["modified"]:
                out.append({
                    "id": r["seq"], "feature_id": r["id"], **{c: r[c] for c in _KNOWN},
                    "transaction_type": op if r["terminated"] is None else "TERMINATE",
                    "at": r["at"], "db_user": r["db_user"], "reason_for_update": r["reason_for_update"],
                })
            state.update({c: r[c] for c in ("modified", *_KNOWN)}, alive=True)
    return out, state


def _plain(v):
    if v is None or v != v:
        return None
    return int(v) if isinstance(v, (int, float, np.number)) else v


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """The rows of a feature as plain values, column by column."""
    for frame in frames:
        columns = [[_plain(v) for v in frame[c].tolist()] for c in frame.columns]
        yield from (dict(zip(frame.columns, values)) for values in zip(*columns))


def _in_order(rows: list[dict], order: str) -> list[dict]:
    """Sorted by the order column, then ``seq``; nulls last."""
    last = lambda v: (v is None, 0 if v is None else v)
    return sorted(rows, key=lambda r: (last(r[order]), last(r["seq"])))


class ChangeLogger(StatefulProcessor):
    """State per feature: last known values with the number of its last change, and the changes that came early."""

    def __init__(self, numbered: bool):
        self.numbered = numbered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long, state string")
        self.early = handle.getListState("early", "change string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, state = (0 if self.numbered else None), None
        if self.last.exists():
            number, text = self.last.get()
            state = json.loads(text)
        order = "version" if self.numbered else "seq"
        waiting = [json.loads(r[0]) for r in self.early.get()] if self.early.exists() else []
        new, behind, waits, before = [], [], [], object()
        for r in _in_order([*waiting, *_records(rows)], order):
            at = r[order]
            again = at == before or (number is not None and at is not None and at <= number)
            (behind if again else new).append(r)
            before = at
        if self.numbered:
            ready = 0
            while ready < len(new) and new[ready][order] == number + 1 + ready:
                ready += 1
            new, waits = new[:ready], new[ready:]
            if waits:
                self.early.put([(json.dumps(r),) for r in waits])
            elif waiting:
                self.early.clear()
        if new:
            log, state = transitions(new, state)
            self.last.update((int(new[-1][order]), json.dumps(state)))
            yield self._typed([{**r, "late": False} for r in log])
        if behind:
            yield self._typed([{**r, "feature_id": r["id"], "id": r["seq"], "transaction_type": r["op"], "late": True} for r in behind])

    @staticmethod
    def _typed(records: list[dict]) -> pd.DataFrame:
        whole = {c: "Int64" for c in ("id", "feature_id", "at")} | {"objectclass_id": "Int32", "late": "bool"}
        return pd.DataFrame(records, columns=_OUT, dtype=object).astype(whole)

    def close(self) -> None:
        pass


# The state logic travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def changelog_stream(changes: DataFrame, objectclass: DataFrame) -> DataFrame:
    """Streaming log of a stream of changes, with all columns of the log and ``late``.

    Input columns: id, seq (number of the change, becomes the id of its log row), ts,
    op, last_modification_date, termination_date, objectclass_id, objectid,
    reason_for_update, and if there are any: version (number of the change of its
    feature, from 1), identifier, identifier_codespace, envelope (geometry), db_user.
    Only features of top-level classes enter the state. Run it with ``run_to_table``,
    or set the RocksDB state store.
    """
    top = objectclass.where(F.col("is_toplevel") > 0).select(F.col("id").alias("objectclass_id"))
    have, numbered = set(changes.columns), "version" in changes.columns
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    envelope = F.to_json("envelope") if "envelope" in have else F.lit(None).cast("string")
    rows = changes.join(top, "objectclass_id", "left_semi").select(
        "id", "seq", (F.col("version") if numbered else F.col("seq")).cast("long").alias("version"), "op",
        micros("ts").alias("at"), micros("last_modification_date").alias("modified"),
        micros("termination_date").alias("terminated"), F.col("objectclass_id").cast("int").alias("objectclass_id"), "objectid",
        text("identifier"), text("identifier_codespace"), envelope.alias("envelope"), text("db_user"), "reason_for_update",
    )
    log = rows.groupBy("id").transformWithStateInPandas(
        ChangeLogger(numbered), outputStructType=_OUT_DDL, outputMode="Append", timeMode="None"
    )
    return log.select(
        "id", "feature_id", "objectclass_id", "objectid", "identifier", "identifier_codespace", F.from_json("envelope", GEOMETRY_DDL).alias("envelope"),
        "transaction_type", F.timestamp_micros("at").alias("transaction_date"), "db_user", "reason_for_update", "late",
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all available input into a Parquet folder (late changes in a partition of their own), then stop."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, ROCKSDB)  # a query keeps the settings it was started with
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", path).partitionBy("late")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)

"""The event stage over a stream: decisions by keyed state, appended exactly once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from annals.operators.stage import CARDINALITY, COMPETING, SINGLETONS, singleton

CANDIDATE = "event_id long, person string, event_type string, stem string, occurrence_key string, place string"
DECISION = f"{CANDIDATE}, outcome string, code string, places array<string>, event long"
#: The places of each stem in the order in which they came, and the events made; a lot is a stem, or a person's births or deaths.
STATE = "stems array<string>, places array<array<string>>, keys array<string>, events array<long>"


def advance(lot: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stems, places, keys, events = state.get if state.exists else ((), (), (), ())
    read = {s: list(p) for s, p in zip(stems, places, strict=True)}
    made = dict(zip(keys, events, strict=True))
    rows = pd.concat(list(batches)).sort_values("event_id")
    out = []
    for r in rows.itertuples(index=False):
        known = read.setdefault(r.stem, [])
        rivals = r.place != "" and any(p != r.place for p in known)
        if r.place and r.place not in known:
            known.append(r.place)
        if rivals:
            out.append(("needs_review", COMPETING, sorted(known), None))
        elif r.occurrence_key in made:
            out.append(("reinforced", None, None, made[r.occurrence_key]))
        elif made and r.event_type in SINGLETONS:
            out.append(("rejected", CARDINALITY, None, None))
        else:
            made[r.occurrence_key] = r.event_id
            out.append(("created", None, None, r.event_id))
    state.update((list(read), list(read.values()), list(made), list(made.values())))
    decided = pd.DataFrame(out, columns=["outcome", "code", "places", "event"], index=rows.index)
    yield pd.concat([rows[[c.split()[0] for c in CANDIDATE.split(", ")]], decided.astype({"event": "Int64"})], axis=1)


def decisions(candidates: DataFrame) -> DataFrame:
    """The decisions of ``operators.stage.decide`` for a stream of candidates that comes in batches.

    Within a batch candidates are taken by event_id. A candidate that comes again, by event_id, is
    skipped. The state is small: places by stem, keys of events; Spark keeps it by lot and restores it
    with the checkpoint. The candidates of one lot in one batch are sorted in memory, so the source's
    batch size (maxFilesPerTrigger, maxBytesPerTrigger) bounds them.
    """
    lot = F.when(singleton(F.col("event_type")), F.concat_ws("|", "person", "event_type")).otherwise(F.col("stem"))
    fresh = candidates.dropDuplicates(["event_id"]).withColumn("lot", lot)
    return fresh.groupBy("lot").applyInPandasWithState(advance, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


def run_stage(candidates: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the decisions to the Parquet folder ``table`` and stop when all is read. The sink's log makes a batch count once, so a restart adds nothing."""
    out = decisions(candidates).writeStream.format("parquet").outputMode("append")
    return out.option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Per-session state over a stream of turns: the vault and the chunks in scope.

The regular expressions run before the keyed stage, on evenly spread rows; the
keyed stage only looks up or allocates tokens. Turns are ordered inside a micro
batch, so a turn that arrives in a later batch gets later token numbers. Of the turns that
one session sends in one micro batch the vault holds the entities; their texts wait in a file of the task.

A session that stays idle, by the time stamps of its turns, ends as a whole: its values leave the state. What stays
are the numbers it issued, a count a type, so that no token of an ended session is ever issued again.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragspark import fixed
from ragspark.functions.pii import DETECTORS, Detector, assemble, masked

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """State of any size per key needs the disk-backed store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Session(StatefulProcessor):
    """A session that ends once the watermark is ``idle_ms`` past its last turn."""

    def __init__(self, idle_ms: int | None):
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._ends = handle.getValueState("ends", "at bigint")

    def _live_on(self, seen_ms: pd.Series, timers) -> None:
        """Move the end of the session to ``idle_ms`` after its latest turn."""
        seen = seen_ms.max()
        if self._idle_ms is None or pd.isna(seen):
            return
        end = max(int(seen) + self._idle_ms, timers.getCurrentWatermarkInMs() + 1)
        if self._ends.exists():
            old = self._ends.get()[0]
            if old >= end:
                return
            self._handle.deleteTimer(old)
        self._handle.registerTimer(end)
        self._ends.update((end,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._ends.clear()
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


class _Vault(_Session):
    """Token of each value of the session; one map entry a value, so a long session is never held in memory."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._tokens = handle.getMapState("tokens", "key string", "token string")
        self._issued = handle.getMapState("issued", "entity_type string", "n bigint")

    def _forget(self) -> None:
        self._tokens.clear()

    def _last(self, kind: str) -> int:
        return self._issued.getValue((kind,))[0] if self._issued.containsKey((kind,)) else 0

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for value, token in zip(initialState["key"], initialState["token"]):
            self._tokens.updateValue((value,), (token,))
        for kind, n in initialState.groupby("entity_type")["n"].max().items():
            self._issued.updateValue((kind,), (max(int(n), self._last(kind)),))
        self._live_on(initialState["seen_ms"], timerValues)

    def _allocate(self, told: pd.DataFrame) -> pd.DataFrame:
        """Tokens of the keys of ``told`` (key, entity_type, value) that the session has none for, in order of first sight."""
        first = told.drop_duplicates("key")
        new = first[first["key"].map(lambda k: not self._tokens.containsKey((k,))).astype(bool)].copy()
        before = new["entity_type"].map({kind: self._last(kind) for kind in new["entity_type"].unique()})
        new["n"] = new.groupby("entity_type").cumcount() + 1 + before.astype("int64")
        new["token"] = "[" + new["entity_type"] + "_" + new["n"].astype(str) + "]"
        for kind, n in new.groupby("entity_type")["n"].max().items():
            self._issued.updateValue((kind,), (int(n),))
        for value, token in zip(new["key"], new["token"]):
            self._tokens.updateValue((value,), (token,))
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, seen, held = [], pd.Series([], dtype="float64"), 0
        with tempfile.TemporaryFile() as texts:
            for part in rows:
                for i, (turn, pass_no, entities) in enumerate(zip(part["turn"], part["pass_no"], part["entities"]), held):
                    told += [(turn, pass_no, i, e["slot"], e["entity_type"], e["value"], e["key"]) for e in entities]
                seen = pd.concat([seen, part["seen_ms"]]).nlargest(1)
                held += len(part)
                pickle.dump(part[["turn", "pass_no", "note", "pieces", "slots", "counts"]], texts, protocol=5)
            told = pd.DataFrame(told, columns=["turn", "pass_no", "row", "slot", "entity_type", "value", "key"])
            told = told.sort_values(["turn", "pass_no", "row"], ignore_index=True)
            new = self._allocate(told)
            known = dict(zip(new["key"], new["token"]))
            token = [known.get(k) or self._tokens.getValue((k,))[0] for k in told["key"]]
            of_slot = dict(zip(zip(told["row"], told["slot"]), token))
            issued = {i: part[["token", "value", "key", "entity_type", "n"]].to_dict("records") for i, part in new.groupby("row")}
            self._live_on(seen, timerValues)
            texts.seek(0)
            at = 0
            while at < held:
                part = pickle.load(texts)
                numbers = range(at, at + len(part))
                at += len(part)
                yield pd.DataFrame({
                    "session_id": key[0], "turn": part["turn"].to_list(), "pass_no": part["pass_no"].to_list(), "note": part["note"].to_list(),
                    "pieces": part["pieces"].to_list(), "fillers": [[of_slot[i, s] for s in slots] for i, slots in zip(numbers, part["slots"])],
                    "counts": part["counts"].to_list(), "issued": [issued.get(i, []) for i in numbers],
                })


def _timed(stream: DataFrame, time: str | None, idle: str | None, late: str) -> tuple[DataFrame, int | None]:
    """The stream with its watermark and ``seen_ms``, and the idle time in milliseconds."""
    if idle is None:
        return stream.withColumn("seen_ms", F.lit(None).cast("long")), None
    if time is None:
        raise ValueError("idle sessions end by the time of their turns: name the time stamp column")
    wait = pd.Timedelta(idle)
    if wait <= pd.Timedelta(0):
        raise ValueError("idle must be a positive time")
    return stream.withWatermark(time, late).withColumn("seen_ms", F.unix_millis(time)), int(wait.total_seconds() * 1000)


def redact_stream(
    turns: DataFrame, detectors: Sequence[Detector] = DETECTORS, *, time: str | None = None, idle: str | None = None, late: str = "1 hour",
    vault: DataFrame | None = None,
) -> DataFrame:
    """Redact a stream ``(session_id string, turn bigint, pass_no int, text [, note string])``.

    Emits ``clean_text``, ``detections`` and ``issued``, the vault rows first
    allocated by the turn; appending ``issued`` to a table gives the batch vault, with type and number.
    A ``note`` passes through untouched.

    With ``idle`` (such as "30 minutes") a session ends that long after the latest ``time`` (a time stamp column) of its turns;
    a value that returns later gets a new token with a number not issued before. Spark drops turns that come more than ``late`` behind the stream.
    ``vault`` (session_id, key, entity_type, n, token [, seen timestamp]), as a batch job or an earlier stream wrote
    it, is loaded when the stream first starts, so that a known value keeps its token; rows without ``seen`` stay until their session's next turn.
    """
    use_keyed_state(turns.sparkSession)
    turns, idle_ms = _timed(turns, time, idle, late)
    note = F.col("note") if "note" in turns.columns else F.lit(None).cast("string").alias("note")
    timed = [time] if idle_ms else []
    marked = turns.withColumn("_m", masked(F.col("text"), detectors)).select("session_id", "turn", "pass_no", note, "seen_ms", *timed, "_m.*")
    known = None
    if vault is not None:
        seen = F.unix_millis("seen") if "seen" in vault.columns else F.lit(None).cast("long")
        known = vault.select("session_id", "key", "entity_type", F.col("n").cast("long").alias("n"), "token", seen.alias("seen_ms")).groupBy("session_id")
    kept = marked.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Vault(idle_ms),
        outputStructType=(
            "session_id string, turn bigint, pass_no int, note string, pieces array<string>, fillers array<string>, "
            "counts array<struct<entity_type:string,count:bigint>>, "
            "issued array<struct<token:string,value:string,key:string,entity_type:string,n:bigint>>"
        ),
        outputMode="append", timeMode="EventTime" if idle_ms else "None", initialState=known,
    )
    return kept.select(
        "session_id", "turn", "pass_no", "note", assemble(F.col("pieces"), F.col("fillers")).alias("clean_text"),
        F.col("counts").alias("detections"), "issued",
    )


class _Scope(_Session):
    """Chunks in scope: at most the cap, merged turn by turn."""

    def __init__(self, cap: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self._cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._scope = handle.getListState("scope", "chunk_id string, score double")

    def _forget(self) -> None:
        self._scope.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.sort_values("scope_rank")[["chunk_id", "score"]].itertuples(index=False):
            self._scope.appendValue((row.chunk_id, float(row.score)))
        self._live_on(initialState["seen_ms"], timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["turn", "rank"])
        held = {c: s for c, s in self._scope.get()}
        for turn, new in batch.groupby("turn", sort=True):
            for chunk, score in zip(new["chunk_id"], new["score"]):
                if chunk not in held or score > held[chunk]:
                    held[chunk] = float(score)
            held = dict(sorted(held.items(), key=lambda item: -item[1])[: self._cap])
            yield pd.DataFrame({
                "session_id": key[0], "turn": int(turn), "scope_rank": range(1, len(held) + 1),
                "chunk_id": list(held), "score": list(held.values()),
            })
        self._scope.put([(c, s) for c, s in held.items()])
        self._live_on(batch["seen_ms"], timerValues)


def scope_stream(
    retrieved: DataFrame, cap: int = fixed.SCOPE_CAP, *, time: str | None = None, idle: str | None = None, late: str = "1 hour",
    scope: DataFrame | None = None,
) -> DataFrame:
    """Scope after every turn of a stream ``(session_id string, turn bigint, rank int, chunk_id string, score)``.

    ``time``, ``idle`` and ``late`` end sessions as in :func:`redact_stream`; ``scope`` (session_id, scope_rank, chunk_id, score
    [, seen timestamp]) is the state a batch job left, loaded when the stream first starts.
    """
    use_keyed_state(retrieved.sparkSession)
    retrieved, idle_ms = _timed(retrieved, time, idle, late)
    known = None
    if scope is not None:
        seen = F.unix_millis("seen") if "seen" in scope.columns else F.lit(None).cast("long")
        known = scope.select("session_id", F.col("scope_rank").cast("long").alias("scope_rank"), "chunk_id", "score", seen.alias("seen_ms")).groupBy("session_id")
    return retrieved.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Scope(cap, idle_ms),
        outputStructType="session_id string, turn bigint, scope_rank bigint, chunk_id string, score double",
        outputMode="append", timeMode="EventTime" if idle_ms else "None", initialState=known,
    )

"""Stateful operators of many runs at once. Runs are dealt to buckets by a hash; a call takes what a micro-batch brings for all runs of a
bucket, with array operations over all of them. State is a few numbers per run and the rows the watermark has not passed yet: rows wait in a
list until no earlier one can come, are put in order, and are advanced by the same formulas as in the batch operators. So results depend
neither on the order of arrival nor on how rows fell into micro-batches, as long as rows are no later than the watermark allows; later ones
are dropped here and belong to the dead letters (``engine.accept``). Timers release waiting rows and report silence when nothing more comes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stamina.streaming.engine import CLOSING, FEWEST_BUCKETS, LATENESS

AT = "event_us"     # the worker renames columns that begin with an underscore
RUN, BUCKET = "run_number", "run_bucket"
OUTPUT_ROWS = 500_000


def packed(table: pa.Table) -> tuple[bytes]:
    """A table as the one value of a state row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def unpacked(row: tuple) -> pa.Table:
    return pa.ipc.open_stream(bytes(row[0])).read_all()


class Groups:
    """Rows sorted by run: ``run`` of each row, and for each run present its number, first and last row. A frame without numbers is one run."""

    def __init__(self, frame: pd.DataFrame):
        n = len(frame)
        self.frame, self.place = frame, np.arange(n)
        self.run = frame[RUN].to_numpy("int64") if RUN in frame else np.zeros(n, "int64")
        first = np.ones(n, bool)
        first[1:] = self.run[1:] != self.run[:-1]
        self.head = np.flatnonzero(first)
        self.tail = np.append(self.head[1:], n)[:len(self.head)] - 1
        self.runs = self.run[self.head]
        self.begin = self.head[np.cumsum(first) - 1]              # first row of each row's run

    def before(self, values: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """The value of the row before; a run's first row has the one from its state."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.head] = seed[self.runs]
        return out

    def latest(self, mask: np.ndarray) -> np.ndarray:
        """Place of the run's last row up to each one for which ``mask`` holds, else -1."""
        last = np.maximum.accumulate(np.where(mask, self.place, -1))
        return np.where(last >= self.begin, last, -1)

    def cumsum(self, values: np.ndarray) -> np.ndarray:
        total = np.cumsum(values)
        return total - (total - values)[self.begin]

    def streaks(self, active: np.ndarray, t: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Start time of the streak each row belongs to; an open streak may come from before."""
        reset, since = self.latest(~active), since[self.run]
        return np.where(reset >= 0, t[np.minimum(reset + 1, len(t) - 1)], np.where(np.isnan(since), t[self.begin], since))

    def rows(self, which: np.ndarray, columns: list[str], **more) -> pd.DataFrame:
        """Output of some rows; its index is the run."""
        return self.frame[columns].iloc[which].assign(**more).set_axis(self.run[which])


class Ordered(StatefulProcessor):
    """Rows of each run by event time, ties by ``order``. ``advance(state, frame)`` returns (new state, output), where ``state`` has one
    array for each of ``fields`` with a place for each run, and the index of the output is the run.

    ``idle(state, until)`` may report what follows from no row up to the time ``until``, and ``wake(state)`` says when to ask.
    """

    fields: dict = {}
    row: T.StructType

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order

    def start(self, n: int) -> dict[str, np.ndarray]:
        return {name: np.full(n, value) for name, value in self.fields.items()}

    @property
    def initial(self) -> dict[str, np.ndarray]:
        return self.start(1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema
        self.handle, self.arrow = handle, to_arrow_schema(self.row)
        self.state = handle.getValueState("s", "runs binary")
        self.clock = handle.getValueState("clock", "timer bigint")
        self.held = handle.getListState("held", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            if len(frame):
                frame = frame[frame[AT].notna() & ~(frame[CLOSING].astype(bool) if CLOSING in frame else False)]
                new.append(pa.Table.from_pandas(frame[self.arrow.names], schema=self.arrow, preserve_index=False))
        yield from self._step([t for t in new if t.num_rows], timer_values.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues.getCurrentWatermarkInMs())

    def _step(self, new: list[pa.Table], watermark: int) -> Iterator[pd.DataFrame]:
        timer = self.clock.get()[0] if self.clock.exists() else None
        first = min((pc.min(t[AT]).as_py() for t in new), default=None)
        if (timer is None or timer > watermark) and (first is None or first > watermark * 1000):
            if new:                                         # nothing can be released: only put the rows with the others
                self.held.appendList([packed(pa.concat_tables(new))])
                self._set_timer(timer, min(t for t in (timer, -(-first // 1000)) if t is not None), watermark)
            return
        rows = pa.concat_tables([self.arrow.empty_table(), *(unpacked(r) for r in (self.held.get() if self.held.exists() else [])), *new])
        passed = pc.less_equal(rows[AT], watermark * 1000)
        ready, rest = rows.filter(passed), rows.filter(pc.invert(passed))
        self.held.put([packed(rest)]) if rest.num_rows else self.held.clear()
        keys, state = self._load()
        if ready.num_rows:
            known = len(keys)
            named = pa.concat_arrays([keys, *ready[self.key].chunks]).dictionary_encode("encode")
            keys, fresh = named.dictionary, self.start(len(named.dictionary) - known)
            state = {name: np.concatenate([state[name], fresh[name]]) for name in state}
            frame = ready.drop_columns([self.key]).to_pandas().assign(**{RUN: named.indices.to_numpy()[known:]})
            frame = frame.sort_values([RUN, AT, *self.order], kind="stable").reset_index(drop=True)
            state, out = self.advance(state, frame)
            yield from self._keyed(keys, out)
        due = [] if not rest.num_rows else [-(-pc.min(rest[AT]).as_py() // 1000)]
        if len(keys):
            state, out = self.idle(state, watermark / 1000)
            yield from self._keyed(keys, out)
            self.state.update(packed(pa.table({"key": keys, **{name: pa.array(v) for name, v in state.items()}})))
            wake = self.wake(state)
            due += [] if wake is None else [int(np.ceil(wake * 1000))]
        self._set_timer(timer, min(due, default=None), watermark)

    def _load(self) -> tuple[pa.Array, dict[str, np.ndarray]]:
        if not self.state.exists():
            return pa.array([], self.arrow.field(self.key).type), self.start(0)
        table = unpacked(self.state.get()).combine_chunks()
        return pa.concat_arrays(table["key"].chunks), {n: table[n].to_numpy().copy() for n in table.column_names if n != "key"}

    def _set_timer(self, old: int | None, due: int | None, watermark: int) -> None:
        due = None if due is None else max(due, watermark + 1)
        if due == old:
            return
        if old is not None and old > watermark:
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)
        self.clock.update((due,))

    def _keyed(self, keys: pa.Array, out: pd.DataFrame | Iterable[pd.DataFrame] | None) -> Iterator[pd.DataFrame]:
        for part in [] if out is None else [out] if isinstance(out, pd.DataFrame) else out:
            if len(part):
                name = keys.take(pa.array(part.index.to_numpy()))
                name = pd.Series(name.to_pylist(), dtype=object) if name.null_count else name.to_pandas()
                part = part.reset_index(drop=True)
                part.insert(0, self.key, name)
                yield part

    def advance(self, state: dict, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame | Iterable[pd.DataFrame] | None]:
        raise NotImplementedError

    def idle(self, state: dict, until: float) -> tuple[dict, pd.DataFrame | None]:
        return state, None

    def wake(self, state: dict) -> float | None:
        return None

    def close(self) -> None:
        pass


def apply(df: DataFrame, proc: Ordered, schema: str, ts: str = "ts", lateness: str = LATENESS, buckets: int = FEWEST_BUCKETS) -> DataFrame:
    """``proc`` over a stream with the event time ``ts``; rows may come up to ``lateness`` behind the newest one.

    A restart must name the same number of ``buckets``.
    """
    proc.row = T.StructType([*[f for f in df.schema.fields if f.name not in (ts, CLOSING)], T.StructField(AT, T.LongType())])
    rows = df.withWatermark(ts, lateness).withColumn(AT, F.unix_micros(ts)).withColumn(BUCKET, F.pmod(F.xxhash64(proc.key), F.lit(buckets)).cast("int"))
    return rows.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=proc, outputStructType=schema, outputMode="append", timeMode="EventTime")


class Sustained(Ordered):
    """Fires once per streak when a condition has held for ``sustain`` seconds."""

    fields = {"since": np.nan, "t": np.nan, "over": False}

    def __init__(self, key, order, sustain: float, carry: list[str]):
        super().__init__(key, order)
        self.sustain, self.carry = sustain, carry

    def advance(self, state, frame):
        g = Groups(frame[frame["over"].notna()])
        over, t = g.frame["over"].to_numpy(bool), g.frame["t_s"].to_numpy(float)
        start = g.streaks(over, t, state["since"])
        prev_over, prev_t = g.before(over, state["over"]), g.before(t, state["t"])
        fire = over & (t - start >= self.sustain) & ~(prev_over & (prev_t - start >= self.sustain))
        out = g.rows(np.flatnonzero(fire), self.carry, since=start[fire])
        state["since"][g.runs] = np.where(over, start, np.nan)[g.tail]
        state["t"][g.runs], state["over"][g.runs] = t[g.tail], over[g.tail]
        return state, out


class Watchdog(Ordered):
    """First confirmed overcurrent per run; needs a second sample and latches for good."""

    fields = {"since": np.nan, "over": False, "tripped": False}

    def __init__(self, key, order, confirm_s: float, carry: list[str]):
        super().__init__(key, order)
        self.confirm_s, self.carry = confirm_s, carry

    def advance(self, state, frame):
        g = Groups(frame[frame["over"].notna()])
        over, t = g.frame["over"].to_numpy(bool), g.frame["t_s"].to_numpy(float)
        start = g.streaks(over, t, state["since"])
        hit = np.flatnonzero(over & g.before(over, state["over"]) & (t - start >= self.confirm_s) & ~state["tripped"][g.run])
        first = hit[np.unique(g.run[hit], return_index=True)[1]]
        out = g.rows(first, self.carry, since=start[first])
        state["since"][g.runs], state["over"][g.runs] = np.where(over, start, np.nan)[g.tail], over[g.tail]
        state["tripped"][g.run[first]] = True
        return state, out


class BlindLadder(Ordered):
    """Warning once per blind streak after ``warn_s`` and the recovery that follows it."""

    fields = {"since": np.nan, "blind": np.nan}

    def __init__(self, key, order, warn_s: float, carry: list[str]):
        super().__init__(key, order)
        self.warn_s, self.carry = warn_s, carry

    def advance(self, state, frame):
        g = Groups(frame)
        ok, t = frame["readable"].to_numpy(bool), frame["t_s"].to_numpy(float)
        start = g.streaks(~ok, t, state["since"])
        blind = np.where(ok, np.nan, t - start)
        warned = g.before(blind, state["blind"]) >= self.warn_s
        step = np.where((blind >= self.warn_s) & ~warned, "warn", np.where(ok & warned, "recovered", ""))
        keep = np.flatnonzero(step != "")
        out = g.rows(keep, self.carry, blind_s=blind[keep], ladder=step[keep])
        out["blind_s"] = out["blind_s"].astype(object).where(out["blind_s"].notna(), None)
        state["since"][g.runs], state["blind"][g.runs] = np.where(ok, np.nan, start)[g.tail], blind[g.tail]
        return state, out


class SilenceLadder(Ordered):
    """A run without rows for each of the ``limits`` (seconds, name): reported at that time without waiting for another row; the row
    that ends a silence of the first limit or more is its recovery."""

    fields = {"t": np.nan, "level": 0}

    def __init__(self, key, order, limits: list[tuple[float, str]]):
        super().__init__(key, order)
        self.limits = limits

    def advance(self, state, frame):
        g = Groups(frame)
        t = frame["t_s"].to_numpy(float)
        since = g.before(t, state["t"])
        gap, level, parts = t - since, np.zeros(len(t), "int64"), []
        level[g.head] = state["level"][g.runs]
        for k, (limit, name) in enumerate(self.limits):
            due = np.flatnonzero((gap >= limit) & (level <= k))
            parts.append(g.rows(due, [], at=since[due] + limit, ladder=name, silent_s=limit))
        back = np.flatnonzero(gap >= self.limits[0][0])
        parts.append(g.rows(back, [], at=t[back], ladder="recovered", silent_s=gap[back]))
        state["t"][g.runs], state["level"][g.runs] = t[g.tail], 0
        return state, pd.concat(parts)

    def idle(self, state, until):
        level, parts = state["level"].copy(), []
        for k, (limit, name) in enumerate(self.limits):
            due = np.flatnonzero((state["level"] <= k) & (until >= state["t"] + limit))
            level[due] += 1
            parts.append(pd.DataFrame({"at": state["t"][due] + limit, "ladder": name, "silent_s": limit}, index=due))
        return {**state, "level": level}, pd.concat(parts)

    def wake(self, state):
        left = np.flatnonzero(state["level"] < len(self.limits))
        return float((state["t"][left] + np.array([s for s, _ in self.limits])[state["level"][left]]).min()) if len(left) else None


class BoundaryMilestones(Ordered):
    """Milestones of the cycle total, each reported at the first safe boundary at or past it.

    A boundary is safe when the block is of a type in ``after`` and the next one is no interlude, so a block is held back until the next
    one comes, or none has come for ``close_s``; what falls due meanwhile is reported together at the next safe one.
    """

    fields = {"cycles": 0, "reported": 0, "waits": False, "boundary": False, "ident": 0, "t": np.nan}

    def __init__(self, key, order, marks: list[int], after: list[str], interludes: list[str], ident: str, close_s: float):
        super().__init__(key, order)
        self.marks, self.after, self.interludes, self.ident, self.close_s = np.array(sorted(marks)), after, interludes, ident, close_s

    def _due(self, run: np.ndarray, passed: np.ndarray, total: np.ndarray, ident: np.ndarray) -> pd.DataFrame:
        """Marks above ``passed`` up to ``total``."""
        which, mark = marks_passed(self.marks, passed, total)
        return pd.DataFrame({self.ident: ident[which], "milestone": mark, "cycles_total": total[which]}, index=run[which])

    def advance(self, state, frame):
        new = Groups(frame)
        total = state["cycles"][new.run] + new.cumsum(frame["cycles"].fillna(0).to_numpy("int64"))
        kinds, ident = frame["kind"].to_numpy(object).astype(str), frame[self.ident].to_numpy("int64")
        waiting = new.runs[state["waits"][new.runs]]               # their last block goes before the new ones
        run = np.r_[waiting, new.run]
        order = np.argsort(run, kind="stable")
        run, total = run[order], np.r_[state["cycles"][waiting], total][order]
        boundary = np.r_[state["boundary"][waiting], np.isin(kinds, self.after)][order]
        interlude = np.r_[np.zeros(len(waiting), bool), np.isin(kinds, self.interludes)][order]
        idents = np.r_[state["ident"][waiting], ident][order]
        safe = np.flatnonzero(boundary[:-1] & ~interlude[1:] & (run[1:] == run[:-1]))
        g = Groups(pd.DataFrame({RUN: run[safe]}))
        out = self._due(g.run, g.before(total[safe], state["reported"]), total[safe], idents[safe])
        state["reported"][g.runs] = total[safe][g.tail]
        last = np.append(np.flatnonzero(run[1:] != run[:-1]), len(run) - 1)
        state["cycles"][new.runs], state["boundary"][new.runs], state["ident"][new.runs] = total[last], boundary[last], idents[last]
        state["waits"][new.runs], state["t"][new.runs] = True, frame["t_s"].to_numpy(float)[new.tail]
        return state, out

    def idle(self, state, until):
        due = np.flatnonzero(state["boundary"] & (until >= state["t"] + self.close_s) & (state["cycles"] > state["reported"]))
        out = self._due(due, state["reported"][due], state["cycles"][due], state["ident"][due])
        state["reported"][due] = state["cycles"][due]
        return state, out

    def wake(self, state):
        passed = [np.searchsorted(self.marks, state[c], "right") for c in ("reported", "cycles")]
        open_ = state["boundary"] & (passed[1] > passed[0])
        return float(state["t"][open_].min() + self.close_s) if open_.any() else None


def marks_passed(marks: np.ndarray, before: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, mark) for each of the sorted ``marks`` above ``before`` up to ``total``."""
    low = np.searchsorted(marks, before, "right")
    n = np.maximum(np.searchsorted(marks, total, "right") - low, 0)
    which = np.repeat(np.arange(len(total)), n)
    return which, marks[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]


class Ledger(Ordered):
    """Running cycle total per run; each milestone is reported once, at the row that passes it."""

    fields = {"cycles": 0}

    def __init__(self, key, order, marks: list[int], carry: list[str]):
        super().__init__(key, order)
        self.marks, self.carry = np.array(sorted(marks)), carry

    def advance(self, state, frame):
        g = Groups(frame)
        total = state["cycles"][g.run] + g.cumsum(frame["cycles"].fillna(0).to_numpy("int64"))
        which, mark = marks_passed(self.marks, g.before(total, state["cycles"]), total)
        state["cycles"][g.runs] = total[g.tail]
        return state, g.rows(which, self.carry, milestone=mark, cycles_total=total[which])


class TimedCounter(Ordered):
    """Cycles from measured frequency; a stale reading is held up to ``hold_s``. Emits the total per batch."""

    fields = {"t": np.nan, "f": np.nan, "stale": np.nan, "cycles": 0.0}

    def __init__(self, key, order, hold_s: float):
        super().__init__(key, order)
        self.hold_s = hold_s

    def advance(self, state, frame):
        g = Groups(frame)
        t, f = frame["t_s"].to_numpy(float), frame["f"].to_numpy(float)
        dt, null = t - g.before(t, state["t"]), np.isnan(f)
        seen = g.latest(~null)
        held = np.where(seen >= 0, f[seen], state["f"][g.run])      # the last reading up to a row; before it where that row has none
        gone = null & ~np.isnan(held)
        # rows without any earlier reading are neither active nor a reset
        begin = g.streaks(gone, t, state["stale"])
        used = np.where(null, np.where(gone & (t - begin <= self.hold_s), held, np.nan), f)
        step = np.where((dt > 0) & ~np.isnan(used), used * dt, 0.0)
        state["cycles"][g.runs] += np.add.reduceat(step, g.head)
        state["t"][g.runs], state["f"][g.runs] = t[g.tail], held[g.tail]
        state["stale"][g.runs] = np.where(gone, begin, np.nan)[g.tail]
        return state, pd.DataFrame({"t_s": t[g.tail], "cycles": state["cycles"][g.runs]}, index=g.runs)


class NewCommands(Ordered):
    """Commands with a number above the last one seen; repeats and old ones are dropped."""

    fields = {"seq": -1}

    def __init__(self, key, order, carry: list[str]):
        super().__init__(key, order)
        self.carry = carry

    def advance(self, state, frame):
        g = Groups(frame)
        seq = frame["seq"].to_numpy("int64")
        top = pd.Series(g.before(seq, state["seq"])).groupby(g.run).cummax().to_numpy()
        state["seq"][g.runs] = np.maximum(top, seq)[g.tail]
        return state, g.rows(np.flatnonzero(seq > top), self.carry)


class FlagAcks(Ordered):
    """First acknowledgement of every open flag. One acknowledgement answers all flags raised before it.

    Open flags are a list of their own: new ones are put behind the others without reading them, unless a run with open ones has an
    acknowledgement.
    """

    fields = {"open": 0}

    def init(self, handle):
        super().init(handle)
        self.open = handle.getListState("open", "flags binary")

    def advance(self, state, frame):
        g = Groups(frame)
        flag = (frame["kind"] == "flag").to_numpy(bool)
        raised = pa.table({"run": g.run[flag], "id": frame["id"].to_numpy("int64")[flag], "t": frame["t_s"].to_numpy(float)[flag]})
        acked = np.unique(g.run[~flag])
        place, old = g.place[flag], 0
        if state["open"][acked].any():
            kept = pa.concat_tables([unpacked(o) for o in self.open.get()])
            answered = np.isin(kept["run"].to_numpy(), acked)
            old, rest = int(answered.sum()), kept.filter(pa.array(~answered))
            raised = pa.concat_tables([kept.filter(pa.array(answered)), raised])
            place = np.r_[np.full(old, -1), place]
            self.open.put([packed(rest)]) if rest.num_rows else self.open.clear()
        run = raised["run"].to_numpy()
        if old:                                              # a flag from before stands at its run's first row
            place = place.copy()
            place[:old] = g.head[np.searchsorted(g.runs, run[:old])]
        # the run's first acknowledgement from that row on
        answer = np.minimum.accumulate(np.where(flag, len(flag), g.place)[::-1])[::-1]
        by = np.append(answer, len(flag))[place]
        done = by <= np.append(g.tail, -1)[np.searchsorted(g.runs, run)]
        left = raised.filter(pa.array(~done))
        if left.num_rows:
            self.open.appendList([packed(left)])
        state["open"][acked] = 0
        np.add.at(state["open"], run[~done], 1)
        who, by = run[done], by[done]
        closed = raised.filter(pa.array(done))
        ident, t = frame["id"].to_numpy("int64"), frame["t_s"].to_numpy(float)
        out = pd.DataFrame({"flag_id": closed["id"].to_numpy(), "raised_at": closed["t"].to_numpy(), "acked_by": ident[by], "acked_at": t[by]}, index=who)
        return state, out


class RateLimiter(Ordered):
    """Samples that are due; the next one is due a period after the sample actually taken.

    With ``slow_s`` column ``slow`` says which of them also take the slower reading, on a schedule of its own.
    """

    fields = {"due": -np.inf, "slow_due": -np.inf}

    def __init__(self, key, order, period_s: float, carry: list[str], slow_s: float | None = None):
        super().__init__(key, order)
        self.period_s, self.carry, self.slow_s = period_s, carry, slow_s

    def advance(self, state, frame):
        g = Groups(frame)
        t, runs, low, end = frame["t_s"].to_numpy(float), g.runs, g.head, g.tail + 1
        kept, slow = [np.zeros(0, "int64")], [np.zeros(0, bool)]
        while len(runs):                                     # a round takes the next sample of every run that still has one
            low = first_from(t, low, end, state["due"][runs])
            some = low < end
            runs, low, end = runs[some], low[some], end[some]
            kept.append(low)
            state["due"][runs] = t[low] + self.period_s
            slow.append(t[low] >= state["slow_due"][runs])
            if self.slow_s is not None:
                late = slow[-1]
                state["slow_due"][runs[late]] = t[low[late]] + self.slow_s
        kept, slow = np.concatenate(kept), np.concatenate(slow)
        order = np.argsort(kept)
        out = g.rows(kept[order], self.carry)
        return state, out if self.slow_s is None else out.assign(slow=slow[order])


def first_from(t: np.ndarray, low: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First place in [low, end) of each stretch whose ``t`` is ``at`` or more, else its end; ``t`` ascends in a stretch."""
    low, high = low.copy(), end.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        below = t[middle] < at[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


class LastAttestation(Ordered):
    """Samples with the latest attestation before them, unless it is older than ``ttl_s``."""

    fields = {"id": 0, "t": np.nan}

    def __init__(self, key, order, ttl_s: float, carry: list[str]):
        super().__init__(key, order)
        self.ttl_s, self.carry = ttl_s, carry

    def advance(self, state, frame):
        g = Groups(frame)
        att, ident, t = frame["is_att"].to_numpy(bool), frame["sample_id"].to_numpy("int64"), frame["t_s"].to_numpy(float)
        last = g.latest(att)
        ids, since = (np.where(last >= 0, v[last], state[c][g.run]) for c, v in (("id", ident), ("t", t)))
        age = t - since
        fresh, rows = age <= self.ttl_s, np.flatnonzero(~att)
        out = g.rows(rows, self.carry, att_id=pd.arrays.IntegerArray(ids[rows], ~fresh[rows]), age_s=np.where(fresh, age, np.nan)[rows])
        state["id"][g.runs], state["t"][g.runs] = ids[g.tail], since[g.tail]
        return state, out


class EvidenceRing(Ordered):
    """The last ``size`` samples up to each trip; the ring of each run is kept as rows."""

    fields = {"seen": 0}

    def __init__(self, key, order, size: int):
        super().__init__(key, order)
        self.size = size

    def init(self, handle):
        super().init(handle)
        self.ring = handle.getValueState("ring", "samples binary")

    def advance(self, state, frame):
        old = unpacked(self.ring.get()) if self.ring.exists() else pa.table({"run": np.zeros(0, "int64"), "id": np.zeros(0, "int64")})
        run = np.r_[old["run"].to_numpy(), frame[RUN].to_numpy("int64")]
        order = np.argsort(run, kind="stable")
        ids = np.r_[old["id"].to_numpy(), frame["sample_id"].to_numpy("int64")][order]
        g = Groups(pd.DataFrame({RUN: run[order]}))
        trips = np.flatnonzero(np.r_[np.zeros(len(old), bool), frame["trip"].to_numpy(bool)][order])
        last = np.repeat(g.tail, g.tail - g.head + 1) - g.place < self.size
        self.ring.update(packed(pa.table({"run": g.run[last], "id": ids[last]})))
        length = np.minimum(trips - g.begin[trips] + 1, self.size)
        step = max(1, OUTPUT_ROWS // self.size)

        def parts():
            for a in range(0, len(trips), step):
                trip, n = trips[a:a + step], length[a:a + step]
                age = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"trip_id": np.repeat(ids[trip], n), "sample_id": ids[np.repeat(trip, n) - age], "age": age}, index=np.repeat(g.run[trip], n))
        return state, parts()

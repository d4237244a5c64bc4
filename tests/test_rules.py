"""Rule semantics against plain state machines and the worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from stamina.operators import feasibility as D
from stamina.operators import ledger as L
from stamina.operators import rules as R
from stamina.streaming.processors import BlindLadder, FlagAcks, RateLimiter, Sustained, TimedCounter, Watchdog


class Kept(list):
    """A list state outside of a stream."""

    def exists(self):
        return len(self) > 0

    def get(self):
        return iter(list(self))

    def put(self, rows):
        self[:] = rows

    appendList = list.extend


def series(seed, n=70):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0.5, 1.0, 3.0])
        off = rng.random() < 0.15
        ua = None if off or rng.random() < 0.25 else rng.choice([0.0, 90.0, 120.0])
        f = None if rng.random() < 0.4 else rng.choice([4.0, 5.0])
        out.append((rng.choice(["r1", "r1", "r2"]), i, t, ua, off, f))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, id int, t_s double, ua double, off boolean, f double")


def loop_sustained(rows, sustain):
    since, fired, out = {}, set(), set()
    for run, i, t, ua, *_ in rows:
        if ua is None:
            continue
        if ua > 50:
            since.setdefault(run, t)
            if t - since[run] >= sustain and run not in fired:
                fired.add(run)
                out.add(i)
        else:
            since.pop(run, None)
            fired.discard(run)
    return out


def loop_watchdog(rows, confirm):
    since, out = {}, {}
    for run, i, t, ua, off, _ in rows:
        if run in out or (ua is None and not off):
            continue
        if off or abs(ua) >= 100:
            if run not in since:
                since[run] = t
            elif t - since[run] >= confirm:
                out[run] = i
        else:
            since.pop(run, None)
    return set(out.values())


def loop_count(rows, hold):
    state = {}
    for run, _, t, _, _, f in rows:
        s = state.setdefault(run, {"t": None, "f": None, "stale": None, "n": 0.0})
        if s["t"] is not None:
            use = None
            if f is not None:
                use, s["stale"] = f, None
            elif s["f"] is not None:
                s["stale"] = t if s["stale"] is None else s["stale"]
                use = s["f"] if t - s["stale"] <= hold else None
            if use is not None and t > s["t"]:
                s["n"] += use * (t - s["t"])
        s["f"], s["t"] = (f if f is not None else s["f"]), t
    return {k: v["n"] for k, v in state.items()}


@pytest.mark.parametrize("seed", [1])
def test_sustained_watchdog_and_counter(spark, segment, seed):
    rows = series(seed)
    df = frame(spark, rows)
    got = {r.id for r in R.sustained(df, ["run"], ["t_s", "id"], "t_s", F.col("ua") > 50, F.lit(2.0)).collect()}
    assert got == loop_sustained(rows, 2.0)
    got = {r.id for r in R.watchdog(df, ["run"], ["t_s", "id"], "t_s", F.col("ua"), F.col("off"), 100.0, 3.0).collect()}
    assert got == loop_watchdog(rows, 3.0)
    got = {r.run: r.cycles for r in L.timed_count(df, ["run"], ["t_s", "id"], "t_s", F.col("f"), F.lit(5.0), 2.0).collect()}
    assert got == pytest.approx(loop_count(rows, 2.0))


@pytest.mark.parametrize("seed", range(6))
def test_stream_processors_equal_loops_over_batches(seed):
    import pandas as pd
    rows = [r for r in series(seed, 120) if r[0] == "r1"]
    pdf = pd.DataFrame(rows, columns=["run", "id", "t_s", "ua", "off", "f"])
    pdf["over"] = [None if u is None else u > 50 for u in (r[3] for r in rows)]
    cuts = [0, 17, 18, 60, len(pdf)]

    def drain(proc, f):
        state, out = proc.initial, []
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                state, o = proc.advance(state, f.iloc[a:b].reset_index(drop=True))
                out.append(o)
        return pd.concat(out)
    assert set(drain(Sustained("run", ["t_s"], 2.0, ["id"]), pdf)["id"]) == loop_sustained(rows, 2.0)
    w = pdf.assign(over=[True if r[4] else None if r[3] is None else abs(r[3]) >= 100 for r in rows])
    assert set(drain(Watchdog("run", ["t_s"], 3.0, ["id"]), w)["id"]) == loop_watchdog(rows, 3.0)
    n = drain(TimedCounter("run", ["t_s"], 2.0), pdf)["cycles"].iloc[-1]
    assert n == pytest.approx(loop_count(rows, 2.0)["r1"])
    due, want = float("-inf"), []
    for r in rows:
        if r[2] >= due:
            want.append(r[1])
            due = r[2] + 4.0
    assert list(drain(RateLimiter("run", ["t_s"], 4.0, ["id"]), pdf)["id"]) == want
    slow, want_slow = float("-inf"), []
    for t in (r[2] for r in rows if r[1] in set(want)):
        want_slow.append(t >= slow)
        slow = t + 9.0 if t >= slow else slow
    both = drain(RateLimiter("run", ["t_s"], 4.0, ["id"], slow_s=9.0), pdf)
    assert list(both["id"]) == want and list(both["slow"]) == want_slow
    kinds, open_, want = ["ack" if r[3] is None else "flag" for r in rows], [], []
    for kind, r in zip(kinds, rows):
        if kind == "flag":
            open_.append((r[1], r[2]))
        else:
            want += [(*o, r[1], r[2]) for o in open_]
            open_ = []
    proc = FlagAcks("run", ["id"])
    proc.open = Kept()
    acks = drain(proc, pdf.assign(kind=kinds))
    assert list(acks.itertuples(index=False, name=None)) == want and want
    b = drain(BlindLadder("run", ["t_s"], 2.0, ["id"]), pdf.assign(readable=[r[3] is not None or r[4] for r in rows]))
    since, warned, want = None, False, []
    for r in rows:
        if r[3] is None and not r[4]:
            since = r[2] if since is None else since
            if r[2] - since >= 2.0 and not warned:
                warned = True
                want.append((r[1], "warn"))
        else:
            if warned:
                want.append((r[1], "recovered"))
            since, warned = None, False
    assert list(zip(b["id"], b["ladder"])) == want


def test_sustain_examples(spark):
    def fire(pts):
        df = spark.createDataFrame([("r", i, float(t), v) for i, (t, v) in enumerate(pts)], "run string, id int, t_s double, v double")
        return R.sustained(df, ["run"], ["t_s", "id"], "t_s", F.col("v") > 0.05, F.lit(5.0)).count()
    assert fire([(0, .1), (2, .1), (5.5, .1)]) == 1
    assert fire([(0, .1), (3, .01), (6, .1)]) == 0
    assert fire([(0, .1), (3, None), (5.5, .1)]) == 1


def test_merge_keeps_unnamed_fields(spark):
    d = R.default_rules(spark)
    o = spark.createDataFrame([("slow", "amplitude", None, None, 0.5, None, None, None), ("slow", "new", "m", ">", 1.0, None, None, "warn")], R.RULE_SCHEMA)
    m = {r.rule_id: r for r in R.merge_rules(d, o).collect()}
    assert m["amplitude"].threshold == 0.5 and m["amplitude"].op == "<" and m["amplitude"].flag_at == 0.9
    assert m["new"].action == "warn" and len(m) == len(R.DEFAULT_RULES) + 1


def test_worked_examples(spark):
    one = spark.range(1)
    v = one.select(
        D.peak_current(F.lit(5.0), F.lit(5.0), F.lit(1.5), F.lit(0.0)).alias("ipk"),
        D.square_drive(F.lit(5.0), F.lit(10.0), F.lit(2.0), F.lit(0.0))["edge_s"].alias("edge"),
        D.required_tiered(F.lit(15.0), F.lit(100.0)).alias("life"), D.required_tiered(F.lit(2.0), F.lit(0.0)).alias("floor"),
        L.dose(F.lit("cycle"), F.lit(1000), F.lit(5.0), F.lit("sine"), F.lit(0.0), F.lit(0.0)).alias("dose"),
        L.dose(F.lit("dc_hold"), F.lit(0), F.lit(1.0), F.lit("sine"), F.lit(20.0), F.lit(0.0)).alias("none")).first()
    assert v.ipk == pytest.approx(117.8, abs=0.05) and v.edge == pytest.approx(20 / 1950)
    assert (v.life, v.floor, v.dose, v.none) == (520, 40, 100.0, 0.0)


def test_rules_are_broadcast_to_the_metrics(spark):
    """A shuffle by metric would give as many tasks as rules."""
    m = spark.range(0, 4000, 1, 8).select("id", F.element_at(F.array(F.lit("ipk_frac"), F.lit("env_out_of_band")), (F.col("id") % 2 + 1).cast("int")).alias("metric"),
                                          (F.col("id") % 4 / 2).alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.fire_plain(m, R.default_rules(spark), "medium")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {(r.metric, r["count"]) for r in out.groupBy("metric").count().collect()} == {("ipk_frac", 1000), ("env_out_of_band", 1000)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

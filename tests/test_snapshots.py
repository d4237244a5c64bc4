import pytest
from pyspark.sql import functions as F

from stamina.operators import snapshots as N


def run(spark, uas, areas=None, kvs=None):
    areas = areas or {}
    rows = [("r", i, (kvs or {}).get(i, (i + 1) * 0.25), u, areas.get(i)) for i, u in enumerate(uas)]
    b = N.breakdown(spark.createDataFrame(rows, "run string, row_idx bigint, kv double, ua double, area double"), ["run"]).collect()
    return sorted(r.row_idx for r in b if r.confirmed), sorted(r.row_idx for r in b if r.advisory)


STAIR = [.8, .4, .3, .5, .2, -5., -26.7, -61.9, -123.4, -207.7, -3.3, -4.1]
QUIET = [.9, .9, 1., .9, .8, .9, -57.4]
COLLAPSE = [-16., -16.1, -15.9, -16., -16.2, -16., -16.1, -16.]
AREAS = {2: 1000., 3: 990., 5: 620.}
SERIES = {
    "staircase": (STAIR, {}, ([6, 7, 8, 9], [])), "terminal": (QUIET, {}, ([6], [])),
    "terminal then blank": (QUIET + [None, None], {}, ([6], [])),
    "recovered": ([-16., -15.9, -16.1, -16., -153.4, -15.8, -16., -15.9], {}, ([], [4])),
    "offset low": ([-16.] * 6 + [14., 15.] + [-16.] * 2, {}, ([6, 7], [])),
    "offset high": ([.9] * 6 + [30.9, 31.9] + [.9] * 2, {}, ([6, 7], [])),
    "blank between": ([0., .1, -.1, 0., .1, 50., None, 51., 0.], {}, ([], [5, 7])),
    "collapse alone": (COLLAPSE, AREAS, ([], [5])),
    "collapse with event": (COLLAPSE[:5] + [-80.] + COLLAPSE[6:], AREAS, ([5], [])),
}


def test_incident_series(spark, segment):
    rows = [(n, i, (i + 1) * .25, u, areas.get(i)) for n, (uas, areas, _) in SERIES.items() for i, u in enumerate(uas)]
    b = N.breakdown(spark.createDataFrame(rows, "run string, row_idx bigint, kv double, ua double, area double"), ["run"]).collect()
    for n, (_, _, want) in SERIES.items():
        mine = [r for r in b if r.run == n]
        assert (sorted(r.row_idx for r in mine if r.confirmed), sorted(r.row_idx for r in mine if r.advisory)) == want, n


def test_fewer_than_five_readings_use_absolute_rules(spark):
    assert run(spark, [2., 120., 3., 4.], {0: 1000., 2: 1050., 3: 300.}, {0: 1., 1: 2., 2: 3., 3: 4.}) == ([1, 3], [])


def test_pair_agreement_and_contradiction(spark):
    rows = [("r", 0, 1., 100000., .80, .5, False), ("r", 1, 1., 101000., .78, .5, False),
            ("r", 2, 2., 140000., .92, .4, False), ("r", 3, 2., 60000., .88, None, False)]
    df = spark.createDataFrame(rows, "run string, row_idx bigint, kv double, area double, conf double, ci85_pct double, audited boolean")
    r = {x.row_idx: x for x in N.reconcile_pairs(df, ["run"]).collect()}
    assert r[0].conf == pytest.approx(.85) and r[1].conf == pytest.approx(.83) and r[0].pair == "confirmed"
    assert r[2].conf == r[3].conf == pytest.approx(.74) and r[2].mismatch_pct == pytest.approx(80.0)


def test_ramp_issues(spark):
    areas = [100., 102., 140., 90., 60., 61.]
    rows = [("r", i, float(i // 2 + 1), a) for i, a in enumerate(areas)]
    df = spark.createDataFrame(rows, "run string, row_idx bigint, kv double, area double")
    got = {r.row_idx: r.issue for r in N.consistency(df, ["run"]).collect()}
    assert got == {2: "pair mismatch", 3: "pair mismatch", 4: "area dip"}


def test_one_scale_after_a_partial_review(spark):
    old, new = .04306, .05333
    rows = [(i, 1000. + i, (1000. + i) * old * old, 2 * ((1000. + i) / 3.141592653589793) ** .5 * old) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, px double, mm2 double, diam double")
    acc = spark.createDataFrame([(0, 1200., 39.), (1, None, None)], "k int, area_px double, diam_px double")
    out = {r.k: r for r in N.apply_results(df, acc, "k", F.lit(new)).collect()}
    for r in out.values():
        if r.mm2 is not None:
            assert (r.mm2 / r.px) ** .5 == pytest.approx(new)
    assert out[1].state == "rejected" and out[1].px is None and out[2].state == "absent"


def test_branding_is_symmetric(spark):
    rows = [("r", 0, None, "a_BREAKDOWN.png", "post-breakdown; x"), ("r", 1, "current", "b.png", "y"), ("r", 2, None, "c.png", None)]
    df = spark.createDataFrame(rows, "run string, row_idx bigint, confirmed string, frame_file string, notes string")
    b = {r.row_idx: r for r in N.brand(df, ["run"]).collect()}
    assert (b[0].new_file, b[0].new_notes) == ("a.png", "x")
    assert (b[1].new_file, b[1].new_notes) == ("b_BREAKDOWN.png", "y")
    assert (b[2].new_file, b[2].new_notes) == ("c_BREAKDOWN.png", "post-breakdown")

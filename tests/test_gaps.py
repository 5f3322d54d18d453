import datetime
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketlake.operators import gaps
from marketlake.plans.gap_report import gap_report, prepared_rows
from marketlake.sources.events import dirty_data_table, macro_events_table, splits_table
from tests.conftest import day


def rows_of(df):
    return sorted((r.instrument, str(r.date), r.open, r.close) for r in df.collect())


def test_scan_rules(make_bars):
    bars = make_bars(
        [
            (" aaa ", "2024-01-01", None, 10.0),  # open falls back
            ("AAA", "2024-01-02", 5.0, 0.0),  # zero close
            ("AAA", "2024-01-03", 0.0, 5.0),  # zero open
            ("AAA", "2024-01-04", 5.0, None),  # no close
            ("AAA", "2024-01-05", float("nan"), 7.0),  # NaN counts as missing
            (None, "2024-01-06", 5.0, 5.0),
        ]
    )
    assert rows_of(gaps.scan_rows(bars)) == [
        ("AAA", "2024-01-01", 10.0, 10.0),
        ("AAA", "2024-01-05", 7.0, 7.0),
    ]
    assert gaps.scan_rows(bars.drop("close")).count() == 0
    assert rows_of(gaps.scan_rows(bars.drop("open")))[0] == ("AAA", "2024-01-01", 10.0, 10.0)


def test_csv_rows_need_an_open(spark):
    lines = spark.createDataFrame(
        [
            ("2024-01-01", "1", "2", "aaa"),
            ("2024-01-02", None, "2", "aaa"),
            ("soon", "1", "2", "aaa"),
            ("2024-01-03", "0", "2", "aaa"),
            ("2024-01-04", "x", "2", "aaa"),
        ],
        "date string, open string, close string, ticker string",
    )
    assert rows_of(gaps.csv_rows(lines)) == [("AAA", "2024-01-01", 1.0, 2.0)]


def test_first_source_wins(spark, make_bars):
    stored = gaps.scan_rows(make_bars([("A", "2024-01-01", 5.0, 6.0)]))
    extra = gaps.scan_rows(make_bars([("A", "2024-01-01", 1.0, 1.0), ("A", "2024-01-02", 2.0, 2.0)]))
    assert rows_of(gaps.first_seen([stored, extra])) == [
        ("A", "2024-01-01", 5.0, 6.0),
        ("A", "2024-01-02", 2.0, 2.0),
    ]


def test_a_gap_equal_to_the_threshold_is_no_alert(make_bars):
    bars = make_bars(
        [
            ("A", "2024-01-01", 10.0, 10.0),
            ("A", "2024-01-02", 13.0, 10.0),  # exactly +30 %
            ("A", "2024-01-05", 13.5, 20.0),
            ("A", "2024-01-06", 2.0, 2.0),
        ]
    )
    alerts = gaps.detect_gaps(prepared_rows(bars)).orderBy("date").collect()
    assert [(str(a.date), a.tipo, a.variacion_pct, a.ratio_implicito) for a in alerts] == [
        ("2024-01-05", "split_inverso_candidato", 35.0, 1.35),
        ("2024-01-06", "split_candidato", -90.0, 10.0),
    ]
    assert alerts[0].date_str == "05/01/2024"


def test_zero_rows_are_dropped_before_the_lag(make_bars):
    bars = make_bars([("A", "2024-01-01", 10.0, 10.0), ("A", "2024-01-02", 1.0, 0.0), ("A", "2024-01-03", 20.0, 20.0)])
    alert = gaps.detect_gaps(prepared_rows(bars)).first()
    assert (alert.prev_close, alert.open_next) == (10.0, 20.0)


def test_context_at_the_start_of_a_series(make_bars):
    closes = [10.0, 20.0, 21.0, 22.0, 23.0, 24.0]
    bars = make_bars([("A", f"2024-01-{i + 1:02d}", c, c) for i, c in enumerate(closes)])
    alert = gaps.detect_gaps_with_context(prepared_rows(bars)).first()
    assert [c.fecha for c in alert.context] == [f"0{d}/01/2024" for d in range(1, 6)]
    assert [c.is_event for c in alert.context] == [False, True, False, False, False]
    assert alert.context[0].var_dia_pct is None and alert.context[1].var_dia_pct == 100.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([1.0, 1.2, 1.5, 3.0, 4.0]), min_size=1, max_size=12))
def test_gaps_equal_a_plain_loop(make_bars, closes):
    start = datetime.date(2024, 1, 1)
    rows = [("A", str(start + datetime.timedelta(3 * i)), c, c) for i, c in enumerate(closes)]
    want = []
    for i, (a, b) in enumerate(itertools.pairwise(closes)):
        if abs((b - a) / a * 100) > 30:
            around = min(i + 1, 3) + 1 + min(len(closes) - i - 2, 3)
            want.append((rows[i + 1][1], around))
    got = gaps.detect_gaps_with_context(prepared_rows(make_bars(rows))).orderBy("date").collect()
    assert [(str(g.date), len(g.context)) for g in got] == want


def test_membership_labels(spark, make_bars):
    bars = make_bars([("A", "2024-01-01", 1.0, 1.0), ("A", "2024-01-02", 2.0, 2.0), ("A", "2024-01-03", 9.0, 9.0)])
    members = spark.createDataFrame([(" a", day("2024-01-02")), ("A", None)], "ticker string, date date")
    got = gap_report(bars, members).orderBy("date").collect()
    assert [g.en_indice for g in got] == ["Sí", "No"]
    assert [r.en_indice for r in gaps.report(gap_report(bars)).collect()] == ["", ""]
    totals = {(r.tipo, r.en_indice): r.n for r in gaps.alert_totals(gap_report(bars, members)).collect()}
    assert totals == {("split_inverso_candidato", "Sí"): 1, ("split_inverso_candidato", "No"): 1}
    assert gaps.membership(members.drop("date")).count() == 0
    assert gap_report(bars, instrument="b").count() == 0


def test_classification_order(spark, make_bars):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]
    bars = make_bars([("A", d, 10.0 ** (i + 1), 10.0 ** (i + 1)) for i, d in enumerate(days)])
    splits = splits_table(spark, [{"ticker": "A", "date": days[1], "ratio": 2}])
    events = macro_events_table(
        spark, [{"date": d, "tickers_affected": ["a"], "direction": "negative"} for d in days[1:3]]
    )
    dirty = dirty_data_table(spark, [{"ticker": "A", "date": days[3], "field": "open", "value": 1}])
    alerts = gaps.detect_gaps(prepared_rows(bars))
    got = gaps.classify_alerts(alerts, splits, events, dirty).orderBy("date").collect()
    assert [g.cause for g in got] == ["confirmed_split", "macro_event", "dirty_data", "unexplained"]
    dummies = gaps.event_dummies(bars, events).orderBy("date").collect()
    assert [d.macro_event for d in dummies] == [0, -1, -1, 0, 0]


def test_context_is_whole_for_every_alert(make_bars):
    bars = make_bars([("A", f"2024-01-{i:02d}", 10.0 ** (i % 2), 10.0 ** (i % 2)) for i in range(1, 21)])
    sizes = [len(r.context) for r in gaps.detect_gaps_with_context(prepared_rows(bars)).orderBy("date").collect()]
    assert sizes == [5, 6] + [7] * 14 + [6, 5, 4]


def test_threshold_is_a_parameter(make_bars):
    bars = make_bars([("A", "2024-01-01", 10.0, 10.0), ("A", "2024-01-02", 11.0, 11.0)])
    assert gap_report(bars).count() == 0
    assert gap_report(bars, threshold=5.0).count() == 1
    assert pytest.approx(10.0) == gap_report(bars, threshold=5.0).first().variacion_pct

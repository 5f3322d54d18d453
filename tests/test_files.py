import datetime
import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketlake.functions import instrument_id, instrument_ticker, spanish_number
from marketlake.operators.gaps import csv_rows
from marketlake.plans.adjust_all import adjust_all
from marketlake.plans.ingest import ingest, stored_bars
from marketlake.plans.normalise import normalise_all
from marketlake.sinks import export_bars, export_report, log_run, save_bars, save_table
from marketlake.sources import composition as files
from marketlake.sources import events, store
from marketlake.sources.prices import read_price_csv
from marketlake.sources.responses import bars_from_responses, read_responses, validated
from marketlake.streaming.ingest import ingest_available
from tests.conftest import day

FROM, TO = datetime.date(2024, 1, 1), datetime.date(2024, 12, 31)


def write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


@pytest.fixture
def base(tmp_path):
    h = "ticker;cantidades_vigentes;close;fecha_cantidades_vigentes;fecha_precio\n"
    write(tmp_path / "Cartera Historica/cartera_historica_1.csv", h + "GGAL;10.5;100.25;2024-01-01;2024-01-02\n")
    write(tmp_path / "Cartera Historica/cartera_historica_2.csv", h + "BYMA;NA;NA;2024-01-01;2024-01-03\n")
    p = tmp_path / "Cartera Proyectada"
    write(p / "proyectada_20240105.csv", '"contrato";"cantidad"\n"GGAL";"1234,5"\n"BYMA";"NA"\n')
    write(p / "proyectada_last.csv", '"contrato";"cantidad"\n"GGAL";"1"\n')
    write(p / "proyectada_20240106.csv", '"contrato";"cantidad"\n"GGAL";"1"\n"BYMA";"many"\n')
    write(tmp_path / "Cartera Vigente/nvas_cantidades_20240201.csv", "contrato;cantidad\nGGAL;7,25\n")
    write(tmp_path / "Cartera Vigente/nvas_cantidades_pre_split_20240301.csv", '"contrato";"cantidad"\n"GGAL";"8"\n')
    write(tmp_path / "spot.csv", "fecha_precio;valor\n2024-01-02;1000,75\n")
    write(tmp_path / "divisores.csv", "fecha_divisor;divisor\n06/07/2022;1500,5\n")
    write(
        tmp_path / "dividendos.csv",
        "Especie;Monto;Fecha de Ajuste;tipo\nBYMA;9;6/7/2022;AC\nGGAL;1.234,56;06/12/2023;EF\n",
    )
    return str(tmp_path)


def rows(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_historical(spark, base):
    df = files.load_historical(spark, base)
    assert df.columns == ["date", "ticker", "quantity", "close", "source"]
    assert rows(df, *df.columns) == [
        ("2024-01-02", "GGAL", "10.5", "100.25", "historica"),
        ("2024-01-03", "BYMA", "None", "None", "historica"),
    ]


def test_dated_files(spark, base):
    projected = files.load_projected(spark, base)
    assert rows(projected, "date", "ticker", "quantity", "source") == [
        ("2024-01-05", "BYMA", "None", "proyectada"),
        ("2024-01-05", "GGAL", "1234.5", "proyectada"),
    ]
    rejected = {r.file.rsplit("/", 1)[1]: r.reason for r in files.rejected_files(spark, base, "proyectada").collect()}
    assert rejected == {
        "proyectada_last.csv": "no date in name",
        "proyectada_20240106.csv": "unreadable number",
    }
    assert rows(files.load_current(spark, base), "date", "quantity") == [
        ("2024-02-01", "7.25"),
        ("2024-03-01", "8.0"),
    ]


def test_no_files_give_an_empty_table(spark, tmp_path):
    empty = files.load_projected(spark, str(tmp_path))
    assert empty.columns == ["date", "ticker", "quantity", "source"] and empty.count() == 0
    assert files.rejected_files(spark, str(tmp_path), "vigente").count() == 0
    with pytest.raises(ValueError):
        files.load_composition(spark, str(tmp_path), "other")


def test_files_are_read_once_for_rows_and_report(spark, base):
    folder = Path(base) / "Cartera Proyectada"
    write(folder / "proyectada_20240107.csv", '"contrato";"cantidad"\n"GGAL";"1";"2";"3"\n')
    accepted, rejected = files.screened(spark, base, "proyectada")
    for f in folder.iterdir():
        f.unlink()  # both results come from what was kept
    assert rows(accepted, "ticker", "quantity") == [("BYMA", "None"), ("GGAL", "1234.5")]
    assert {r.file.rsplit("/", 1)[1]: r.reason for r in rejected.collect()} == {
        "proyectada_last.csv": "no date in name",
        "proyectada_20240106.csv": "unreadable number",
        "proyectada_20240107.csv": "wrong number of fields",
    }


def test_price_csv(spark, tmp_path):
    write(tmp_path / "p.csv", "close,extra,ticker,date,open\n2.5,x,ggal ,2024-01-02,2\n1,x,GGAL,someday,1\n,x,BYMA,2024-01-02,1\n")
    lines = read_price_csv(spark, str(tmp_path / "p.csv"))
    assert lines.columns == ["ticker", "date", "open", "close"] and lines.count() == 3
    assert rows(csv_rows(lines), "instrument", "date", "open", "close") == [("GGAL", "2024-01-02", "2.0", "2.5")]
    write(tmp_path / "q.csv", "ticker,date\nA,2024-01-02\n")
    with pytest.raises(ValueError, match="open, close"):
        read_price_csv(spark, str(tmp_path / "q.csv"))


def test_an_impossible_date_in_the_name_fails(spark, tmp_path):
    write(tmp_path / "Cartera Proyectada/proyectada_20241399.csv", "contrato;cantidad\nGGAL;1\n")
    with pytest.raises(PySparkException):
        files.load_projected(spark, str(tmp_path)).collect()


def test_series_files(spark, base):
    assert rows(files.load_spot(spark, f"{base}/spot.csv"), "date", "value") == [("2024-01-02", "1000.75")]
    assert rows(files.load_divisors(spark, f"{base}/divisores.csv"), "date", "divisor") == [("2022-07-06", "1500.5")]
    dividends = files.load_dividends(spark, f"{base}/dividendos.csv")
    assert rows(dividends, "ticker", "amount", "date", "type") == [
        ("BYMA", "9.0", "2022-07-06", "AC"),
        ("GGAL", "1234.56", "2023-12-06", "EF"),
    ]


def test_normalise_all(spark, base, tmp_path):
    root = str(tmp_path / "lake")
    summary = {r.dataset: r for r in normalise_all(spark, base, root).collect()}
    assert (summary["composition"].n_rows, summary["composition"].n_tickers) == (2, 2)
    assert summary["dividends"].date_max == day("2023-12-06") and summary["spot"].n_tickers is None
    assert store.load_table(spark, root, "raw", "divisor").count() == 1


def test_spanish_numbers(spark):
    texts = ["1.234.567,89", "5", "0,5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(spanish_number(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [1234567.89, 5.0, 0.5]


def test_instrument_codes(spark):
    df = spark.createDataFrame([("GGAL",)], "t string").select(instrument_id(F.col("t")).alias("c"))
    assert df.first().c == "bm_MERV_GGAL_24hs"
    codes = spark.createDataFrame([("bm_MERV_YPFD_24hs",), ("YPFD_24hs",), ("bm_MERV_YPFD",), (None,)], "c string")
    loose = codes.select(instrument_ticker(F.col("c"), strict=False).alias("t"))
    assert [r.t for r in loose.collect()] == ["YPFD", None, None, None]
    with pytest.raises(PySparkException):
        codes.select(instrument_ticker(F.col("c"))).collect()


RECORD = {"c": 31.5, "d": "2024-11-28T00:00:00Z", "h": 33.25, "l": 30.0, "o": 32, "r": "D", "sid": "x", "v": 10}


@pytest.fixture
def bodies(spark):
    cases = {
        "OK": json.dumps({"nextTime": None, "noData": False, "series": [RECORD, {**RECORD, "d": "2024-11-27T00:00:00Z"}]}),
        "EMPTY": json.dumps({"nextTime": None, "noData": False, "series": []}),
        "NODATA": json.dumps({"noData": True, "series": []}),
        "PARTIAL": json.dumps({"series": [{"c": 1.0, "d": "2024-01-02T00:00:00Z"}]}),
        "QUOTED": json.dumps({"series": [{**RECORD, "c": "12.5"}]}),
        "BADDATE": json.dumps({"series": [RECORD, {**RECORD, "d": "soon"}]}),
        "BADNUMBER": json.dumps({"series": [{**RECORD, "v": "many"}]}),
        "NOSERIES": json.dumps({"noData": False}),
        "OBJECT": json.dumps({"series": {"c": 1}}),
        "NULL": "null",
        "LIST": "[]",
        "TEXT": "<html>",
    }
    return spark.createDataFrame(list(cases.items()), "ticker string, body string")


def test_validation(bodies):
    valid = {r.ticker for r in validated(bodies).filter("valid").collect()}
    assert valid == {"OK", "EMPTY", "NODATA", "PARTIAL", "QUOTED", "BADDATE", "BADNUMBER"}
    readable = {r.ticker for r in validated(bodies).filter("readable").collect()}
    assert valid - readable == {"BADDATE", "BADNUMBER"}


def test_bars_from_responses(bodies):
    bars = bars_from_responses(bodies)
    assert bars.columns == ["date", "open", "high", "low", "close", "volume", "ticker"]
    assert rows(bars.filter("ticker = 'OK'"), *bars.columns) == [
        ("2024-11-27", "32.0", "33.25", "30.0", "31.5", "10.0", "OK"),
        ("2024-11-28", "32.0", "33.25", "30.0", "31.5", "10.0", "OK"),
    ]
    assert bars.filter("ticker = 'PARTIAL'").first().open is None
    assert bars.filter("ticker = 'QUOTED'").first().close == 12.5
    assert bars.filter("ticker like 'BAD%'").count() == 0


def test_ingest_is_idempotent(spark, bodies, tmp_path):
    root = str(tmp_path)
    first = {r.ticker: (r.ok, r.rows, r.reason) for r in ingest(bodies, root, FROM, TO).collect()}
    assert first["OK"] == (True, 2, "written") and first["EMPTY"] == (True, 0, "no rows in range")
    assert first["LIST"] == (False, 0, "invalid response")
    assert first["BADDATE"] == (False, 0, "unreadable record")
    again = {r.ticker: (r.ok, r.rows, r.reason) for r in ingest(bodies, root, FROM, TO).collect()}
    assert again["OK"] == (True, 0, "already stored") and stored_bars(spark, root).count() == 4
    later = json.dumps({"series": [RECORD, {**RECORD, "d": "2024-11-29T00:00:00Z"}]})
    more = spark.createDataFrame([("OK", later)], "ticker string, body string")
    assert ingest(more, root, FROM, TO, extend=False).first().reason == "already stored"
    assert tuple(ingest(more, root, FROM, TO).first())[1:] == (True, 1, "extended")
    assert ingest(more, root, FROM, TO).first().reason == "already stored"
    assert stored_bars(spark, root).count() == 5


def test_ingest_checks_its_arguments(spark, bodies, tmp_path):
    with pytest.raises(ValueError):
        ingest(bodies, str(tmp_path), TO, FROM)
    with pytest.raises(ValueError):
        ingest(bodies.limit(0), str(tmp_path), FROM, TO)


def test_stream_ingest(spark, bodies, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "lake")
    for _ in range(2):
        bodies.write.mode("append").json(landing)
        ingest_available(spark, landing, root, str(tmp_path / "checkpoint")).awaitTermination()
        assert stored_bars(spark, root).count() == 4
    assert read_responses(spark, landing).count() == 24


EVENTS = """
splits:
  - {ticker: ggal, date: "2024-11-28", ratio: 2, in_index: true, verified: true, notes: n}
  - {ticker: GGAL, date: 2023-01-02, ratio: 3.0}
macro_events:
  - {date: "2019-08-12", description: d, tickers_affected: [BYMA, GGAL], direction: negative}
dirty_data:
  - {ticker: bbar, date: "2019-06-11", field: open, value: 260.0, expected_range: [140.0, 160.0]}
"""


def test_events_file(spark, tmp_path):
    write(tmp_path / "events.yaml", EVENTS)
    got = events.load_events(spark, tmp_path / "events.yaml")
    newest = events.splits_of(got["splits"], "ggal").collect()
    assert [(str(r.date), r.ratio, r.in_index, r.verified) for r in newest] == [
        ("2024-11-28", 2.0, True, True),
        ("2023-01-02", 3.0, False, False),
    ]
    assert got["macro_events"].first().tickers_affected == ["BYMA", "GGAL"]
    assert got["dirty_data"].first().expected_range == [140.0, 160.0]
    write(tmp_path / "empty.yaml", "")
    empty = events.load_events(spark, tmp_path / "empty.yaml")
    assert {k: v.count() for k, v in empty.items()} == {"splits": 0, "macro_events": 0, "dirty_data": 0}


def test_adjust_all(spark, make_bars, tmp_path):
    root = str(tmp_path)
    raw = make_bars([("GGAL", "2024-11-27", 10.0, 10.0), ("GGAL", "2024-11-28", 5.0, 5.0), ("BYMA", "2024-11-28", 7.0, 7.0)])
    save_bars(raw, root, "raw", "ohlcv")
    splits = events.splits_table(spark, [{"ticker": "GGAL", "date": "2024-11-28", "ratio": 2}])
    asked = spark.createDataFrame([("ggal",), ("BYMA",), ("NONE",)], "ticker string")
    status = {r.ticker: (r.ok, r.rows) for r in adjust_all(spark, root, splits, asked).collect()}
    assert status == {"GGAL": (True, 2), "BYMA": (True, 1), "NONE": (False, 0)}
    out = store.load_table(spark, root, "processed", "ohlcv")
    assert rows(out, "ticker", "date", "close", "volume") == [
        ("BYMA", "2024-11-28", "7.0", "100.0"),
        ("GGAL", "2024-11-27", "5.0", "200.0"),
        ("GGAL", "2024-11-28", "5.0", "100.0"),
    ]


def test_adjusting_some_tickers_keeps_the_others(spark, make_bars, tmp_path):
    root = str(tmp_path)
    save_bars(make_bars([("A", "2024-01-02", 8.0, 8.0), ("b", "2024-01-02", 6.0, 6.0), ("C", "2024-01-02", 4.0, 4.0)]), root, "raw", "ohlcv")
    splits = events.splits_table(spark, [{"ticker": "B", "date": "2024-01-03", "ratio": 2}])
    assert adjust_all(spark, root, splits).count() == 3
    more = events.splits_table(spark, [{"ticker": "B", "date": "2024-01-03", "ratio": 3}])
    asked = spark.createDataFrame([("B",)], "ticker string")
    assert [tuple(r) for r in adjust_all(spark, root, more, asked).collect()] == [("B", True, 1, "written")]
    out = store.load_table(spark, root, "processed", "ohlcv")
    assert rows(out, "ticker", "close") == [("A", "8.0"), ("C", "4.0"), ("b", "2.0")]


def test_store(spark, make_bars, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        store.load_table(spark, root, "raw", "x")
    with pytest.raises(ValueError):
        save_table(make_bars([("A", "2024-01-01", 1.0, 1.0)]), root, "other", "x")
    assert not store.table_exists(spark, root, "raw", "x")
    built = []
    for _ in range(2):
        df = store.load_or_build(
            spark, root, "raw", "x", lambda: built.append(1) or make_bars([("A", "2024-01-01", 1.0, 1.0)])
        )
    assert df.count() == 1 and built == [1]
    assert store.table_exists(spark, root, "raw", "x") and not store.table_exists(spark, root, "raw", "x", "v2")


def test_run_log(spark, tmp_path):
    root = str(tmp_path)
    assert store.load_runs(spark, root).count() == 0
    ids = [log_run(spark, root, m, {"alpha": a}, {"rmse": a / 10}) for m, a in (("lin", 1), ("tree", 2), ("lin", 3))]
    runs = store.load_runs(spark, root, "lin").select("run_id", F.variant_get("metrics", "$.rmse", "double").alias("m"))
    assert [(r.run_id, r.m) for r in runs.collect()] == [(ids[0], 0.1), (ids[2], 0.3)]
    assert store.load_runs(spark, root).count() == 3
    with pytest.raises(ValueError):
        log_run(spark, root, "", {}, {})


def test_exports(spark, make_bars, tmp_path):
    export_bars(make_bars([("A", "2024-01-01", 1.0, 2.0)]), str(tmp_path / "bars"))
    got = spark.read.option("header", True).csv(str(tmp_path / "bars")).first()
    assert (got.date, got.open, got.close, got.ticker) == ("2024-01-01", "1.0", "2.0", "A")
    export_report(spark.createDataFrame([("A", "Sí")], "ticker string, en_indice string"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first().en_indice == "Sí"

import pytest

from weekwatch.__main__ import arguments, run


def test_arguments():
    args = arguments(["clean", "--raw", "r", "--reports", "o", "--processed", "p"])
    assert (args.job, args.raw, args.reports, args.processed) == ("clean", "r", "o", "p")
    with pytest.raises(SystemExit):
        arguments(["clean", "--raw", "r"])


def test_missing_tables_are_reported(spark, tmp_path, capsys):
    for job in ("validate", "detect"):
        run(spark, arguments([job, "--raw", str(tmp_path), "--reports", str(tmp_path / "o")]))
        assert "no table iras_weekly_dept, skipped" in capsys.readouterr().out


def test_job_prints_what_it_found(spark, prov, tmp_path, capsys):
    from weekwatch.sources.tables import write_parquet

    raw = prov.withColumnsRenamed(
        {"cases_under5": "pneumonia_under5", "cases_60plus": "pneumonia_60plus"}
    )
    write_parquet(raw, f"{tmp_path}/iras_weekly_prov.parquet")
    base = ["--raw", str(tmp_path), "--reports", str(tmp_path / "reports")]
    run(spark, arguments(["clean", *base, "--processed", str(tmp_path / "processed")]))
    printed = capsys.readouterr().out
    assert "iras_weekly_prov" in printed and "10616" in printed
    run(spark, arguments(["validate", *base]))
    assert "15924" in capsys.readouterr().out

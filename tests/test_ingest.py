from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from creditloom.sources import csv_files
from creditloom.sources.artifacts import write_results
from creditloom.sources.csv_files import detect_encoding, scan_csv
from creditloom.sources.ingest import IncompleteLoad, build_portfolio, load_table, open_portfolio, published_build
from creditloom.sources.intermediate import checkpoint_root, materialise
from creditloom.sources.manifest import SourceTable


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_types_come_from_the_whole_file(spark, tmp_path):
    lines = ["id,amount,note"] + [f"{i},{i}," for i in range(3000)] + ["3000,0.5,late"]
    df = scan_csv(spark, write(tmp_path / "a.csv", "\n".join(lines)))
    assert df.dtypes == [("id", "bigint"), ("amount", "double"), ("note", "string")]
    assert df.filter("note IS NOT NULL").count() == 1


def test_short_rows_are_padded(spark, tmp_path):
    df = scan_csv(spark, write(tmp_path / "a.csv", "a,b,c\n1,2,3\n4,5\n"))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2, 3), (4, 5, None)]


@pytest.mark.parametrize(("text", "encoding", "expected"), [("plain", "utf-8", "UTF-8"), ("“quoted”", "cp1252", "windows-1252"), ("caf\x81", "latin-1", "ISO-8859-1")])
def test_encodings(spark, tmp_path, text, encoding, expected):
    path = write(tmp_path / "a.csv", f"id,text\n1,{text}\n", encoding)
    assert detect_encoding(spark, path) == expected
    assert scan_csv(spark, path).first()["text"] == text


def portfolio_files(tmp_path, train_rows=6):
    raw = tmp_path / "raw"
    raw.mkdir()
    write(raw / "application_train.csv", "SK_ID_CURR,TARGET\n" + "".join(f"{i},{i % 2}\n" for i in range(train_rows)))
    write(raw / "bureau.csv", "SK_ID_CURR,SK_ID_BUREAU\n" + "".join(f"{i % 6},{100 + i}\n" for i in range(12)))
    write(raw / "bureau_balance.csv", "SK_ID_BUREAU,MONTHS_BALANCE\n" + "".join(f"{100 + i},-1\n" for i in range(12)))
    manifest = [
        SourceTable("application_train", "application_train.csv", 6, ""),
        SourceTable("bureau", "bureau.csv", 12, ""),
        SourceTable("bureau_balance", "bureau_balance.csv", None, ""),
    ]
    return str(raw), str(tmp_path / "warehouse"), manifest


def test_a_build_is_visible_after_its_audit_only(spark, tmp_path):
    raw, warehouse, manifest = portfolio_files(tmp_path)
    assert published_build(spark, warehouse) is None
    with pytest.raises(FileNotFoundError):
        open_portfolio(spark, warehouse)
    build_portfolio(spark, raw, warehouse, manifest, by_client=True)
    tables = open_portfolio(spark, warehouse)
    assert {n: df.count() for n, df in tables.items()} == {"application_train": 6, "bureau": 12, "bureau_balance": 12}

    first = published_build(spark, warehouse)
    write(tmp_path / "raw" / "application_train.csv", "SK_ID_CURR,TARGET\n1,0\n")
    with pytest.raises(IncompleteLoad, match="application_train: 1 of 6"):
        build_portfolio(spark, raw, warehouse, manifest)
    assert published_build(spark, warehouse) == first


def test_a_reduced_build_keeps_the_children_of_its_clients(spark, tmp_path):
    raw, warehouse, manifest = portfolio_files(tmp_path)
    build_portfolio(spark, raw, warehouse, manifest, sample_size=2)
    tables = open_portfolio(spark, warehouse)
    assert {n: df.count() for n, df in tables.items()} == {"application_train": 2, "bureau": 4, "bureau_balance": 4}


def test_loading_replaces_and_filters(spark, tmp_path):
    source = spark.range(100).withColumnRenamed("id", "SK_ID_CURR")
    path = str(tmp_path / "t")
    load_table(source, path)
    assert load_table(source, path, F.col("SK_ID_CURR") < 10, by_client=True).count() == 10


def test_results_are_written_in_both_formats(spark, tmp_path):
    for fmt in ("parquet", "json"):
        write_results({"r": spark.range(3)}, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(f"{tmp_path}/{fmt}/r").count() == 3
    with pytest.raises(ValueError):
        write_results({}, str(tmp_path), "xml")


def test_intermediates_go_to_the_sessions_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == folder
    assert materialise(spark.range(5), "t").inputFiles()[0].startswith(f"file://{folder}/t-")


def test_valid_utf8_with_a_replacement_character_stays_utf8(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,text\n1,café �\n")
    assert detect_encoding(spark, path) == "UTF-8"
    assert scan_csv(spark, path).first()["text"] == "café �"


def test_quoted_line_breaks_and_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,text\n1,"two\nlines"\n2,"a ""quoted"" word"\n')
    rows = scan_csv(spark, path, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, 'a "quoted" word')]


def test_yes_and_no_are_booleans(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,flag,other\n1,Yes,Yes\n2,,Maybe\n3,No,No\n")
    df = scan_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "flag": "boolean", "other": "string"}
    assert [r["flag"] for r in df.orderBy("id").collect()] == [True, None, False]


def test_the_glossary_is_a_source():
    from creditloom.sources.manifest import MANIFEST

    assert [t.expected_rows for t in MANIFEST if t.name == "column_descriptions"] == [None]


def test_columns_that_the_first_rows_rule_out_are_not_read_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(csv_files, "_FIRST_ROWS", 100)
    late = lambda text: F.when(F.col("id") < 2000, text).otherwise(F.raise_error(F.lit("read to the end")).cast("string"))
    rows = spark.range(0, 5000, 1, 1).select(late(F.lit("Maybe")).alias("other"), F.when(F.col("id") > 4000, "Yes").alias("flag"))
    assert csv_files._yes_no_columns(rows) == ["flag"]
    assert csv_files._yes_no_columns(rows.select(F.when(F.col("flag").isNull(), "No").otherwise("Maybe").alias("late"))) == []

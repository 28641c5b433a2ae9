from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelwright.plans import refresh
from panelwright.session import clear_scratch, cut_lineage, scratch_dir
from panelwright.sources import ledger as store
from panelwright.sources import releases
from panelwright.sources.schema import MAIN_COLUMNS, PROVENANCE, SPECS, WORKSITE_COLUMNS, validate_headers
from panelwright.streaming.refresh import refresh_stream

HEADERS = (
    "CASE_NUMBER", "CASE_STATUS", "RECEIVED_DATE", "DECISION_DATE", "ORIGINAL_CERT_DATE", "VISA_CLASS",
    "EMPLOYER_NAME", "SOC_CODE", "WORKSITE_CITY", "WORKSITE_STATE", "WORKSITE_POSTAL_CODE",
)
ROW = ("E", "Certified", "2026-10-01", "2026-10-02", "", "H-1B", "Acme", "15-2051", "New York", "NY", "10001")


def land(folder, release, rows, headers=HEADERS, name=None):
    folder.mkdir(exist_ok=True)
    text = "\n".join(",".join(map(str, row)) for row in (headers, *rows)) + "\n"
    (folder / (name or f"LCA_Disclosure_Data_{release}.csv")).write_text(text)


def test_fixed_schemas():
    assert (len(MAIN_COLUMNS), len(set(MAIN_COLUMNS)), len(WORKSITE_COLUMNS)) == (98, 98, 22)
    assert SPECS["main"].required <= set(MAIN_COLUMNS) and SPECS["worksites"].required <= set(WORKSITE_COLUMNS)


def test_header_gate():
    spec = SPECS["main"]
    loose = [name.lower().replace("_", " ") for name in HEADERS] + ["H-1B_DEPENDENT"]
    mapping = validate_headers(loose, spec)
    assert mapping["case number"] == "CASE_NUMBER" and mapping["H-1B_DEPENDENT"] == "H_1B_DEPENDENT"
    for headers, message in (
        (HEADERS[:-1], "WORKSITE_POSTAL_CODE"), ((*HEADERS, "SURPRISE"), "SURPRISE"), ((*HEADERS, ""), "Blank"),
        ((*HEADERS, "CASE_STATUS"), "Duplicate"), ((*HEADERS, "case-status"), "same column"),
        ((*HEADERS, "SOURCE_FILE"), "provenance"),
    ):
        with pytest.raises(ValueError, match=message):
            validate_headers(headers, spec)


def test_a_release_becomes_the_fixed_schema(spark, tmp_path):
    headers = (*(h.lower().replace("_", " ") for h in HEADERS), "H-1B_DEPENDENT")
    land(tmp_path / "raw", "FY2027_Q1", [(*ROW, "Yes"), [""] * 12, ("F", *ROW[1:], "")], headers)
    path = str(tmp_path / "raw" / "LCA_Disclosure_Data_FY2027_Q1.csv")
    read = releases.read_release(spark, path, "FY2027_Q1")
    assert read.columns == [*MAIN_COLUMNS, *PROVENANCE]
    found = read.orderBy("SOURCE_ROW_NUMBER").collect()
    assert [(r["CASE_NUMBER"], r["SOURCE_ROW_NUMBER"], r["H_1B_DEPENDENT"]) for r in found] == [("E", 2, "Yes"), ("F", 4, None)]
    assert found[0]["EMPLOYER_FEIN"] is None and found[0]["SOURCE_FILE"] == "LCA_Disclosure_Data_FY2027_Q1.csv"


def test_row_numbers_run_through_all_parts_and_splits(spark, tmp_path):
    folder = tmp_path / "raw" / "LCA_Disclosure_Data_FY2027_Q2.csv"
    folder.mkdir(parents=True)
    at = 2
    for part in range(3):
        lines = [",".join(HEADERS)] + [",".join((f"N{n}", *ROW[1:])) for n in range(at, at + 400)]
        (folder / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
        at += 400
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = releases.read_release(spark, str(folder), "FY2027_Q2").persist()
        assert read.rdd.getNumPartitions() > 3
        wrong = read.where(F.col("CASE_NUMBER") != F.concat(F.lit("N"), F.col("SOURCE_ROW_NUMBER")))
        assert (read.count(), wrong.count()) == (1200, 0)
        parquet = str(tmp_path / "LCA_Disclosure_Data_FY2027_Q3.parquet")
        read.select(*HEADERS, F.col("SOURCE_ROW_NUMBER").cast("string").alias("JOB_TITLE")).orderBy("SOURCE_ROW_NUMBER").write.parquet(parquet)
        again = releases.read_release(spark, parquet, "FY2027_Q3")
        assert again.where(F.col("JOB_TITLE") != F.col("SOURCE_ROW_NUMBER").cast("string")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def read_csv(spark, folder, text, release="FY2027_Q1"):
    folder.mkdir()
    path = folder / f"LCA_Disclosure_Data_{release}.csv"
    path.write_text(",".join(HEADERS) + "\n" + text)
    return str(path)


def test_quotes_commas_and_line_breaks_stay_in_their_cell(spark, tmp_path):
    tail = ",15-2051,Oslo,NY,10001\n"
    quoted = 'A1,Certified,2026-10-01,2026-10-02,,H-1B,"Ac""me"" Inc, X"' + tail
    plain = read_csv(spark, tmp_path / "a", quoted + quoted.replace("A1", "A2"))
    assert not releases.spans_lines(spark, plain)
    rows = releases.read_release(spark, plain, "FY2027_Q1").orderBy("SOURCE_ROW_NUMBER").collect()
    assert [(r["EMPLOYER_NAME"], r["WORKSITE_POSTAL_CODE"]) for r in rows] == [('Ac"me" Inc, X', "10001")] * 2
    broken = 'B1,Certified,2026-10-01,2026-10-02,,H-1B,"Two\nLines"' + tail
    spanning = read_csv(spark, tmp_path / "b", broken + quoted)
    rows = releases.read_release(spark, spanning, "FY2027_Q1").orderBy("SOURCE_ROW_NUMBER").collect()
    assert [(r["CASE_NUMBER"], r["EMPLOYER_NAME"], r["SOURCE_ROW_NUMBER"]) for r in rows] == [
        ("B1", "Two\nLines", 2), ("A1", 'Ac"me" Inc, X', 3)
    ]


def test_cells_beyond_the_headers_fail_by_row(spark, tmp_path):
    good = ",".join(ROW) + "\n"
    path = read_csv(spark, tmp_path / "raw", good + good.strip() + ",,extra\n" + good.strip() + ",,\n" + "S,Denied\n")
    found = releases.surplus_cells(spark, path).collect()
    assert len(found) == 1 and found[0].key.endswith(".csv row 3")
    with pytest.raises(ValueError, match="cells_beyond_headers"):
        refresh.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "stored"))
    assert not (tmp_path / "stored").exists()


def test_every_part_passes_the_header_gate(spark, tmp_path):
    folder = tmp_path / "raw" / "LCA_Disclosure_Data_FY2027_Q2.parquet"
    first = spark.createDataFrame([ROW], ", ".join(f"{name} string" for name in HEADERS))
    for odd in ("a", "z"):
        first.coalesce(1).write.mode("overwrite").parquet(str(folder))
        other = first.withColumn("NOT_A_COLUMN", F.lit("x")).coalesce(1)
        other.write.mode("append").option("compression", "gzip" if odd == "a" else "snappy").parquet(str(folder))
        with pytest.raises(ValueError, match="NOT_A_COLUMN"):
            releases.read_release(spark, str(folder), "FY2027_Q2")
    parts = tmp_path / "csv" / "LCA_Disclosure_Data_FY2027_Q2.csv"
    parts.mkdir(parents=True)
    (parts / "part-0.csv").write_text(",".join(HEADERS) + "\n" + ",".join(ROW) + "\n")
    (parts / "part-1.csv").write_text(",".join(reversed(HEADERS)) + "\n" + ",".join(ROW) + "\n")
    with pytest.raises(ValueError, match="part-1.csv differ"):
        releases.read_release(spark, str(parts), "FY2027_Q2")


def test_folder_names_are_not_patterns(spark, tmp_path):
    raw = tmp_path / "in+1 (a)"
    land(raw, "FY2027_Q1", [ROW])
    inner = raw / "LCA_Disclosure_Data_FY2027_Q2.csv" / "in+1 (a)"
    inner.mkdir(parents=True)
    (inner / "part.csv").write_text(",".join(HEADERS) + "\n")
    found = {(r["name"], r["kind"]) for r in releases.landed_files(spark, str(raw)).collect()}
    assert found == {("LCA_Disclosure_Data_FY2027_Q1.csv", "main"), ("LCA_Disclosure_Data_FY2027_Q2.csv", "main")}


def test_kinds_not_asked_for_stay_and_unchanged_content_is_not_read(spark, tmp_path, monkeypatch):
    raw, root = tmp_path / "raw", str(tmp_path / "stored")
    land(raw, "FY2027_Q1", [ROW])
    sites = ("CASE_NUMBER", "WORKSITE_CITY", "WORKSITE_STATE", "WORKSITE_POSTAL_CODE", "WORKSITE_WORKERS")
    land(raw, "", [("E", "Oslo", "NY", "10001", "1")], sites, name="LCA_Worksites_FY2027_Q1.csv")
    assert refresh.ingest(spark, str(raw), root, with_worksites=True) == ["FY2027_Q1", "FY2027_Q1"]
    both = store.input_version(spark, root, "main", "worksites")
    monkeypatch.setattr(releases, "read_release", lambda *a: pytest.fail("an unchanged release was read"))
    assert refresh.ingest(spark, str(raw), root) == []
    assert {r["kind"] for r in store.release_ledger(spark, root).collect()} == {"main", "worksites"}
    assert refresh.ingest(spark, str(raw), root, with_worksites=True) == []
    assert store.input_version(spark, root, "main", "worksites") == both != store.input_version(spark, root)


def test_the_fingerprint_follows_the_rows_only(spark):
    rows = spark.createDataFrame([("a", "f", 1), ("b", "f", 2)], "CASE_NUMBER string, SOURCE_FILE string, SOURCE_ROW_NUMBER long")
    mark = lambda df: releases.content_fingerprint(df).first()["sha256"]
    assert mark(rows) == mark(rows.orderBy(F.desc("CASE_NUMBER")).withColumn("SOURCE_FILE", F.lit("g")))
    assert len({mark(rows), mark(rows.limit(1)), mark(rows.union(rows)), mark(rows.replace("a", "c"))}) == 4


def test_discovery(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "stored")
    land(raw, "FY2027_Q1", [ROW])
    land(raw, "", [ROW], name="LCA_Worksites_FY2027_Q1.csv")
    land(raw, "", [ROW], name="~$LCA_Disclosure_Data_FY2027_Q1.csv")
    files = releases.landed_files(spark, str(raw))
    assert [r["release"] for r in releases.release_catalog(files).collect()] == ["FY2027_Q1"]
    assert not releases.catalog_violations(files, releases.release_catalog(files)).take(1)
    land(raw, "", [ROW], name="notes.csv")
    with pytest.raises(ValueError, match="unrecognized_name notes.csv"):
        refresh.ingest(spark, str(raw), root)
    (tmp_path / "other").mkdir()
    land(tmp_path / "other", "FY2027_Q1", [ROW])
    land(tmp_path / "other", "FY2027_Q1", [ROW], name="lca_disclosure_data_fy2027_q1.json")
    with pytest.raises(ValueError, match="duplicate_release"):
        refresh.ingest(spark, str(tmp_path / "other"), root)


def test_only_new_and_changed_releases_are_read(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "stored")
    land(raw, "FY2027_Q1", [ROW])
    land(raw, "FY2027_Q2", [("A", *ROW[1:]), ("B", *ROW[1:])])
    assert refresh.ingest(spark, str(raw), root) == ["FY2027_Q1", "FY2027_Q2"]
    first = store.input_version(spark, root)
    assert refresh.ingest(spark, str(raw), root) == []
    assert store.input_version(spark, root) == first
    land(raw, "FY2027_Q3", [("C", *ROW[1:])])
    land(raw, "FY2027_Q2", [("A", *ROW[1:]), ("B", *ROW[1:]), ("B", *ROW[1:])])
    assert refresh.ingest(spark, str(raw), root) == ["FY2027_Q2", "FY2027_Q3"]
    assert store.input_version(spark, root) != first
    ledger = {r["release"]: r["rows"] for r in store.release_ledger(spark, root).collect()}
    assert ledger == {"FY2027_Q1": 1, "FY2027_Q2": 3, "FY2027_Q3": 1}
    table = store.read_releases(spark, root, columns=["CASE_NUMBER", "SOURCE_RELEASE"])
    assert sorted(map(tuple, table.collect())) == [
        ("A", "FY2027_Q2"), ("B", "FY2027_Q2"), ("B", "FY2027_Q2"), ("C", "FY2027_Q3"), ("E", "FY2027_Q1"),
    ]
    (raw / "LCA_Disclosure_Data_FY2027_Q3.csv").unlink()
    assert refresh.ingest(spark, str(raw), root) == []
    assert store.release_ledger(spark, root).count() == 2
    with pytest.raises(ValueError, match="invalid_positions"):
        refresh.stored_cases(spark, root)
    row = store.release_ledger(spark, root).where("release = 'FY2027_Q1'").first().asDict()
    store._append(spark, f"{root}/ledger/releases", store.RELEASES, [
        (row["release"], row["kind"], row["name"], row["size_bytes"], row["modified_at"], row["sha256"], row["path"], 7, 1000)
    ])
    with pytest.raises(ValueError, match="row_count_changed FY2027_Q1: 1 vs 7"):
        refresh.stored_cases(spark, root)
    tables = refresh.audit(spark, root)
    assert tables["release_quality"].where("SOURCE_RELEASE = 'FY2027_Q2'").first()["duplicate_case_number_rows"] == 1
    land(raw, "FY2027_Q4", [ROW], HEADERS[1:] + ("ODD",))
    with pytest.raises(ValueError, match="ODD"):
        refresh.ingest(spark, str(raw), root)
    assert store.release_ledger(spark, root).count() == 2


def test_an_output_is_published_only_after_its_check(spark, tmp_path):
    root, table = str(tmp_path), spark.range(3)
    store.write_output(table, root, "t", "v1")

    def refuse(stored):
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        store.write_output(spark.range(9), root, "t", "v2", check=refuse)
    assert store.read_output(spark, root, "t").count() == 3
    assert store.is_current(spark, root, "t", "v1") and not store.is_current(spark, root, "t", "v2")
    store.write_output(spark.range(5), root, "t", "v2")
    assert store.read_output(spark, root, "t").count() == 5


def test_intermediate_tables_are_deleted(spark):
    table = cut_lineage(spark.range(5))
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    assert table.count() == 5 and list(folder.iterdir())
    clear_scratch(spark)
    assert not folder.exists()
    assert cut_lineage(spark.range(2)).count() == 2


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.005, 2), ("b", None, 3)], "k string, v double, n int")
    store.write_csv(df, str(tmp_path / "csv"), 2)
    read = spark.read.option("header", "true").csv(str(tmp_path / "csv")).orderBy("k").collect()
    assert [tuple(r) for r in read] == [("a", "1.00", "2"), ("b", None, "3")]
    store.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_the_stream_refreshes_once_per_landing(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "stored")
    seen = []

    def process():
        seen.append(refresh.ingest(spark, str(raw), root))

    def run():
        query = refresh_stream(spark, str(raw), str(tmp_path / "checkpoint"), process)
        query.awaitTermination(120)

    land(raw, "FY2027_Q1", [ROW])
    run()
    run()
    land(raw, "FY2027_Q2", [("A", *ROW[1:])])
    run()
    assert seen == [["FY2027_Q1"], ["FY2027_Q2"]]

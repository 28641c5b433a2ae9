import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from panelwright.operators import panel
from panelwright.plans import incremental, refresh
from panelwright.sources import ledger as store
from tests.test_ingest import HEADERS, land

COLUMNS = (*HEADERS, "TOTAL_WORKER_POSITIONS")
QUARTERS = [f"FY2027_Q{q}" for q in (1, 2, 3, 4)] + [f"FY2028_Q{q}" for q in (1, 2, 3, 4)]
DAYS = dict(zip(QUARTERS, ["2026-10-03", "2027-01-03", "2027-04-03", "2027-07-03", "2027-10-03", "2028-01-03", "2028-04-03", "2028-07-03"], strict=True))


def release_rows(quarter, draw, version=0):
    """Own cases of the quarter, so that none is empty, and new versions of earlier ones that may change company."""
    known = QUARTERS[: QUARTERS.index(quarter) + 1]
    rows = []
    for i in range(6):
        rows.append((f"{quarter}-{i}", draw.choice(["Certified", "Denied"]), DAYS[quarter], DAYS[quarter], "", "H-1B", f"Firm {draw.randrange(7)}, Inc.", "15-2051", "X", "NY", "1", 1 + version))
    for _ in range(4):
        other = draw.choice(known)
        name = draw.choice(["Firm 1, Inc.", "FIRM 2 INC", "Ünï 3", "Firm 9"])
        rows.append((f"{other}-{draw.randrange(6)}", "Withdrawn", DAYS[other], DAYS[other], "", draw.choice(["H-1B", "H-1B", "E-3"]), name, "15-2051", "X", "NY", "1", 2))
    # The quarter keeps one case that nothing else touches.
    rows.append((f"{quarter}-own", "Certified", DAYS[quarter], DAYS[quarter], "", "H-1B", "Firm 0, Inc.", "15-2051", "X", "NY", "1", 1))
    return [tuple(f'"{v}"' if "," in str(v) else v for v in row) for row in rows]


def everything(frame, keys):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


def rebuilt(spark, root):
    raw = store.read_releases(spark, root)
    newest = incremental.merge_newest(None, incremental.narrow(raw), [], None)
    first, last = refresh.release_window(spark, root)
    cases = panel.in_window(panel.eligible_cases(panel.latest_cases(raw, "RECEIVED_DATE"), "H-1B"), first, last)
    return newest, panel.company_quarters(panel.dense_panel(panel.rollup_cases(cases), last=last))


def agree(spark, root):
    newest, whole = rebuilt(spark, root)
    assert everything(incremental.newest_cases(spark, root, "H-1B"), "") == everything(newest, "")
    assert everything(refresh.receipt_panel(spark, root).drop("quarter"), "") == everything(whole, "")


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_equals_rebuilt_over_random_landings(spark, tmp_path, seed):
    raw, root, draw = tmp_path / "raw", str(tmp_path / "store"), random.Random(seed)
    for quarter in QUARTERS[:5]:
        land(raw, quarter, release_rows(quarter, draw), COLUMNS)
    refresh.ingest(spark, str(raw), root)
    agree(spark, root)
    pending = QUARTERS[5:7]
    for step in range(3):
        move = draw.choice(["new", "replace", "both"]) if pending else "replace"
        if move in ("new", "both"):
            quarter = pending.pop(0)
            land(raw, quarter, release_rows(quarter, draw), COLUMNS)
        if move in ("replace", "both"):
            quarter = draw.choice(QUARTERS[:5])
            land(raw, quarter, release_rows(quarter, draw, version=step + 1), COLUMNS)
        refresh.ingest(spark, str(raw), root)
        agree(spark, root)
    (raw / f"LCA_Disclosure_Data_{QUARTERS[6 - len(pending)]}.csv").unlink()  # the last one is withdrawn
    refresh.ingest(spark, str(raw), root)
    agree(spark, root)


def test_finished_releases_are_not_read_again(spark, tmp_path, monkeypatch):
    raw, root, draw = tmp_path / "raw", str(tmp_path / "store"), random.Random(3)
    for quarter in QUARTERS[:5]:
        land(raw, quarter, release_rows(quarter, draw), COLUMNS)
    refresh.ingest(spark, str(raw), root)
    refresh.receipt_panel(spark, root)
    finished = {row.path for row in store.release_ledger(spark, root).collect()}
    land(raw, QUARTERS[5], release_rows(QUARTERS[5], draw), COLUMNS)
    refresh.ingest(spark, str(raw), root)
    read, write = [], store.write_output

    def recorded(df, *rest):
        read.extend(df.inputFiles())
        return write(df, *rest)

    monkeypatch.setattr(store, "write_output", recorded)
    refresh.receipt_panel(spark, root)
    assert any("/newest_cases/" in file for file in read) and any(f"/main/{QUARTERS[5]}/" in file for file in read)
    assert not any(path in file for path in finished for file in read)


def test_only_companies_of_changed_cases_are_made_again(spark, tmp_path):
    """A case moves from one company to another: both are touched, a third is not."""
    fields = ("c", "FY2027_Q1", 1, "H-1B", "Certified", "Old LLC", "1", "2026-10-03", "2026-10-03")
    before = [("c1", *fields[1:]), ("c2", *fields[1:5], "Third LLC", *fields[6:])]
    after = [("c1", "FY2027_Q2", 7, *fields[3:5], "New LLC", *fields[6:]), before[1]]
    schema = ", ".join(f"{n} {'long' if n == 'SOURCE_ROW_NUMBER' else 'string'}" for n in incremental.FIELDS)
    names = incremental.changed_names(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema))
    assert sorted(r.EMPLOYER_NAME for r in names.collect()) == ["New LLC", "Old LLC"]
    # The same row from another release is no change.
    moved = [("c1", "FY2027_Q2", 9, *fields[3:]), before[1]]
    assert incremental.changed_names(spark.createDataFrame(before, schema), spark.createDataFrame(moved, schema)).count() == 0


def test_an_audit_of_the_same_releases_writes_nothing(spark, tmp_path):
    raw, root, draw = tmp_path / "raw", str(tmp_path / "store"), random.Random(4)
    land(raw, QUARTERS[0], release_rows(QUARTERS[0], draw), COLUMNS)
    refresh.ingest(spark, str(raw), root)
    first = refresh.audit(spark, root)
    entries = store.output_ledger(spark, root).agg(F.max("seq"), F.count("*")).first()
    again = refresh.audit(spark, root)
    assert store.output_ledger(spark, root).agg(F.max("seq"), F.count("*")).first() == entries
    assert set(first) == set(again) and all(first[name].count() == again[name].count() for name in first)


def test_writers_at_the_same_time_keep_every_commit(spark, tmp_path):
    path = f"{tmp_path}/ledger/outputs"
    with ThreadPoolExecutor(8) as pool:  # all try the same first number
        taken = list(pool.map(lambda i: store._append(spark, path, store.OUTPUTS, [(f"n{i % 5}", f"v{i}", f"p{i}", i, 1)]), range(40)))
    assert sorted(taken) == list(range(1, 41))
    entries = {(r.seq, r.version) for r in store._entries(spark, path, store.OUTPUTS).collect()}
    assert entries == {(seq, f"v{i}") for i, seq in enumerate(taken)}
    newest = {r.name: r.version for r in store.output_ledger(spark, str(tmp_path)).collect()}
    assert newest == {f"n{k}": f"v{max(range(k, 40, 5), key=lambda i: taken[i])}" for k in range(5)}
    root = str(tmp_path / "both")
    with ThreadPoolExecutor(2) as pool:
        frames = [spark.range(n + 1) for n in range(6)]
        list(pool.map(lambda n: store.write_output(frames[n], root, "shared", f"v{n}"), range(6)))
    assert store._entries(spark, f"{root}/ledger/outputs", store.OUTPUTS).count() == 6
    found = store.output_ledger(spark, root).first()
    assert store.read_output(spark, root, "shared").count() == found.rows == int(found.version[1:]) + 1


def test_replaced_folders_go_after_their_time(spark, tmp_path):
    raw, root, draw = tmp_path / "raw", str(tmp_path / "store"), random.Random(6)
    for quarter in QUARTERS[:5]:
        land(raw, quarter, release_rows(quarter, draw), COLUMNS)
    folders = lambda: {str(path) for path in (tmp_path / "store").glob("*/*/v*")}
    sizes = []
    for step in range(4):
        land(raw, QUARTERS[step % 2], release_rows(QUARTERS[step % 2], draw, version=step), COLUMNS)
        refresh.ingest(spark, str(raw), root)
        agree(spark, root)
        assert refresh.remove_expired(spark, root, 3600.0) == [] or step  # nothing is old enough
        before = folders()
        gone = refresh.remove_expired(spark, root, 0.0)
        assert folders() == before - set(gone) and bool(gone) == bool(step)
        sizes.append(len(folders()))
        agree(spark, root)  # what is current can still be read and carried over
    assert len(set(sizes[1:])) == 1
    orphan = tmp_path / "store/outputs/lost/v00000001-0"
    orphan.mkdir(parents=True)
    assert refresh.remove_expired(spark, root, 3600.0) == [] and refresh.remove_expired(spark, root, -5.0) == [str(orphan)]


def test_panel_quality_counts_companies_rows_and_the_last_quarter(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    case = lambda number, name, day: (number, "Certified", day, day, "", "H-1B", name, "15-2051", "X", "NY", "1", 1)
    rows = [case("a", "One", DAYS[QUARTERS[0]]), case("b", "Two", DAYS[QUARTERS[1]]), case("c", "One", DAYS[QUARTERS[2]])]
    land(raw, QUARTERS[2], rows, COLUMNS)
    refresh.ingest(spark, str(raw), root)
    assert refresh.decision_panel(spark, root).count() == 5
    found = store.read_output(spark, root, "company_activity_quality").collect()
    assert [(r.companies, r.company_quarter_rows, r.latest_quarter) for r in found] == [(2, 5, QUARTERS[2])]

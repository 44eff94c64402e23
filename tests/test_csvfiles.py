"""CSV records of many files against Python's own reader."""

import csv
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from evalloom.operators.leaderboard import leaderboard
from evalloom.plans import jobs
from evalloom.sources import csvfiles, readers, sinks

PIECES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture
def pieces(spark):
    """Scans in pieces of 200 bytes."""
    usual = {k: spark.conf.get(k) for k in (PIECES, "spark.sql.files.openCostInBytes")}
    spark.conf.set(PIECES, "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in usual.items():
        spark.conf.set(k, v)


def write(path, header, rows, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)


def read_by_hand(folder):
    out = []
    for root, _, names in os.walk(folder):
        for name in names:
            with open(f"{root}/{name}", encoding="utf-8", newline="") as f:
                out += [{k: v or None for k, v in row.items() if k is not None} for row in csv.DictReader(f)]
    return out


def frozen(rows, names):
    return sorted(repr([row.get(n) for n in names]) for row in rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_in_pieces(spark, folder, pieces, end):
    rng = random.Random(len(end))
    bits = ["a", "b,", '"', "\n", "é", "\r\n", '""', " ", "\n\n", "long words here"]
    for i in range(6):
        names = rng.sample(["p", "q", "r", "s", f"own{i}", "t\nu"], 4)
        rows = [["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(4)] for _ in range(40)]
        write(f"{folder}/{i}/x_results.csv", names, rows, end)
    # One cell over many pieces, and blank lines.
    write(f"{folder}/big/x_results.csv", ["p", "q"], [["x\n" * 900, "1"], ["2", "y" * 700 + "\n\n"], ["3", "4"]], end)
    with open(f"{folder}/big/y_results.csv", "w", newline="") as f:
        f.write("p,q\n\n1,2\n\n")
    rows = readers.read_results_under(spark, [folder])
    names = [c for c in rows.columns if c not in ("source_path", "row_order")]
    assert set(names) == {n for row in read_by_hand(folder) for n in row}
    got = [r.asDict() for r in rows.collect()]
    assert frozen(got, names) == frozen(read_by_hand(folder), names)
    # Positions follow the file.
    own = rows.filter(F.col("source_path").contains("/big/x")).orderBy("row_order").collect()
    assert [r["q"][:1] for r in own] == ["1", "y", "4"]


def test_cells(spark):
    lines = ["a,b", "", ',"",x', '"p ""q""",["k"]', '"a,b",,"c\nd"', '"""",""""""']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i")
    got = [r[0] for r in rows.select(csvfiles.cells(F.col("x"))).collect()]
    assert got == [["a", "b"], [None], [None, "", "x"], ['p "q"', '["k"]'], ["a,b", None, "c\nd"], ['"', '""']]


def test_many_headers_one_plan(spark, folder):
    def files(n, kinds):
        rng = random.Random(n)
        path = f"{folder}/{n}"
        columns = [f"c{i}" for i in range(12)]
        layouts = [rng.sample(columns, 12) for _ in range(kinds)]
        for i in range(n):
            names = layouts[i % kinds]
            write(f"{path}/{i}_results.csv", [*names, names[0]], [[f"{c}{i}" for c in names] + ["last"]])
        return path

    plans = []
    for n, kinds in ((3, 2), (150, 60)):
        path = files(n, kinds)
        rows = readers.read_results_under(spark, [path, f"{path}/"])
        names = sorted(c for c in rows.columns if c.startswith("c"))
        got = [r.asDict() for r in rows.collect()]
        assert len(got) == n and frozen(got, names) == frozen(read_by_hand(path), names)
        plans.append(len(rows._jdf.queryExecution().analyzed().toString().splitlines()))
    assert plans[0] == plans[1]


def test_empty_files_and_roots(spark, folder):
    write(f"{folder}/a/x_results.csv", ["p"], [["1"]])
    write(f"{folder}/a/b/x_results.csv", ["p"], [["2"], ["3", "beyond"]])
    # A root below another one is read once.
    assert sorted(r["p"] for r in readers.read_results_under(spark, [f"{folder}/a/b", f"{folder}/a"]).collect()) == ["1", "2", "3"]
    open(f"{folder}/a/y_results.csv", "w").close()
    with pytest.raises(ValueError, match="no header"):
        readers.read_results_under(spark, [folder])
    with pytest.raises(ValueError, match="no file named"):
        readers.read_results_under(spark, [folder], "*.tsv")


HEADER = ["base_model", "init_lora_weights", "extra", "r", "lora_alpha", "dataset_name", "metric_eval_accuracy"]


def test_averages_beside_their_source(spark, folder):
    for name, values in (("one", [0.5, 0.75]), ("two", [0.25])):
        write(f"{folder}/{name} x+1/eval_results.csv", HEADER, [["m", "eva", "", "16", "1", name, v] for v in values] + [["m", "olora", "", "16", "1", name, 0.125]])
    assert jobs.write_leaderboard(spark, [folder]) == 2
    with open(f"{folder}/one x+1/eval_results_avg.csv", encoding="utf-8") as f:
        first = f.read()
    # Best first, one header, no other file left beside it.
    assert [line.split(",")[2] for line in first.splitlines()] == ["init_lora_weights", "eva", "olora"]
    left = sorted(n for n in os.listdir(f"{folder}/one x+1") if not n.endswith(".crc"))
    assert left == ["eval_results.csv", "eval_results_avg.csv"]
    out = {r["init_lora_weights"]: r["metric_eval_mean_avg"] for r in jobs.build_macro_mean(spark, [folder]).collect()}
    assert out == {"eva": (0.625 + 0.25) / 2, "olora": 0.125}
    # Repeating the run, also over a file that an earlier one left half-done, gives the same files.
    with open(f"{folder}/two x+1/eval_results_avg.csv", "w", encoding="utf-8") as f:
        f.write("half")
    assert jobs.write_leaderboard(spark, [folder]) == 2
    with open(f"{folder}/one x+1/eval_results_avg.csv", encoding="utf-8") as f:
        assert f.read() == first
    assert {r["init_lora_weights"]: r["metric_eval_mean_avg"] for r in jobs.build_macro_mean(spark, [folder]).collect()} == out


def test_shared_targets_and_paths(spark):
    rows = spark.createDataFrame([("/x/a.csv", 1.0), ("/x/a.txt", 2.0)], "source_path string, m double")
    with pytest.raises(ValueError, match="share"):
        sinks.write_avg_beside(rows)
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_avg_beside(rows.filter("m > 5"))
    paths = ["/x/eval%20results.csv", "/x.d/name", "/x/.csv", "a.b.csv", "/x/a."]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(sinks.average_path_of(F.col("p"))).collect()]
    assert got == [sinks.average_path(p) for p in paths]


def test_text_is_scanned_before_rows_come_back(spark, tmp_path):
    """Rows read stored lines and stored joined records: no text scan, window or grouping is left in their plan."""
    (tmp_path / "a_results.csv").write_text('x,"y\nz"\n1,"2\n3"\n4,5\n')
    (tmp_path / "b_results.csv").write_text("x,w\n6,7\n")
    rows, headers = csvfiles.read_tables(spark, [str(tmp_path)])
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert headers == 2 and "FileScan parquet" in plan
    assert "FileScan text" not in plan and "Window" not in plan
    got = sorted((r["x"], r["y\nz"] or "", r["w"] or "") for r in rows.collect())
    assert got == [("1", "2\n3", ""), ("4", "5", ""), ("6", "", "7")]


def test_leaderboard_groups_once(spark):
    """What sorts the averages reads them from a stored table."""
    rows = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("n", 5.0)], "k string, v double")
    table = leaderboard(rows, ["k"], "v")
    assert "Aggregate" not in table._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in table.collect()] == [("n", 5.0, 0.0, 1), ("m", 2.0, 2.0**0.5, 2)]

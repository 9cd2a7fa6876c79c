"""The entry module with and without the optional subpackage; the streaming, plan and tabular parts."""

import subprocess
import sys
from pathlib import Path

import fixtures
from pyspark.sql import functions as F

import __spark_entry__
from arborspark.operators.information import observed
from arborspark.plans.annotation import Options, annotate
from arborspark.sources import tabular
from arborspark.sources.obo import read_obo
from arborspark.streaming.observations import observed_in_windows

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "arborspark"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "arborspark" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, sql, has = out.stdout.split()
    assert int(n) > 40 and int(sql) >= int(n) - 1 and has == "False"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _onto(spark, tmp_path, text):
    path = tmp_path / "o.obo"
    path.write_text(text)
    return read_obo(spark, f"file://{path}")


def test_plan(spark, tmp_path):
    onto = _onto(spark, tmp_path, fixtures.BRANCHES)
    (tmp_path / "p.tsv").write_text("A\tChild2;Child5\nB\tAll;Child4;none\n")
    rows = tabular.read_profiles(spark, f"file://{tmp_path}/p.tsv")
    out = annotate(onto, rows, Options(translate_codes=True, clean=True, measure="lin", information="prof", translate_names=True, statistics=True, children=("r", ["branchA"]), attributes=True))
    assert {(r.profile_id, r.name) for r in out["untranslated"].collect()} == {("B", "none")}
    assert {(r.profile_id, r.term) for r in out["profiles"].collect()} == {("A", "branchAChild1"), ("A", "branchB"), ("B", "branchAChild2")}
    assert out["similarity"].count() == 4 and out["children"].count() == 2 and out["attributes"].count() == 5 and out["stats"].count() == 11
    out = annotate(onto, rows, Options(list_translate="codes"))
    assert {tuple(r) for r in out["translated"].collect()} >= {("All", "root"), ("none", "-")}
    tabular.write_lines(tabular.profile_lines(tabular.read_profiles(spark, f"file://{tmp_path}/p.tsv")), f"file://{tmp_path}/out")
    assert {r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()} == {"A\tChild2|Child5", "B\tAll|Child4|none"}
    (tmp_path / "t.tsv").write_text("x\t1\ny\t2\nx\t1\n")
    assert {r.text for r in tabular.read_texts(spark, f"file://{tmp_path}/t.tsv", filter_column=1, filter_value="1").collect()} == {"x"}
    (tmp_path / "reg.tsv").write_text("KEY\thttp://example.org\n")
    assert tabular.ontology_file(spark, "KEY", f"file://{tmp_path}/reg.tsv", "/d") == "/d/KEY.obo"


def test_stream_equals_batch(spark, tmp_path):
    onto = _onto(spark, tmp_path, fixtures.BRANCHES)
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "branchAChild1"), ("2024-01-01 00:50:00", "branchB"), ("2024-01-01 01:10:00", "branchB")], "ts string, term string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/events")
    q = observed_in_windows(stream, onto).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {tuple(r) for r in spark.table("seen").collect()}
    assert got == {tuple(r) for r in observed_in_windows(rows, onto).collect()} and len(got) == 6
    assert {r.term: r.observed_freq for r in observed(onto, rows.select(F.lit("p").alias("profile_id"), "term", F.lit(0).alias("pos"))).collect()}["root"] == 3

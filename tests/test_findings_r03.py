"""What round 3's findings changed."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.functions.gates import ODD_CASE, Gated
from maskwright.operators import frames, native
from maskwright.plans import queries

TEXTS = [
    None, "", "plain", "to our.12@mail3.example.com and me.7@corp.test, our own", "Haus.55@mail4.example.com is first", "7up@corp.test", "_x@corp.test", "-o.1@corp.test", "A.@corp.test", "a***", "aged 40, I.x@corp.test",
    "x " * 700 + "we@corp.test 44 years old, aged 200",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("r03"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["detect_emails", "native_mask_text"])
def test_addresses_with_pronouns_and_capitals_are_those_of_the_sql(spark, folder, name):
    rows = queries.queries()[name](spark, folder).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.execute(queries.oracle_sql()[name]).fetchall()
    assert len(rows) > 5 and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_risk_runs_each_pattern_once(spark, folder):
    plan = queries.queries()["risk_by_doc"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 2 and plan.count("lower(text") == 1


def test_literals_with_and_without_case_open_the_same_gates(spark):
    texts = ["", "@", "AGED 4", "aged 4", "4岁", "年龄 7", "7 YEARſ old", "four years", "K@", "ÉAGED 1", "x 7"]
    regex = queries.pattern("shared", "age").regex
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", native.may_match(F.col("t"), regex).alias("ok"), native.may_match(F.col("t"), "@").alias("at")).collect()
    gates = Gated([regex, "@"])
    assert [(bool(r.ok), bool(r["at"])) for r in rows if r.t is not None and ODD_CASE.isdisjoint(r.t)] == [tuple(gates.passing(t)) for t in texts if ODD_CASE.isdisjoint(t)]
    assert [r.ok for r in rows if r.t and "ſ" in r.t] == [True] and [r["at"] for r in rows if r.t and "@" in r.t] == [True, True] and rows[-1].ok is None


def test_batches_become_python_values_in_parts(spark, monkeypatch):
    run = []
    monkeypatch.setattr(frames, "spread", lambda df: type("", (), {"mapInArrow": lambda self, f, schema: run.append(f)})())
    texts = [f"{i} mail u{i}@corp.test" for i in range(3000)] + ["x" * (3 << 20), "", None] + ["y" * 100_000] * 100
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    frames.append_columns(spark.createDataFrame([], "doc_id long, text string"), ["text"], {"n": "int", "back": "string"}, lambda: lambda t: (None if t is None else len(t), t))
    out = list(run[0](iter([whole, whole.slice(0, 0), whole.slice(5, 7)])))
    assert pa.Table.from_batches(out).column("doc_id").to_pylist() == [*range(len(texts)), *range(5, 12)]
    assert pa.Table.from_batches(out).column("back").to_pylist() == texts + texts[5:12] and pa.Table.from_batches(out).column("n").null_count == 1
    assert all(b.num_rows <= frames.PART_ROWS and (b.num_rows == 1 or b.nbytes < 3 * frames.PART_BYTES) for b in out)
    held, most = pa.total_allocated_bytes(), 0
    for b in run[0](iter([whole])):
        del b
        most = max(most, pa.total_allocated_bytes() - held)
    assert most < 8 << 20 < whole.nbytes

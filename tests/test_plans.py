import os
import time

import duckdb
import pytest

import __spark_entry__
from strandflow import errors as E
from strandflow.operators import collections as C
from strandflow.operators import mapping as M
from strandflow.plans.catalog import CATALOG
from strandflow.plans.pipeline import Pipeline, State, monitor
from strandflow.sources.connectors import emit

SF = "/root/testdata/sf0.001"


def rows_of(rows):
    plain = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr(tuple(map(plain, r))) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CATALOG)
def test_against_sql(spark, name):
    query, sql = CATALOG[name]
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = query(spark, SF)
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    assert rows_of(df.select(*cols).collect()) == rows_of(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pipeline(spark, tmp_path):
    p = Pipeline({"root": "x"})
    s = emit(spark, [("v", "i32")], lambda: [(2,), (1,)], name="numbers")
    main, taken = M.extract_fields(s, ["v"])
    p.name("extracted", taken)
    with pytest.raises(E.StreamAlreadyExists):
        p.name("extracted", taken)
    with pytest.raises(E.StreamNotFound):
        p.run()
    p.sink("sum", lambda a: sum(r.v for r in C.sort(a, ["v"]).ordered().collect()), p.take("extracted"))
    with pytest.raises(E.InputAlreadyDerived):
        p.take("extracted")
    p.sink("list", lambda a: [r.v for r in C.sort(a, ["v"]).ordered().collect()], main)
    p.execute("monitor", monitor(str(tmp_path / "m.csv"), 0.05), background=True)
    p.execute("wait", lambda control: time.sleep(0.2))
    got = p.run()
    assert got["sum"] == 3 and got["list"] == [1, 2]
    assert all(n.state is State.SUCCESS for n in p.nodes.values())
    assert (tmp_path / "m.csv").read_text().startswith("Timestamp,memory_rss,memory_swap,memory_object,memory_wrapped\n")
    assert '"numbers" -> "list"' in p.to_dot()


def test_pipeline_error(spark):
    p = Pipeline()
    p.sink("bad", lambda a: 1 / 0, emit(spark, [("v", "i32")], lambda: []))
    with pytest.raises(ZeroDivisionError) as found:
        p.run()
    assert "in node `bad`" in found.value.__notes__[0]
    assert p.nodes["bad"].state is State.ERROR and "test_plans.py" in p.nodes["bad"].site


def test_unbounded(spark, tmp_path):
    from strandflow.streaming.stateless import start, unbounded

    spark.createDataFrame([("A",), ("B",)], "v string").write.parquet(f"{tmp_path}/in")
    s = unbounded(spark.readStream.schema("v string").parquet(f"{tmp_path}/in"))
    q = start(M.to_lowercase(s, ["v"]), "lowered", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.v for r in spark.table("lowered").collect()) == ["a", "b"]
    with pytest.raises(E.ExpectedMinimalOrder):
        start(C.sort(s, ["v"]), "x", f"{tmp_path}/cp2")

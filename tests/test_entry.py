import ast
import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = os.environ.get("PLINTH_SF", "/root/testdata/sf0.001")
ROOT = Path(entry.__file__).parent


def test_entry_and_names(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {"p1_found", "p6_found", "p7_found"} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["p6_found", "p7_found", "market_panel", "nearest_donor_fill", "yoy_chain", "stream_event_windows", "missing_rate_report", "plot_fields", "text_flags", "listings_clean", "forecast_roll_forward"])
def test_against_sql(spark, name):
    import duckdb

    from tools_compare import normal

    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = normal(entry.queries()[name](spark, SF).toPandas()), normal(con.execute(entry.oracle_sql()[name]).fetch_df())
    assert got.equals(want)


def test_core_does_not_import_llm():
    for p in (ROOT / "plinth").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any(re.search(r"\bllm\b", x) for x in names), p


def test_no_row_python_in_core_plans(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    for name in ("p1_found", "p6_found", "market_panel", "market_indices", "rate_typed_upsert"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan, name

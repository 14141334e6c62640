import subprocess
import sys

import __spark_entry__ as entry


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["request_id", "result_id", "score", "status"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_optional_subpackage():
    code = "import sys; sys.modules['quire.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p5_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)

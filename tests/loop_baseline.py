"""One statement after another, as an engine without set-wise plans runs them: seconds per statement and in all.

python tests/loop_baseline.py [folder] [statements]. Statements are those of customer_spend's audit log. They run in
one process on tables held in memory, so the start of a process per statement is not counted.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from hindcast.operators import evidence  # noqa: E402
from hindcast.plans import testdata as td  # noqa: E402
from hindcast.session import session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    wanted = int(sys.argv[2]) if len(sys.argv) > 2 else 1500
    spark = session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    tables = td.tables_of(spark, folder, td.SPEND)
    samples = td.spend_samples(tables).select("sample_id", "entity_id", "cutoff")
    facts = evidence.facts(samples, td.SPEND, tables)
    total = facts.count()
    statements = [r["sql"] for r in facts.orderBy("sample_id", "query_ordinal").limit(wanted).collect()]
    started = time.perf_counter()
    facts.write.format("noop").mode("overwrite").save()
    set_wise = time.perf_counter() - started
    spark.stop()
    con = duckdb.connect()
    for name in td.RETAIL:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    started = time.perf_counter()
    for statement in statements:
        con.execute(statement).fetchdf().to_dict("records")
    each = (time.perf_counter() - started) / len(statements)
    print(f"{total} statements: {each * 1000:.2f} ms each, {each * total:.1f} s one by one; set-wise {set_wise:.1f} s")

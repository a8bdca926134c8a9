"""Recall of the near-duplicate components against an exact search in SQL: python -m tests.llm.recall [folder of tables]."""

from __future__ import annotations

import sys

import duckdb

from orrery.llm import queries
from orrery.session import session


def main(folder: str) -> None:
    spark = session("recall", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    got = {r.doc_id: r.component_id for r in queries.op8_near_dedup(spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, component_id FROM ({queries.oracle_sql()['op8_near_dedup']})").fetchall()}
    linked = [i for i, c in want.items() if c != i]
    found = sum(got[i] == want[i] for i in linked)
    wrong = sum(got[i] != want[i] for i in want) - (len(linked) - found)
    print(f"{len(want)} documents, {len(linked)} linked to a smaller one; recall {found / max(1, len(linked)):.6f}; others that differ: {wrong}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")

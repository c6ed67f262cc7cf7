"""Normalised turns against their SQL on texts where regular expressions of Java and of RE2 part."""

import duckdb

from pagelight.plans import queries as Q

TEXTS = [None, "", " ", "\n", "\x0b", "Noé va.", "No é", "no_one", "No1", "NO", " yes, sir ", "Yesé", "\nyes", "\tno", "yes\n", "a \n\t b\r\n", "\x0bno", "nó", "It is Not Found.", " No", "a\n", "a\n\n\u0085"]


def test_normalised_turns(spark, tmp_path):
    spark.createDataFrame([(n, 0, t) for n, t in enumerate(TEXTS)], "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.sql(Q.ORACLES["normalised_turns"]).fetchall())
    assert sorted(map(tuple, Q.QUERIES["normalised_turns"](spark, str(tmp_path)).collect())) == want

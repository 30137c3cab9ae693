"""The catalog check where several variants have one barcode."""

from pathlib import Path

import duckdb

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")


def test_own_variant_gives_the_price(spark, tmp_path):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        if p.stem != "lineitem":
            (tmp_path / p.name).symlink_to(p)
    # suppliers beyond 999 repeat the barcodes of other parts
    con.sql(f"SELECT * REPLACE (l_suppkey + (l_orderkey % 6) * 1000 AS l_suppkey) FROM '{SF}/lineitem.parquet'").write_parquet(str(tmp_path / "lineitem.parquet"))
    for p in tmp_path.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    name = "catalog_check_text_edit"
    cols = ["description", "image", "row_id", "warnings"]
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*cols).collect())
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want and any("PRICE_MISMATCH" in r[3] for r in got)

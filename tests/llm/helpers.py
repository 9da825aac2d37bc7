"""Small document tables with the awkward cases every operator must handle."""

import glob
import os

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def saved(spark, tmp_path, rows, schema="doc_id long, text string"):
    """A folder with these rows as its ``documents`` table."""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    found = con.sql(sql)
    return sorted((tuple(sorted(zip(found.columns, r))) for r in found.fetchall()), key=repr)


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)

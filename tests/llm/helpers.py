"""Plain-Python counterparts that the tests hold the operators against."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
LONG = "word " * 60_000 + "end"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]]); extra: columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "matches", "lang_pred", "score", "fp", "row", "__raw", "__row", "n_entities", "size", "copies_",
                     "places", "h", "__words", "a.b", "component_id", "__th"):
            df = df.withColumn(name, F.lit("x"))
    return df


def read(table, columns="*", sf=SF):
    return duckdb.sql(f"select {columns} from read_parquet('{sf}/{table}.parquet')").fetchall()


def same_as_oracle(spark, name, sf=SF):
    """The query's rows and its SQL's rows, both sorted, as comparable lists."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    mine = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = [tuple(r) for r in cur.fetchall()]
    assert sorted(names) == sorted(mine.columns)
    rows = [tuple(r) for r in mine.select(*names).collect()]
    assert sorted(rows, key=repr) == sorted(theirs, key=repr)


def components(vertices, links):
    """{vertex: smallest vertex reachable}."""
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in vertices}

"""Small graphs for tests."""

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from claimweave.functions.ids import literal_id
from claimweave.graph import CLAIMS, ClaimGraph
from claimweave.workspace import Workspace


def frame(spark, data, schema):
    """A small local frame; ``schema`` is a DDL string or a list of names."""
    data = [tuple(row) for row in data]
    if isinstance(schema, str):
        fields = to_arrow_schema(StructType.fromDDL(schema))
        columns = [pa.array([row[i] for row in data], f.type) for i, f in enumerate(fields)]
        return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields))
    columns = [pa.array([row[i] for row in data]) for i in range(len(schema))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=list(schema)))


def claims(spark, triples, seq=1, start=1):
    """Triples ``(l, p, r)``; a right side given as ``("lit", x)`` is a literal."""
    rows = []
    for i, (l, p, r) in enumerate(triples, start):
        right = literal_id(r[1]) if isinstance(r, tuple) else r
        rows.append((f"c:{i}", l, p, right, f"t:{seq}", seq, i))
    return frame(spark, rows, CLAIMS)


def stored(df):
    """The same rows read back from a written table, so that they are computed once."""
    return Workspace(df.sparkSession).save(df, "test").df()


def graph(spark, triples, seq=1, start=1):
    return ClaimGraph(claims(spark, triples, seq, start))


def lit(value):
    return ("lit", value)


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in df.collect())


def closure_of(edges):
    paths = set(edges)
    while True:
        more = paths | {(a, d) for a, b in paths for c, d in edges if b == c}
        if more == paths:
            return paths
        paths = more


def tx_rows(spark, *rows_):
    return frame(spark, list(rows_), "tx_id string, seq bigint, agent string")


def requests(spark, rows_, schema="l string, p string, r string, ord bigint"):
    return frame(spark, rows_, schema)

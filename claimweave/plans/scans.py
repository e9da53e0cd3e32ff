"""Loading, pattern scans, lookups and base relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import ids
from claimweave.graph import ClaimGraph
from claimweave.operators import lookup
from claimweave.operators.conjunctive import query
from claimweave.operators.mutate import rename
from claimweave.plans.registry import analysis, once, stored_graph, table
from claimweave.plans.shop import (
    SPECS,
    SQL_ACTIVITY,
    SQL_SHOP,
    activity,
    claims_of,
    shop,
    values_of,
)
from claimweave.rules import atom, ref
from claimweave.sources.export import read_export, write_export
from claimweave.sources.relational import (
    TableSpec,
    implicit_transactions,
    intern_column,
    named_entities,
    table_claims,
)
from claimweave.sources.store import GraphStore, write_projection
from claimweave.workspace import Workspace


@analysis("load_tables_as_claims", f"{SQL_SHOP}")
def _(spark, sf):
    return claims_of(spark, sf, *SPECS).select("cid", "l", "p", "r", "ord")


@analysis(
    "load_values",
    f"SELECT DISTINCT r AS vid, substr(r, 3, 1) AS lit_type, substr(r, 5) AS lit "
    f"FROM ({SQL_SHOP}) WHERE r LIKE 'v:%'",
)
def _(spark, sf):
    return values_of(spark, sf, *SPECS)


@analysis(
    "store_and_restore",
    f"SELECT cid, l, p, r, ord, CASE WHEN r LIKE 'v:%' THEN substr(r, 5) END AS lit FROM ({SQL_SHOP})",
)
def _(spark, sf):
    graph = shop(spark, sf)
    return graph.ground(graph.claims.select("cid", "l", "p", "r", "ord"), "r", "lit")


def _exports(spark, sf, version: int):
    """One small exported document per customer, as JSON lines."""
    customers = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    literal = F.to_json(F.struct(F.col("c_name").alias("x")))
    quoted = F.regexp_extract(literal, r'^\{"x":(.*)\}$', 1)

    def doc(text):
        return F.regexp_replace(F.regexp_replace(F.lit(text), "@K", key), "@N", quoted)

    body = (
        '"objects":["u@K"],"values":[["n@K",@N],["b@K",@K],["f@K",true],["g@K","@K"]],'
        '"claims":[["x@K","u@K","name","n@K"],["y@K","u@K","number","b@K"],'
        '["z@K","u@K","flag","f@K"],["w@K","u@K","code","g@K"]],"superseded":[]'
    )
    if version == 2:
        body += (
            ',"version":2,"tx-counter":2,"claim-txs":[["x@K","t@K"],["y@K","t@K"],'
            '["z@K","s@K"],["w@K","s@K"]],"tx-meta":[["t@K",1],["s@K",2,"agent-@K"]]'
        )
    path = Workspace(spark).path(f"export-v{version}")
    customers.select(doc("{" + body + "}")).write.text(path)
    return read_export(spark, path, lines=True)


_EXPORT_SQL = """
SELECT 'x' || c_custkey AS cid, 'u' || c_custkey AS l, 'name' AS p, 'v:s:' || c_name AS r,
       CAST({first} AS BIGINT) AS tx_seq, {agent1} AS agent FROM customer
UNION ALL SELECT 'y' || c_custkey, 'u' || c_custkey, 'number', 'v:i:' || c_custkey, {first}, {agent1} FROM customer
UNION ALL SELECT 'z' || c_custkey, 'u' || c_custkey, 'flag', 'v:b:true', {second}, {agent2} FROM customer
UNION ALL SELECT 'w' || c_custkey, 'u' || c_custkey, 'code', 'v:s:' || c_custkey, {second}, {agent2} FROM customer
"""


def _with_agent(graph: ClaimGraph):
    return graph.claims.join(graph.txs.select("tx_id", "agent"), "tx_id").select(
        "cid", "l", "p", "r", "tx_seq", "agent"
    )


@analysis(
    "import_export_v2",
    _EXPORT_SQL.format(
        first=1, second=2, agent1="CAST(NULL AS VARCHAR)", agent2="'agent-' || c_custkey"
    ),
)
def _(spark, sf):
    return _with_agent(_exports(spark, sf, 2))


@analysis(
    "import_export_v1",
    _EXPORT_SQL.format(
        first=1, second=1, agent1="CAST(NULL AS VARCHAR)", agent2="CAST(NULL AS VARCHAR)"
    ),
)
def _(spark, sf):
    return _with_agent(_exports(spark, sf, 1))


def _numbered_exports(spark, sf):
    """Documents with numbers for ids: one that gives the predicates their symbols, one per customer.

    A customer's name is claimed, then claimed anew; the list hides the first claim, and of
    customers with an even key the weight too, which no claim supersedes.
    """
    path = Workspace(spark).path("export-numbers")
    symbols = (
        '{"version":2,"values":[["2","symbol"],["4","name"],["6","supersedes"],["8","balance"]],"claims":[["30","1","1","2"],'
        '["31","3","1","4"],["32","5","1","6"],["33","7","1","8"]],"claim-txs":[["30","9"],["31","9"],["32","9"],["33","9"]],"tx-meta":[["9",1]]}'
    )
    customers = table(spark, sf, "customer")
    number = lambda k: F.concat(F.lit('"'), (F.col("c_custkey") * 100 + k).cast("string"), F.lit('"'))
    ids = {f"#{k}": number(k) for k in (10, 11, 12, 13, 20, 21, 22, 23, 30, 31)}
    name = F.regexp_replace(F.to_json(F.array("c_name")), r"^\[|\]$", "")
    text = F.lit(
        '{"version":2,"values":[[#11,@N],[#12,@O],[#13,@B]],"claims":[[#20,#10,"3",#11],[#21,#10,"3",#12],[#22,#21,"5",#20],'
        '[#23,#10,"7",#13]],"superseded":[#20@E],"claim-txs":[[#20,#30],[#21,#31],[#22,#31],[#23,#30]],"tx-meta":[[#30,2],[#31,3,"ann"]]}'
    )
    for mark, column in ids.items():
        text = F.replace(text, F.lit(mark), column)
    text = F.replace(text, F.lit("@E"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(","), ids["#23"])).otherwise(""))
    text = F.replace(text, F.lit("@B"), F.col("c_acctbal").cast("double").cast("string"))
    text = F.replace(F.replace(text, F.lit("@O"), F.concat(F.lit('"new '), F.substr(name, F.lit(2)))), F.lit("@N"), name)
    rows = customers.select(text.alias("value")).unionByName(spark.range(1).select(F.lit(symbols).alias("value")))
    rows.write.text(path)
    return read_export(spark, path, lines=True)


@analysis(
    "import_export_numbers",
    "SELECT CAST(c_custkey * 100 + 10 AS VARCHAR) AS l, 'name' AS p, 'new ' || c_name AS lit, CAST(NULL AS DOUBLE) AS num FROM customer "
    "UNION ALL SELECT CAST(c_custkey * 100 + 10 AS VARCHAR), 'balance', NULL, CAST(c_acctbal AS DOUBLE) FROM customer WHERE c_custkey % 2 = 1 "
    "UNION ALL SELECT CAST(c_custkey * 100 + 21 AS VARCHAR), 'supersedes', NULL, NULL FROM customer "
    "UNION ALL SELECT CAST(c_custkey * 100 + 23 AS VARCHAR), 'supersedes', NULL, NULL FROM customer WHERE c_custkey % 2 = 0 "
    "UNION ALL SELECT l, 'symbol', s, NULL FROM (VALUES ('1', 'symbol'), ('3', 'name'), ('5', 'supersedes'), ('7', 'balance')) v(l, s)",
)
def _(spark, sf):
    graph = _numbered_exports(spark, sf)
    live = graph.ground(graph.current().select("l", "p", "r"), "r", "text")
    number = F.col("p") == "balance"
    return live.select("l", "p", F.when(~number, F.col("text")).alias("lit"), F.when(number, F.col("text").cast("double")).alias("num"))


_DEFINED = f"SELECT 'c:predicate/' || p || '/symbol' AS cid, 'e:predicate/' || p AS l, 'symbol' AS p, 'v:s:' || p AS r FROM (SELECT DISTINCT p FROM ({SQL_SHOP}))"


def _defined_shop(spark, sf) -> ClaimGraph:
    graph = shop(spark, sf)
    names = graph.claims.select(F.col("p").alias("name")).distinct().withColumn("symbol", F.col("name")).withColumn("o", F.xxhash64("name"))
    return graph.with_claims(table_claims(names, TableSpec("predicate", "name", {"symbol": "symbol"}, order="o")))


@analysis(
    "export_round_trip",
    f"SELECT cid, l, p, r, ord FROM ({SQL_SHOP}) UNION ALL SELECT cid, l, p, r, NULL FROM ({_DEFINED})",
)
def _(spark, sf):
    # The whole graph is written as JSON and read back; predicates travel as the objects they are.
    path = Workspace(spark).path("export")
    write_export(_defined_shop(spark, sf), path, compression="gzip")
    back = read_export(spark, path, lines=True)
    return back.claims.select("cid", "l", "p", "r", F.when(F.col("p") != "symbol", F.col("ord")).alias("ord"))


@analysis(
    "exported_predicates",
    f"SELECT l AS p, count(*) AS claims FROM (SELECT 'e:predicate/' || p AS l FROM ({SQL_SHOP})) GROUP BY l "
    f"UNION ALL SELECT '1', count(*) FROM ({_DEFINED})",
)
def _(spark, sf):
    # What is written, read as plain JSON: predicates are ids, ``1`` gives symbols.
    path = Workspace(spark).path("export")
    write_export(_defined_shop(spark, sf), path)
    lines = spark.read.schema("claims array<array<string>>").json(path)
    claims = lines.select(F.explode("claims").alias("c")).select(F.col("c")[2].alias("p"))
    return claims.groupBy("p").agg(F.count(F.lit(1)).alias("claims"))


@analysis(
    "define_predicates",
    f"SELECT DISTINCT 'c:predicate/' || p || '/symbol' AS cid, 'e:predicate/' || p AS l, "
    f"'symbol' AS p, 'v:s:' || p AS r FROM ({SQL_SHOP})",
)
def _(spark, sf):
    names = claims_of(spark, sf, *SPECS).select(F.col("p").alias("name")).distinct()
    numbered = names.withColumn("symbol", F.col("name")).withColumn("o", F.xxhash64("name"))
    spec = TableSpec("predicate", "name", {"symbol": "symbol"}, order="o")
    return table_claims(numbered, spec).select("cid", "l", "p", "r")


@analysis(
    "pattern_scans",
    f"WITH claims AS ({SQL_SHOP}), b AS (SELECT 'e:customer/7' AS bl, 'located-in' AS bp, "
    "'e:nation/3' AS br) "
    "SELECT 'none' AS shape, cid FROM claims "
    "UNION ALL SELECT 'l', cid FROM claims, b WHERE l = bl "
    "UNION ALL SELECT 'p', cid FROM claims, b WHERE p = bp "
    "UNION ALL SELECT 'r', cid FROM claims, b WHERE r = br "
    "UNION ALL SELECT 'lp', cid FROM claims, b WHERE l = bl AND p = bp "
    "UNION ALL SELECT 'pr', cid FROM claims, b WHERE p = bp AND r = br "
    "UNION ALL SELECT 'lr', cid FROM claims, b WHERE l = bl AND r = br "
    "UNION ALL SELECT 'lpr', cid FROM claims, b WHERE l = bl AND p = bp AND r = br",
)
def _(spark, sf):
    graph = shop(spark, sf)
    bound = {"l": "e:customer/7", "p": "located-in", "r": "e:nation/3"}
    shapes = ["", "l", "p", "r", "lp", "pr", "lr", "lpr"]
    parts = [
        graph.claims_where(**{slot: bound[slot] for slot in shape}).select(
            F.lit(shape or "none").alias("shape"), "cid"
        )
        for shape in shapes
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@analysis(
    "claims_about_and_targeting",
    f"WITH claims AS ({SQL_SHOP}) "
    "SELECT 'about' AS direction, cid, p, r AS other FROM claims WHERE l = 'e:nation/4' "
    "UNION ALL SELECT 'targeting', cid, p, l FROM claims WHERE r = 'e:nation/4'",
)
def _(spark, sf):
    graph = shop(spark, sf)
    about = graph.claims_about("e:nation/4").select(
        F.lit("about").alias("direction"), "cid", "p", F.col("r").alias("other")
    )
    return about.unionByName(
        graph.claims_targeting("e:nation/4").select(
            F.lit("targeting").alias("direction"), "cid", "p", F.col("l").alias("other")
        )
    )


@analysis(
    "live_pattern_scan",
    f"WITH {SQL_ACTIVITY} SELECT cid, l, r, ord FROM claims "
    "WHERE p = 'last-event' AND cid NOT IN (SELECT cid FROM hid)",
)
def _(spark, sf):
    return activity(spark, sf).current(p="last-event").select("cid", "l", "r", "ord")


@analysis(
    "hide_superseded",
    f"WITH {SQL_ACTIVITY} SELECT cid, l, p, r FROM claims c "
    "WHERE NOT EXISTS (SELECT 1 FROM hid WHERE hid.cid = c.cid)",
)
def _(spark, sf):
    return activity(spark, sf).current().select("cid", "l", "p", "r")


@analysis(
    "fetch_claims_by_id",
    f"WITH {SQL_ACTIVITY} SELECT cid, l, p, r FROM claims "
    "WHERE cid IN (SELECT 'c:event/' || event_id FROM events WHERE event_type = 'purchase')",
)
def _(spark, sf):
    wanted = (
        table(spark, sf, "events")
        .filter(F.col("event_type") == "purchase")
        .select(F.concat(F.lit("c:event/"), F.col("event_id").cast("string")).alias("cid"))
    )
    return activity(spark, sf).get_claims(wanted).select("cid", "l", "p", "r")


@analysis(
    "check_objects",
    f"WITH {SQL_ACTIVITY}, wanted AS (SELECT DISTINCT 'c:event/' || (event_id * 2) AS id FROM events "
    "UNION SELECT 'e:user/' || (user_id * 2) FROM events) "
    "SELECT id, id IN (SELECT cid FROM claims UNION SELECT l FROM claims UNION SELECT r FROM claims) "
    "AS object_exists, id IN (SELECT cid FROM hid) AS superseded FROM wanted",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    wanted = events.select(
        F.explode(
            F.array(
                F.concat(F.lit("c:event/"), (F.col("event_id") * 2).cast("string")),
                F.concat(F.lit("e:user/"), (F.col("user_id") * 2).cast("string")),
            )
        ).alias("id")
    )
    return activity(spark, sf).check_objects(wanted)


@analysis(
    "all_objects",
    f"WITH claims AS ({SQL_SHOP}), ids AS (SELECT cid AS id FROM claims UNION SELECT l FROM claims "
    "UNION SELECT p FROM claims UNION SELECT r FROM claims UNION SELECT 't:1') "
    "SELECT id, CASE WHEN id LIKE 'c:%' THEN 'claim' WHEN id LIKE 'v:%' THEN 'value' "
    "ELSE 'entity' END AS kind FROM ids",
)
def _(spark, sf):
    return shop(spark, sf).objects()


@analysis(
    "intern_literals",
    "SELECT DISTINCT CASE WHEN length(text) > 64 THEN 'v:s#' || sha256(text) ELSE 'v:s:' || text END "
    "AS vid, 's' AS lit_type, CAST(length(text) AS BIGINT) AS chars FROM documents",
)
def _(spark, sf):
    values = intern_column(table(spark, sf, "documents"), "text")
    return values.select("vid", "lit_type", F.length("lit").cast("bigint").alias("chars"))


def _documents(spark, sf) -> ClaimGraph:
    def build():
        from claimweave.sources.relational import table_values

        docs = table(spark, sf, "documents")
        spec = TableSpec("document", "doc_id", {"text": "text", "lang": "lang"}, {"source": ("from", "source")})
        return stored_graph(
            spark, table_claims(docs, spec), "documents", values=table_values(docs, spec)
        )

    return once(spark, sf, "documents", build)


@analysis(
    "ground_literals",
    "SELECT 'e:document/' || doc_id AS l, 'text' AS p, sha256(text) AS digest FROM documents "
    "UNION ALL SELECT 'e:document/' || doc_id, 'lang', sha256(lang) FROM documents "
    "UNION ALL SELECT 'e:document/' || doc_id, 'from', CAST(NULL AS VARCHAR) FROM documents",
)
def _(spark, sf):
    graph = _documents(spark, sf)
    return graph.ground(graph.claims.select("l", "p", "r"), "r", "literal").select(
        "l", "p", F.sha2("literal", 256).alias("digest")
    )


@analysis(
    "long_texts_survive_changes",
    "SELECT 'e:document/' || doc_id AS l, sha256(text) AS digest, 1 AS tx FROM documents WHERE text IS NOT NULL "
    "UNION ALL SELECT 'e:item/' || item_id, sha256(text), 2 FROM benchmark "
    "UNION ALL SELECT 'e:document/' || doc_id, sha256('again: ' || text), 3 FROM documents WHERE text IS NOT NULL AND lang = 'fr'",
)
def _(spark, sf):
    # Texts travel with their claims: through a load, a second batch and a change of names.
    docs = table(spark, sf, "documents")
    store = GraphStore(spark, Workspace(spark).path("texts"))
    store.commit("load", table_claims(docs, TableSpec("document", "doc_id", {"text": "name"})))
    items = TableSpec("item", "item_id", {"text": "name"}, base=10**12)
    store.commit("items", table_claims(table(spark, sf, "benchmark"), items, 2))
    renamed = docs.filter("lang = 'fr' AND text IS NOT NULL").select(
        ids.entity_id("document", "doc_id").alias("l"), F.concat(F.lit("again: "), "text").alias("name"), (F.lit(10**13) + F.col("doc_id")).alias("ord")
    )
    store.commit("rename", rename(store.graph(), renamed, 3))
    graph = store.graph()
    claims = graph.claims_where(p="name").select("l", "r", F.col("tx_seq").cast("int").alias("tx"))
    return graph.ground(claims, "r", "text").select("l", F.sha2("text", 256).alias("digest"), "tx")


@analysis(
    "long_literal_lookup",
    "SELECT DISTINCT a.text = b.text AS same_text, 'e:document/' || a.doc_id AS l "
    "FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id "
    "WHERE length(a.text) > 64",
)
def _(spark, sf):
    # Documents with equal texts share one value id: found by the id alone.
    texts = _documents(spark, sf).claims_where(p="text").filter(ids.is_long_value(F.col("r")))
    shared = texts.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return texts.join(shared, "r", "left_semi").select(F.lit(True).alias("same_text"), "l")


@analysis(
    "named_entities",
    "SELECT 'c:part/' || p_partkey || '/symbol' AS cid, 'e:part/' || p_partkey AS l, "
    "'symbol' AS p, 'v:s:' || p_name AS r, CAST(p_partkey AS BIGINT) AS ord FROM part",
)
def _(spark, sf):
    claims = named_entities(table(spark, sf, "part"), "part", "p_partkey", "p_name")
    return claims.select("cid", "l", "p", "r", "ord")


def _symbols(spark, sf) -> ClaimGraph:
    """Symbols for small parts, names for all, positions for even sizes."""

    def build():
        part = table(spark, sf, "part")
        small = part.filter(F.col("p_size") <= 25)
        even = part.filter(F.col("p_size") % 2 == 0)
        symbols = named_entities(small, "part", "p_partkey", "p_name")
        names = table_claims(part, TableSpec("part", "p_partkey", {"p_name": "name"}))
        places = table_claims(even, TableSpec("part", "p_partkey", {"p_size": "position"}))
        return stored_graph(spark, symbols.unionByName(names, allowMissingColumns=True).unionByName(places, allowMissingColumns=True), "symbols")

    return once(spark, sf, "symbols", build)


@analysis(
    "resolve_symbols",
    "WITH c AS (SELECT p_name AS name, 'e:part/' || p_partkey AS l, 1 AS prio, p_partkey AS ord, p_size "
    "FROM part WHERE p_size <= 25 UNION ALL SELECT p_name, 'e:part/' || p_partkey, 0, p_partkey, p_size "
    "FROM part), w AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand FROM part), "
    "b AS (SELECT name, l, row_number() OVER (PARTITION BY name ORDER BY prio DESC, "
    "(p_size % 2 = 0) ASC, ord DESC) AS k FROM c) "
    "SELECT w.name, b.l AS entity FROM w LEFT JOIN b ON w.name = b.name AND k = 1",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    wanted = part.select(F.explode(F.array("p_name", "p_brand")).alias("name"))
    return lookup.resolve_symbols(_symbols(spark, sf), wanted)


@analysis(
    "newest_value",
    f"WITH {SQL_ACTIVITY} SELECT l, arg_max(r, ord) AS r, substr(arg_max(r, ord), 5) AS value "
    "FROM claims WHERE p = 'last-event' AND cid NOT IN (SELECT cid FROM hid) GROUP BY l",
)
def _(spark, sf):
    return lookup.lookup(activity(spark, sf), "last-event").select("l", "r", "value")


@analysis(
    "all_values",
    "SELECT 'e:customer/' || o_custkey AS l, 'e:order/' || o_orderkey AS value FROM orders",
)
def _(spark, sf):
    # A multi-valued property: the orders of each customer.
    def build():
        spec = TableSpec("customer", "o_custkey", {}, {"o_orderkey": ("ordered", "order")}, order="o_orderkey")
        claims = table_claims(table(spark, sf, "orders"), spec)
        claims = claims.withColumn("cid", F.concat(F.lit("c:ordered/"), F.col("ord").cast("string")))
        return stored_graph(spark, claims, "ordered")

    return lookup.lookup_all(once(spark, sf, "ordered", build), "ordered").select("l", "value")


@analysis(
    "find_by_value",
    "SELECT 'e:customer/' || c_custkey AS l, 'segment' AS why FROM customer WHERE c_mktsegment = 'BUILDING' "
    "UNION ALL SELECT 'e:customer/' || c_custkey, 'nation' FROM customer WHERE c_nationkey = 3 "
    "UNION ALL SELECT 'e:supplier/' || s_suppkey, 'nation' FROM supplier WHERE s_nationkey = 3",
)
def _(spark, sf):
    graph = shop(spark, sf)
    by_literal = lookup.find_by(graph, "segment", "BUILDING").withColumn("why", F.lit("segment"))
    by_link = lookup.find_by(graph, "located-in", ref("e:nation/3"))
    return by_literal.unionByName(by_link.withColumn("why", F.lit("nation")))


@analysis(
    "find_by_double",
    "SELECT 'e:supplier/' || s_suppkey AS l, CASE WHEN s_acctbal >= 6000 THEN 1e10 WHEN s_acctbal >= 3000 THEN 2.5e-7 ELSE -0.125 END AS lim FROM supplier",
)
def _(spark, sf):
    # A constant meets the claims of its column, however large or small it is.
    limit = F.when(F.col("s_acctbal") >= 6000, F.lit(1e10)).when(F.col("s_acctbal") >= 3000, F.lit(2.5e-7)).otherwise(F.lit(-0.125))
    rows = table(spark, sf, "supplier").withColumn("lim", limit)
    graph = ClaimGraph(table_claims(rows, TableSpec("supplier", "s_suppkey", {"lim": "limit"})))
    found = [lookup.find_by(graph, "limit", x).withColumn("lim", F.lit(x)) for x in (1e10, 2.5e-7, -0.125)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@analysis(
    "display_names",
    "SELECT 'e:order/' || o_orderkey AS o, coalesce(c_name, 'e:customer/' || o_custkey) AS customer "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(spark, sf):
    graph = shop(spark, sf)
    placed = graph.current(p="placed-by").select(F.col("l").alias("o"), F.col("r").alias("customer"))
    return lookup.with_names(graph, placed, "o", "customer")


@analysis(
    "classify_objects",
    f"WITH claims AS ({SQL_SHOP}), w AS (SELECT DISTINCT l AS id FROM claims UNION SELECT r FROM claims "
    "UNION SELECT cid FROM claims UNION SELECT 'e:customer/' || -1 - c_custkey FROM customer), "
    "n AS (SELECT l, arg_max(r, ord) AS r FROM claims WHERE p = 'name' GROUP BY l), "
    "known AS (SELECT l AS id FROM claims UNION SELECT r FROM claims UNION SELECT cid FROM claims) "
    "SELECT w.id, CASE WHEN w.id NOT IN (SELECT id FROM known) THEN 'unknown' "
    "WHEN w.id LIKE 'v:%' THEN 'value' WHEN n.r IS NOT NULL THEN 'named' "
    "WHEN w.id LIKE 'c:%' THEN 'claim' ELSE 'entity' END AS kind, "
    "CASE WHEN w.id LIKE 'v:%' THEN substr(w.id, 5) ELSE substr(n.r, 5) END AS display "
    "FROM w LEFT JOIN n ON w.id = n.l",
)
def _(spark, sf):
    graph = shop(spark, sf)
    strangers = table(spark, sf, "customer").select(
        F.concat(F.lit("e:customer/"), (-1 - F.col("c_custkey")).cast("string")).alias("id")
    )
    wanted = graph.claims.select(F.explode(F.array("l", "r", "cid")).alias("id"))
    return lookup.classify_objects(graph, wanted.unionByName(strangers))


@analysis(
    "inspect_objects",
    f"WITH claims AS ({SQL_SHOP}), w AS (SELECT 'e:nation/' || n_nationkey AS id, n_name FROM nation) "
    "SELECT id, 'self' AS direction, CAST(NULL AS VARCHAR) AS cid, 'named' AS p, n_name AS other, "
    "false AS superseded FROM w "
    "UNION ALL SELECT id, 'about', cid, p, r, false FROM w JOIN claims ON l = id "
    "UNION ALL SELECT id, 'targeting', cid, p, l, false FROM w JOIN claims ON r = id",
)
def _(spark, sf):
    wanted = table(spark, sf, "nation").select(ids.entity_id("nation", "n_nationkey").alias("id"))
    return lookup.inspect(shop(spark, sf), wanted)


@analysis(
    "inspect_claims",
    f"WITH {SQL_ACTIVITY} SELECT c.cid AS id, c.p, c.l || ' ' || c.p || ' ' || c.r AS other, "
    "hid.cid IS NOT NULL AS superseded FROM claims c LEFT JOIN hid ON c.cid = hid.cid",
)
def _(spark, sf):
    graph = activity(spark, sf)
    wanted = graph.claims.select(F.col("cid").alias("id"))
    found = lookup.inspect(graph, wanted).filter(F.col("direction") == "claim")
    return found.select("id", "p", "other", "superseded")


@analysis(
    "wide_rows",
    "SELECT 'e:customer/' || c_custkey AS l, c_name AS name, c_mktsegment AS segment, "
    "'e:nation/' || c_nationkey AS located FROM customer "
    "UNION ALL SELECT 'e:supplier/' || s_suppkey, s_name, NULL, 'e:nation/' || s_nationkey FROM supplier "
    "UNION ALL SELECT 'e:nation/' || n_nationkey, n_name, NULL, 'e:region/' || n_regionkey FROM nation "
    "UNION ALL SELECT 'e:region/' || r_regionkey, r_name, NULL, NULL FROM region "
    "UNION ALL SELECT 'e:part/' || p_partkey, p_name, NULL, NULL FROM part",
)
def _(spark, sf):
    rows = lookup.wide(shop(spark, sf), ["name", "segment", "located-in"])
    return rows.select("l", "name", "segment", F.col("`located-in`").alias("located"))


@analysis(
    "base_relation_scans",
    f"WITH {SQL_ACTIVITY}, live AS (SELECT * FROM claims WHERE cid NOT IN (SELECT cid FROM hid)) "
    "SELECT 'triple' AS rel, l AS a, p AS b, r AS c FROM claims "
    "UNION ALL SELECT 'current-triple', l, p, r FROM live "
    "UNION ALL SELECT 'claim', cid, l || p, r FROM claims "
    "UNION ALL SELECT 'current-claim', cid, l || p, r FROM live "
    "UNION ALL SELECT DISTINCT 'value', r, substr(r, 5), CAST(NULL AS VARCHAR) FROM claims WHERE r LIKE 'v:%' "
    "UNION ALL SELECT 'object', id, NULL, NULL FROM (SELECT cid AS id FROM claims UNION SELECT l FROM claims "
    "UNION SELECT p FROM claims UNION SELECT r FROM claims UNION SELECT tx_id FROM txs)",
)
def _(spark, sf):
    graph = activity(spark, sf)
    none = F.lit(None).cast("string")
    shown = {
        "triple": ("l", "p", "r"),
        "current-triple": ("l", "p", "r"),
        "claim": ("cid", F.concat("l", "p"), "r"),
        "current-claim": ("cid", F.concat("l", "p"), "r"),
        "value": ("vid", "lit", none),
        "object": ("id", none, none),
    }
    merged = None
    for rel, columns in shown.items():
        columns = [F.col(c) if isinstance(c, str) else c for c in columns]
        part = graph.relation(rel).select(
            F.lit(rel).alias("rel"), *[c.alias(n) for c, n in zip(columns, "abc")]
        )
        merged = part if merged is None else merged.unionByName(part)
    return merged


@analysis(
    "repeated_variable",
    "SELECT 'e:part/' || a AS x, 'e:part/' || a AS via FROM (SELECT p_partkey // 2 AS b, p_partkey AS a "
    "FROM part) WHERE a = b",
)
def _(spark, sf):
    # A part that is its own parent: the same variable in two slots of an atom.
    part = table(spark, sf, "part").withColumn("half", F.floor(F.col("p_partkey") / 2).cast("bigint"))
    graph = ClaimGraph(table_claims(part, TableSpec("part", "p_partkey", {}, {"half": ("half", "part")})))
    found = query(graph, atom("triple", "?x", ref("half"), "?x"))
    return found.withColumn("via", F.col("x"))


@analysis(
    "implicit_transactions",
    "SELECT 'c:part/' || p_partkey || '/name' AS cid, 't:' || (100 + row_number() OVER (ORDER BY p_partkey)) "
    "AS tx_id, CAST(100 + row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS tx_seq FROM part",
)
def _(spark, sf):
    claims = table_claims(table(spark, sf, "part"), TableSpec("part", "p_partkey", {"p_name": "name"}))
    return implicit_transactions(claims, "ord", base_seq=100).select("cid", "tx_id", "tx_seq")


@analysis(
    "dangling_references",
    "SELECT 'c:order/' || o_orderkey || '/after' AS cid, 'r' AS slot, 'c:order/' || (o_orderkey + 100) AS id "
    "FROM orders WHERE (o_orderkey + 100) NOT IN (SELECT o_orderkey FROM orders)",
)
def _(spark, sf):
    # Claims about claims, some of which name a claim that is not there.
    orders = table(spark, sf, "orders").select("o_orderkey")
    key = F.col("o_orderkey").cast("string")
    made = orders.select(
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("c:order/"), key).alias("cid"), F.lit("self").alias("p"),
                    F.concat(F.lit("e:order/"), key).alias("r"),
                ),
                F.struct(
                    F.concat(F.lit("c:order/"), key, F.lit("/after")).alias("cid"), F.lit("after").alias("p"),
                    F.concat(F.lit("c:order/"), (F.col("o_orderkey") + 100).cast("string")).alias("r"),
                ),
            )
        ).alias("c"),
        F.concat(F.lit("e:order/"), key).alias("l"), F.col("o_orderkey").alias("ord"),
    ).select("c.*", "l", "ord", F.lit("t:1").alias("tx_id"), F.lit(1).cast("bigint").alias("tx_seq"))
    return ClaimGraph(made).dangling()


@analysis(
    "projection_written",
    f"SELECT cid, l, p, r FROM ({SQL_SHOP})",
)
def _(spark, sf):
    folder = Workspace(spark).path("projection")
    graph = shop(spark, sf)
    kinds = [r.p for r in graph.claims.select("p").distinct().collect()]  # the columns of the tables
    write_projection({p: graph.claims_where(p=p) for p in kinds}, folder)
    return spark.read.parquet(*[f"{folder}/{p}" for p in kinds]).select("cid", "l", "p", "r")


@analysis(
    "atomic_batches",
    f"SELECT cid, l, p, r, ord FROM ({SQL_SHOP})",
)
def _(spark, sf):
    # Two batches land, a third is rejected as a whole by a violation.
    store = GraphStore(spark, Workspace(spark).path("batches"))
    store.commit("one", claims_of(spark, sf, "customer", "supplier", "orders", "part"))
    second = claims_of(spark, sf, "nation", "region")
    store.commit("two", second)
    try:
        store.commit("three", second, validate=second.filter(F.col("p") == "name"))
    except ValueError:
        pass
    return store.graph().claims.select("cid", "l", "p", "r", "ord")

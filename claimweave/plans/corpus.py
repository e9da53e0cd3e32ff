"""A Python corpus written from the part table, parsed back and analysed.

Part k becomes a function calling the function of part k // 2, a list or dict of its
labels, and for some sizes a class or a doubtful import.  Sixteen parts share a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.graph import ClaimGraph
from claimweave.operators import checks, naming, reports
from claimweave.operators.dependencies import dependency_program, discover, symbols, variable_values
from claimweave.plans.registry import analysis, once, stored_graph, table
from claimweave.sources.python_source import SYNTAX, Corpus, parse_files, tag_module
from claimweave.workspace import Workspace

FUNCTIONS_PER_FILE = 16

# Variable name stem per part type; anything else is LIST.
STEMS = (("ECONOMY", "ACTIVE"), ("PROMO", "MAP"), ("STANDARD", "TERMINAL"))


def files(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    text = k.cast("string")
    up = F.floor(k / 2).cast("bigint").cast("string")
    module = F.floor(k / FUNCTIONS_PER_FILE).cast("bigint")
    home = F.floor(F.floor(k / 2) / FUNCTIONS_PER_FILE).cast("bigint")
    stem = F.lit("LIST")
    for kind, name in STEMS:
        stem = F.when(F.col("p_type") == kind, name).otherwise(stem)
    variable = F.concat(stem, F.lit("_"), text)
    values = (
        F.when(F.col("p_type") == "PROMO", F.format_string('{"%s": "%s"}', "p_brand", "p_name"))
        .when(F.col("p_type") == "SMALL", F.format_string('["%s"]', "p_brand"))
        .otherwise(F.format_string('["%s", "%s"]', "p_brand", "p_name"))
    )
    imported = F.when(
        (k > 0) & (module != home),
        F.concat(
            F.lit("from "), F.when(F.col("p_size") > 45, F.lit("elsewhere")).otherwise(F.concat(F.lit("m"), home.cast("string"))),
            F.lit(" import f_"), up, F.lit("\n"),
        ),
    ).otherwise("")
    missing = F.when(F.col("p_size") < 3, F.concat(F.lit("from util import missing_"), text, F.lit("\n"))).otherwise("")
    function = F.when(k == 0, F.lit("def f_0(x, n=1):\n    return x\n")).otherwise(
        F.concat(
            F.lit("def f_"), text, F.lit("(x, n: int = 1) -> int:\n    return f_"), up,
            F.lit("(x) + len("), variable, F.lit(")\n"),
        )
    )
    method = F.when(
        F.col("p_size") == 10,
        F.concat(
            F.lit("class C_"), text, F.lit("(Box):\n    def run(self):\n        return f_"), text, F.lit("(self)\n"),
        ),
    ).otherwise("")
    piece = F.concat(imported, missing, variable, F.lit(" = "), values, F.lit("\n"), function, method)
    # A file gathers sixteen parts by construction, whatever the data.
    return (
        table(spark, sf, "part")
        .groupBy(module.alias("m"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct(k.alias("k"), piece.alias("t"))))["t"], "").alias("source"))
        .select(F.concat(F.lit("src/m"), F.col("m").cast("string"), F.lit(".py")).alias("path"), "source")
    )


def corpus(spark, sf) -> Corpus:
    def build():
        written = Workspace(spark).save(parse_files(files(spark, sf)), "syntax")
        return Corpus(written.df())

    return once(spark, sf, "corpus", build)


def code_graph(spark, sf) -> ClaimGraph:
    return once(
        spark, sf, "code", lambda: stored_graph(spark, corpus(spark, sf).claims(), "code")
    )


def dependencies(spark, sf) -> dict[str, DataFrame]:
    return once(
        spark, sf, "dependencies", lambda: dependency_program().derive(code_graph(spark, sf))
    )


_STEM = "CASE p_type WHEN 'ECONOMY' THEN 'ACTIVE' WHEN 'PROMO' THEN 'MAP' WHEN 'STANDARD' THEN 'TERMINAL' ELSE 'LIST' END"
_DEFS = f"""
d AS (
  SELECT 'f_' || p_partkey AS name, 'function' AS kind, 'm' || (p_partkey // 16) AS module FROM part
  UNION ALL SELECT {_STEM} || '_' || p_partkey, 'variable', 'm' || (p_partkey // 16) FROM part
  UNION ALL SELECT 'C_' || p_partkey, 'class', 'm' || (p_partkey // 16) FROM part WHERE p_size = 10
  UNION ALL SELECT 'run', 'function', 'm' || (p_partkey // 16) FROM part WHERE p_size = 10)
"""
_DEPENDS = (
    "dep AS (SELECT 'f_' || p_partkey AS src, 'f_' || (p_partkey // 2) AS dst FROM part WHERE p_partkey > 0 "
    "UNION ALL SELECT 'run', 'f_' || p_partkey FROM part WHERE p_size = 10)"
)
_IMPORTS = """
im AS (
  SELECT p_partkey // 16 AS m, CASE WHEN p_size > 45 THEN 'elsewhere' ELSE 'm' || ((p_partkey // 2) // 16) END AS module,
    'f_' || (p_partkey // 2) AS name, 'm' || ((p_partkey // 2) // 16) AS graph_module, p_partkey AS k
  FROM part WHERE p_partkey > 0 AND p_partkey // 16 <> (p_partkey // 2) // 16
  UNION ALL SELECT p_partkey // 16, 'util', 'missing_' || p_partkey, NULL, p_partkey FROM part WHERE p_size < 3)
"""


@analysis(
    "source_definitions",
    f"WITH {_DEFS} SELECT name, kind, module FROM d",
)
def _(spark, sf):
    defs = corpus(spark, sf).definitions().filter(F.col("kind") != "import")
    return defs.select("name", "kind", "module")


@analysis(
    "source_parameters",
    "SELECT 'f_' || p_partkey AS fn, 'x' AS name, CAST(0 AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS annotation FROM part "
    "UNION ALL SELECT 'f_' || p_partkey, 'n', 1, CASE WHEN p_partkey > 0 THEN 'int' END FROM part "
    "UNION ALL SELECT 'run', 'self', 0, NULL FROM part WHERE p_size = 10",
)
def _(spark, sf):
    c = corpus(spark, sf)
    owner = c.definitions().select("path", F.col("nid").alias("fn"), F.col("name").alias("owner"))
    return c.parameters().join(owner, ["path", "fn"]).select(
        F.col("owner").alias("fn"), F.col("shown").alias("name"),
        F.col("position").cast("bigint").alias("position"), "annotation",
    )


@analysis(
    "structural_claims",
    "SELECT p, n FROM (SELECT 'return-type' AS p, count(*) FILTER (p_partkey > 0) AS n FROM part "
    "UNION ALL SELECT 'has-base', count(*) FILTER (p_size = 10) FROM part "
    "UNION ALL SELECT 'has-method', count(*) FILTER (p_size = 10) FROM part "
    "UNION ALL SELECT 'has-param', 2 * count(*) + count(*) FILTER (p_size = 10) FROM part "
    "UNION ALL SELECT 'source-module', 2 * count(*) + 2 * count(*) FILTER (p_size = 10) + count(*) FILTER (p_size < 3) "
    "+ count(*) FILTER (p_partkey > 0 AND p_partkey // 16 <> (p_partkey // 2) // 16) FROM part "
    "UNION ALL SELECT 'has-arg', 2 * count(*) FILTER (p_partkey > 0) + count(*) FILTER (p_size = 10) FROM part) WHERE n > 0",
)
def _(spark, sf):
    claims = code_graph(spark, sf).claims
    counted = claims.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(
        F.col("p").isin("return-type", "has-base", "has-method", "has-param", "source-module", "has-arg")
    )


@analysis(
    "resolved_references",
    "SELECT 'x' AS name, 'parameter' AS how, count(*) AS n FROM part "
    "UNION ALL SELECT 'len', 'literal', 2 * count(*) FILTER (p_partkey > 0) FROM part "
    "UNION ALL SELECT 'self', 'parameter', count(*) FROM part WHERE p_size = 10 HAVING count(*) > 0 "
    "UNION ALL SELECT 'f_' || (p_partkey // 2), 'definition', 2 * count(*) + coalesce(2 * max(c.n), 0) FROM part "
    "LEFT JOIN (SELECT p_partkey AS k, count(*) AS n FROM part WHERE p_size = 10 GROUP BY 1) c ON c.k = p_partkey // 2 "
    "WHERE p_partkey > 0 GROUP BY p_partkey // 2 "
    "UNION ALL SELECT 'f_' || p_partkey, 'definition', 2 FROM part WHERE p_size = 10 AND p_partkey NOT IN "
    "(SELECT p_partkey // 2 FROM part WHERE p_partkey > 0)",
)
def _(spark, sf):
    found = corpus(spark, sf).resolved().filter(~F.col("name").rlike("^(LIST|ACTIVE|MAP|TERMINAL)_"))
    return found.groupBy("name", "how").agg(F.count(F.lit(1)).alias("n"))


@analysis(
    "tagged_modules",
    "SELECT DISTINCT 'src/m' || (p_partkey // 16) || '.py' AS path, 'm' || (p_partkey // 16) AS module FROM part",
)
def _(spark, sf):
    return tag_module(files(spark, sf))


@analysis(
    "contained_calls",
    "SELECT 'f_' || t.p_partkey AS name, 5 * count(s.p_partkey) + CASE WHEN any_value(t.p_size) = 10 THEN 4 ELSE 0 END AS expressions "
    "FROM part t LEFT JOIN part s ON s.p_partkey > 0 AND s.p_partkey // 2 = t.p_partkey GROUP BY t.p_partkey "
    "HAVING count(s.p_partkey) > 0 OR any_value(t.p_size) = 10",
)
def _(spark, sf):
    defs = symbols(code_graph(spark, sf)).filter("kind = 'function'")
    found = dependencies(spark, sf)["contains-call"]
    return found.join(defs.select(F.col("entity").alias("a1"), "name"), "a1").groupBy("name").agg(
        F.count(F.lit(1)).alias("expressions")
    )


@analysis("function_dependencies", f"WITH {_DEPENDS} SELECT src, dst FROM dep")
def named_dependencies(spark, sf):
    defs = symbols(code_graph(spark, sf)).select("entity", "name")
    edges = dependencies(spark, sf)["fn-depends-on"]
    return (
        edges.join(defs.select(F.col("entity").alias("a0"), F.col("name").alias("src")), "a0")
        .join(defs.select(F.col("entity").alias("a1"), F.col("name").alias("dst")), "a1")
        .select("src", "dst")
    )


@analysis(
    "function_references",
    f"SELECT 'f_' || p_partkey AS src, {_STEM} || '_' || p_partkey AS dst FROM part WHERE p_partkey > 0",
)
def _(spark, sf):
    defs = symbols(code_graph(spark, sf)).select("entity", "name")
    edges = dependencies(spark, sf)["fn-references"]
    return (
        edges.join(defs.select(F.col("entity").alias("a0"), F.col("name").alias("src")), "a0")
        .join(defs.select(F.col("entity").alias("a1"), F.col("name").alias("dst")), "a1")
        .select("src", "dst")
    )


@analysis(
    "dependents_of_symbols",
    f"WITH {_DEPENDS} SELECT dst AS symbol, count(DISTINCT src) AS dependents FROM dep GROUP BY dst",
)
def _(spark, sf):
    pairs = named_dependencies(spark, sf).distinct()
    return pairs.groupBy(F.col("dst").alias("symbol")).agg(F.count(F.lit(1)).alias("dependents"))


@analysis(
    "dependency_lists",
    f"WITH {_DEPENDS} SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM dep WHERE src <> 'run' GROUP BY src",
)
def _(spark, sf):
    return reports.small_adjacency(named_dependencies(spark, sf).filter("src <> 'run'"))


@analysis(
    "symbol_cards",
    f"WITH {_DEFS} SELECT name, kind, module, 'from ' || module || ' import ' || name AS import_line FROM d",
)
def _(spark, sf):
    found = symbols(code_graph(spark, sf)).filter(F.col("kind").isin("function", "variable", "class"))
    return found.select("name", "kind", "module", "import_line")


@analysis(
    "symbols_of_kind",
    f"WITH {_DEFS} SELECT module, name FROM d WHERE kind = 'class'",
)
def _(spark, sf):
    return discover(symbols(code_graph(spark, sf)), kind="class").select("module", "name")


_VALUES = f"""
v AS (
  SELECT {_STEM} || '_' || p_partkey AS name, p_type, CASE WHEN p_type = 'PROMO' THEN 'dict' ELSE 'list' END AS form,
    CASE WHEN p_type = 'SMALL' THEN p_brand WHEN p_brand < p_name THEN p_brand || '|' || p_name ELSE p_name || '|' || p_brand END AS vals
  FROM part)
"""


@analysis("variable_values", f"WITH {_VALUES} SELECT name, form, vals FROM v")
def variables(spark, sf):
    graph = code_graph(spark, sf)
    named = symbols(graph).filter("kind = 'variable'").select("entity", "name")
    found = variable_values(graph).join(named, "entity")
    return found.select("name", "form", F.array_join("values", "|").alias("vals"))


@analysis(
    "lifecycle_classes",
    f"WITH {_VALUES} SELECT name, CASE WHEN form = 'dict' THEN 'transitions' WHEN name LIKE 'ACTIVE%' THEN 'active' "
    "WHEN name LIKE 'TERMINAL%' THEN 'terminal' WHEN p_type <> 'SMALL' THEN 'status' END AS lifecycle FROM v",
)
def _(spark, sf):
    found = variables(spark, sf).withColumn("values", F.split("vals", r"\|"))
    return found.select(
        "name", checks.lifecycle_class(F.col("name"), F.col("values"), F.col("form")).alias("lifecycle")
    )


@analysis(
    "checked_references",
    f"WITH {_IMPORTS} SELECT 'src/m' || m || '.py' AS path, module, name, graph_module, CASE WHEN graph_module IS NULL THEN 'missing' "
    "WHEN graph_module <> module THEN 'module-mismatch' ELSE 'resolved' END AS status, graph_module IS NULL AS unused FROM im",
)
def references(spark, sf):
    c = corpus(spark, sf)
    parents = c.syntax.filter(F.col("type") == "ImportFrom").select(
        "path", F.col("nid").alias("parent"), F.col("name").alias("module")
    )
    imports = c.syntax.filter((F.col("type") == "alias") & (F.col("field") == "names")).select(
        "path", "parent", "name", F.col("note").alias("alias")
    ).join(parents, ["path", "parent"])
    table_of = c.definitions().filter(F.col("kind") != "import").groupBy("name").agg(
        F.max("module").alias("module")
    )
    return naming.check_references(imports, table_of, c.references().select("path", "name"))


def intents(spark, sf) -> DataFrame:
    """What each file imports is a need; what it defines is provided."""
    c = corpus(spark, sf)
    needs = c.syntax.filter((F.col("type") == "alias") & (F.col("field") == "names")).select(
        F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("module"), F.lit("depends-on").alias("kind"), "name"
    )
    gives = c.definitions().filter(F.col("kind") != "import").select("module", F.lit("provides").alias("kind"), "name")
    return needs.unionByName(gives)


@analysis(
    "unmet_needs",
    f"WITH {_IMPORTS} SELECT DISTINCT 'm' || m AS module, name FROM im WHERE graph_module IS NULL",
)
def _(spark, sf):
    return checks.unmet_needs(intents(spark, sf))


# (domain, severity, keywords, required evidence)
MODULE_RULES = (
    ("terminal handling", "critical", ("active",), ("terminal",)),
    ("transitions known", "warning", ("terminal",), ("map_",)),
    ("class use", "warning", ("run",), ("missing_",)),
)


@analysis(
    "module_obligations",
    "WITH m AS (SELECT 'm' || (p_partkey // 16) AS module, bool_or(p_type = 'ECONOMY') AS act, bool_or(p_type = 'STANDARD') AS term, "
    "bool_or(p_type = 'PROMO') AS map, bool_or(p_size = 10) AS run, bool_or(p_size < 3) AS miss FROM part GROUP BY 1) "
    "SELECT module, 'terminal handling' AS domain, 'critical' AS severity FROM m WHERE act AND NOT term "
    "UNION ALL SELECT module, 'transitions known', 'warning' FROM m WHERE term AND NOT map "
    "UNION ALL SELECT module, 'class use', 'warning' FROM m WHERE run AND NOT miss",
)
def _(spark, sf):
    facts = intents(spark, sf).select("module", F.lower("name").alias("fact"))
    return checks.evidence_obligations(facts, MODULE_RULES)


@analysis(
    "hardcoded_literals",
    "SELECT DISTINCT 'm' || (p_partkey // 16) AS module, p_brand AS literal FROM part WHERE p_brand IN "
    "(SELECT 'Brand#' || n_nationkey FROM nation WHERE n_regionkey = 1)",
)
def _(spark, sf):
    c = corpus(spark, sf)
    literals = c.syntax.filter((F.col("type") == "Constant") & (F.col("lit_type") == "s")).select(
        F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("module"), F.col("lit").alias("literal")
    )
    known = table(spark, sf, "nation").filter("n_regionkey = 1").select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("name")
    )
    return checks.hardcoded(literals, known)


@analysis(
    "table_function",
    "SELECT count(DISTINCT p_partkey // 16) AS files, CAST(0 AS BIGINT) AS errors FROM part",
)
def _(spark, sf):
    # Source rows in, many syntax rows out.
    rows = parse_files(files(spark, sf))
    assert [f.name for f in rows.schema.fields] == [c.split()[0] for c in SYNTAX.split(", ")]
    modules = rows.filter(F.col("type").isin("Module", "error"))
    return modules.agg(
        F.sum((F.col("type") == "Module").cast("bigint")).alias("files"),
        F.sum((F.col("type") == "error").cast("bigint")).alias("errors"),
    )




@analysis(
    "source_added_to_graph",
    "SELECT 'n_' || n_nationkey AS src, 'f_' || p_partkey AS dst FROM nation JOIN part ON n_nationkey = p_partkey",
)
def _(spark, sf):
    # New files, one per nation, call functions that are in the graph already.
    graph = code_graph(spark, sf)
    key = F.col("n_nationkey").cast("string")
    new_files = table(spark, sf, "nation").select(
        F.concat(F.lit("src/nation"), key, F.lit(".py")).alias("path"),
        F.concat(F.lit("def n_"), key, F.lit("(x):\n    return f_"), key, F.lit("(x)\n")).alias("source"),
    )
    space = Workspace(spark)
    added = Corpus(space.save(parse_files(new_files), "syntax").df())
    claims = added.claims(tx_seq=2, existing=symbols(graph))
    calls = claims.filter(F.col("p") == "calls").select("l", F.col("r").alias("entity"))
    owners = added.definitions().select("path", F.col("name").alias("src"))
    from_path = F.regexp_extract("l", r"^e:py/(.*)#", 1)
    named = symbols(graph).select("entity", F.col("name").alias("dst"))
    return (
        calls.withColumn("path", from_path)
        .join(owners, "path")
        .join(named, "entity")
        .select("src", "dst")
        .distinct()
    )

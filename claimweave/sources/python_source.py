"""Python source files as structural claims.

A small per-file helper lists the syntax nodes with Python's own parser; everything else
(claims, parameters, name resolution, dependencies) is joins over that node table.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ids import double_text, long_text, value_id
from claimweave.functions.skew import spread

SYNTAX = (
    "path string, nid int, parent int, field string, pos int, type string, name string, "
    "note string, lit_type string, lit string, fn int, owner string, above int, parent_type string, "
    "above_type string, above_field string, error string"
)
# The helper travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Nodes that a task lists before it hands them on.
ROWS_PER_FRAME = 10_000

# Syntax that carries no claim of its own; its children hang below the nearest real node.
_HELPERS = ("Module", "arguments", "arg", "alias", "keyword", "Expr", "error", "comprehension")
# Kept as text only: what hangs below these fields becomes no claim.
_TEXT_FIELDS = ("decorator_list", "bases", "returns", "annotation", "defaults", "kw_defaults")
_NAME = ("name", "id", "attr", "arg", "module")


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _literal(node: ast.AST) -> tuple[str | None, str | None]:
    value = getattr(node, "value", None)
    if not isinstance(node, ast.Constant):
        return None, None
    if isinstance(value, bool):
        return "b", "true" if value else "false"
    if value is None:
        return "n", "null"
    if isinstance(value, float):
        return "d", double_text(value)
    return "i" if isinstance(value, int) else "s", str(value)


def _row(path, nid, parent, field, pos, node, fn, owner, above, around) -> tuple:
    name = next((getattr(node, k) for k in _NAME if isinstance(getattr(node, k, None), str)), None)
    note = None
    if isinstance(node, ast.Call):
        name = _text(node.func)
    elif isinstance(node, ast.arg):
        note = _text(node.annotation)
    elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        note = _text(node.returns)
    elif isinstance(node, ast.AnnAssign):
        name, note = _text(node.target), _text(node.annotation)
    elif isinstance(node, ast.Assign):
        name = _text(node.targets[0])
    elif isinstance(node, (ast.BinOp, ast.BoolOp, ast.UnaryOp)):
        note = type(node.op).__name__
    elif isinstance(node, ast.alias):
        note = node.asname or node.name
    if field in ("decorator_list", "bases", "defaults"):
        note = _text(node)
    return (path, nid, parent, field, pos, type(node).__name__, name, note, *_literal(node), fn, owner, above, *around, None)


def syntax_rows(path: str, source: str) -> list[tuple]:
    """All nodes of one file in preorder, each with its parent, field and enclosing function."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as error:
        return [(path, 0, None, None, None, "error", *[None] * 10, str(error))]
    rows: list[tuple] = []
    # (node, parent id, field, position, enclosing function id, owner: module, class or
    # function, nearest ancestor that is not helper syntax; types of parent and that ancestor,
    # and its field)
    stack = [(tree, None, None, None, None, None, None, (None, None, None))]
    while stack:
        node, parent, field, pos, fn, owner, above, around = stack.pop()
        nid, shape = len(rows), type(node).__name__
        rows.append(_row(path, nid, parent, field, pos, node, fn, owner, above, around))
        inside, kind = fn, owner
        real, over = (above, around[1:]) if shape in _HELPERS else (nid, (shape, field))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inside, kind = nid, "function"
        elif isinstance(node, ast.ClassDef):
            kind = "class" if owner == "module" else owner
        elif isinstance(node, ast.Module):
            kind = "module"
        children = []
        for name, value in ast.iter_fields(node):
            if isinstance(value, ast.AST):
                value = [value]
            if isinstance(value, list) and field not in _TEXT_FIELDS:
                items = [v for v in value if isinstance(v, ast.AST)]
                items = [v for v in items if not isinstance(v, (ast.expr_context, ast.operator, ast.cmpop))]
                children.extend((c, nid, name, i, inside, kind, real, (shape, *over)) for i, c in enumerate(items))
        stack.extend(reversed(children))
    return rows


def syntax_frames(files: Iterable[tuple[str, str]], most: int = ROWS_PER_FRAME) -> Iterator[pd.DataFrame]:
    """Syntax rows of many files in frames of ``most`` rows and the rest of one file.

    A batch holds thousands of files, each with hundreds of nodes: a worker keeps one frame
    of them at a time.
    """
    columns = [c.split()[0] for c in SYNTAX.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        for c in ("nid", "parent", "pos", "fn", "above"):
            out[c] = out[c].astype("Int32")
        return out

    rows: list[tuple] = []
    for path, source in files:
        rows.extend(syntax_rows(path, source))
        if len(rows) >= most:
            yield frame(rows)
            rows = []
    if rows:
        yield frame(rows)


def parse_files(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """``files(path, source)`` to syntax rows; a file that does not parse yields its error.

    Parsing costs far more than moving the text, so files are spread over
    ``partitions`` tasks, three per core unless given.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from syntax_frames(zip(batch["path"], batch["source"]))

    width = partitions or 3 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "source").repartition(width, "path").mapInPandas(extract, SYNTAX)


# -- structural claims ---------------------------------------------------------

# Node types to the kind of form or expression they are recorded as.
FORMS = {
    "FunctionDef": "function",
    "AsyncFunctionDef": "function",
    "ClassDef": "class",
    "Assign": "variable",
    "AnnAssign": "variable",
    "Import": "import",
    "ImportFrom": "import",
}
EXPRESSIONS = {
    "Call": "call",
    "Name": "name-ref",
    "Attribute": "attribute",
    "Return": "return",
    "If": "if",
    "For": "for",
    "While": "while",
    "With": "with",
    "Try": "try",
    "Assign": "assign",
    "AnnAssign": "ann_assign",
    "Compare": "compare",
    "UnaryOp": "unaryop",
    "IfExp": "ifexp",
    "Lambda": "lambda",
    "List": "list",
    "Set": "set",
    "Tuple": "tuple",
    "Dict": "dict",
    "Subscript": "subscript",
    "JoinedStr": "fstring",
    "Import": "import",
    "ImportFrom": "import",
    "Match": "match",
}


def _mapped(column: Column, table: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for key, value in table.items():
        result = F.when(column == key, value).otherwise(result)
    return result


def node_id(path: Column, nid: Column) -> Column:
    return F.concat(F.lit("e:py/"), path, F.lit("#"), nid.cast("string"))


def module_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.py)?$", 1)


def _shown_name() -> Column:
    starred = F.when(F.col("field") == "vararg", F.concat(F.lit("*"), "name")).when(
        F.col("field") == "kwarg", F.concat(F.lit("**"), "name")
    )
    return F.coalesce(starred, "name")


class Corpus:
    """Node tables of a parsed corpus; build it from written syntax rows."""

    def __init__(self, syntax: DataFrame):
        self.syntax = syntax.filter(F.col("type") != "error")
        self.errors = syntax.filter(F.col("type") == "error").select("path", "error")

    def top(self) -> Column:
        """Definitions: anything directly in a module, and methods of its classes."""
        functions = F.col("type").isin("FunctionDef", "AsyncFunctionDef")
        return (F.col("field") == "body") & (
            (F.col("owner") == "module") | ((F.col("owner") == "class") & functions)
        )

    def _aside(self) -> Column:
        """Text-only fields and assignment targets."""
        return F.col("field").isin(*_TEXT_FIELDS, "targets", "target")

    def definitions(self) -> DataFrame:
        """``entity, path, module, name, kind`` of top-level functions, classes, variables, imports."""
        kind = _mapped(F.col("type"), FORMS)
        return self.syntax.filter(self.top() & kind.isNotNull()).select(
            node_id(F.col("path"), F.col("nid")).alias("entity"), "path", "nid",
            module_of(F.col("path")).alias("module"), "name", kind.alias("kind"), "type", "note",
        )

    def _parameter(self) -> Column:
        return (F.col("type") == "arg") & F.col("fn").isNotNull()

    def _starred(self) -> DataFrame:
        """``path, nid, fn, place`` of ``*`` and ``**`` parameters, which come after all plain ones."""
        params = self.syntax.filter(self._parameter())
        plain = F.sum(F.when(F.col("field").isin("posonlyargs", "args", "kwonlyargs"), 1).otherwise(0))
        starred = params.filter(F.col("field").isin("vararg", "kwarg")).select("path", "nid", "fn", "field")
        sizes = params.join(starred.select("path", "fn").distinct(), ["path", "fn"], "left_semi").groupBy("path", "fn").agg(
            plain.cast("int").alias("_plain")
        )
        place = F.col("_plain") + F.when(F.col("field") == "kwarg", 1).otherwise(0)
        return starred.join(sizes, ["path", "fn"]).select("path", "nid", "fn", place.alias("place"))

    def parameters(self) -> DataFrame:
        """``path, fn, name, position, entity, annotation`` of every function parameter."""
        params = self.syntax.filter(self._parameter())
        starred = F.col("field").isin("vararg", "kwarg")
        placed = params.filter(starred).join(self._starred(), ["path", "nid", "fn"])
        return params.filter(~starred).withColumn("place", F.col("pos")).unionByName(placed).select(
            "path", "fn", "name", _shown_name().alias("shown"),
            F.col("place").alias("position"), node_id(F.col("path"), F.col("nid")).alias("entity"),
            F.col("note").alias("annotation"),
        )

    def references(self) -> DataFrame:
        """Names that calls, names and attributes mention, unresolved: ``entity, path, fn, name``."""
        loads = F.col("type").isin("Call", "Name", "Attribute") & ~self._aside()
        return self.syntax.filter(loads & F.col("name").isNotNull()).select(
            node_id(F.col("path"), F.col("nid")).alias("entity"), "path", "fn", "name", "type",
        )

    def resolved(self, existing: DataFrame | None = None) -> DataFrame:
        """Each reference with its target: parameter in scope, else the newest definition of
        that name in the corpus, else one of ``existing(name, entity)``, else the name as a
        literal.  Equi joins with one row per name on the right."""
        scope = self.syntax.filter(self._parameter()).select(
            "path", "fn", "name", node_id(F.col("path"), F.col("nid")).alias("_param")
        )
        defined = (
            self.definitions()
            .filter(F.col("kind") != "import")
            .groupBy("name")
            .agg(F.max("entity").alias("_global"))
        )
        if existing is not None:
            before = existing.groupBy("name").agg(F.max("entity").alias("_before"))
            defined = defined.join(before, "name", "full").select(
                "name", F.coalesce("_global", "_before").alias("_global")
            )
        return (
            self.references()
            .join(scope, ["path", "fn", "name"], "left")
            # names of parameters, which very many functions share, need no definition
            .withColumn("_key", F.when(F.col("_param").isNull(), F.col("name")).otherwise(spread(["entity"])))
            .join(defined.withColumnRenamed("name", "_key"), "_key", "left")
            .select(
                "entity", "path", "fn", "name", "type",
                F.coalesce("_param", "_global", value_id("s", F.col("name"))).alias("target"),
                F.when(F.col("_param").isNotNull(), "parameter")
                .when(F.col("_global").isNotNull(), "definition")
                .otherwise("literal")
                .alias("how"),
            )
        )

    def _child_link(self) -> tuple[Column, Column]:
        """Whether a node hangs below an expression, helper nodes skipped, and its id there: constants are values."""
        hangs = ~F.col("type").isin(*_HELPERS) & F.col("above").isNotNull() & ~self._aside()
        child = F.when(
            F.col("type") == "Constant", value_id(F.col("lit_type"), F.col("lit"))
        ).otherwise(node_id(F.col("path"), F.col("nid")))
        return hangs, child

    def child_links(self) -> DataFrame:
        """``(src, dst)``: expression children, helper nodes skipped, constants as values (long ones with their text)."""
        hangs, child = self._child_link()
        return self.syntax.filter(hangs).select(
            node_id(F.col("path"), F.col("above")).alias("src"), child.alias("dst"), "path", "nid",
            "field", "pos", long_text(child, F.col("lit")).alias("dst_text"),
        )

    def claims(self, tx_seq: int = 1, existing: DataFrame | None = None) -> DataFrame:
        """All structural claims of the corpus; names may resolve to ``existing`` entities.

        A node knows the types around it, so only the targets of names and the positions of
        starred parameters need joins.
        """
        path, nid, kind = F.col("path"), F.col("nid"), F.col("type")
        me, parent = node_id(path, nid), node_id(path, F.col("parent"))
        names_functions = ("FunctionDef", "AsyncFunctionDef")
        functions, top, param = kind.isin(*names_functions), self.top(), self._parameter()

        def link(when: Column, l: Column, p: str | Column, r: Column, text: Column | None = None) -> Column:
            text = F.lit(None).cast("string") if text is None else text
            return F.when(when, F.struct(l.alias("l"), (F.lit(p) if isinstance(p, str) else p).alias("p"), r.alias("r"), text.alias("lit")))

        def literal(when: Column, l: Column, p: str | Column, text: Column, lit_type: str = "s") -> Column:
            text = text.cast("string")
            value = value_id(lit_type, text)
            return link(when, l, p, value, long_text(value, text))

        def each(df: DataFrame, *claims: Column) -> DataFrame:
            return df.select(F.explode(F.array(*claims)).alias("c")).filter(F.col("c").isNotNull()).select("c.*")

        form = _mapped(kind, FORMS)
        defs = top & form.isNotNull()
        body = F.concat(me, F.lit("/body"))
        expr_kind = F.when(
            kind.isin("BinOp", "BoolOp"),
            F.concat(F.lower("type"), F.lit(":"), "note"),
        ).otherwise(_mapped(kind, EXPRESSIONS))
        inner = expr_kind.isNotNull() & ~top & ~functions & ~self._aside()
        hangs, child = self._child_link()
        child_text, over = long_text(child, F.col("lit")), node_id(path, F.col("above"))
        of_function = F.coalesce(F.col("above_type").isin(*names_functions) & (F.col("field") == "body"), F.lit(False))
        # a node directly in an assignment has the owner of that assignment
        of_variable = F.col("above_type").isin("Assign", "AnnAssign") & (F.col("above_field") == "body") & (F.col("owner") == "module")
        starred = F.col("field").isin("vararg", "kwarg")
        syntax, always = self.syntax, F.lit(True)
        takes = (F.col("field") == "args") & (kind != "arg") & (F.col("parent_type") == "Call")
        alias = (kind == "alias") & (F.col("field") == "names")
        typed = (kind == "AnnAssign") & top
        texts = F.col("field").isin("decorator_list", "bases")
        # one family of nodes a scan: the code of each stays small enough to be compiled
        parts = [
            each(
                syntax.filter(defs),
                literal(always, me, "form-kind", form),
                literal(F.col("name").isNotNull(), me, "name", F.col("name")),
                literal(always, me, "source-module", module_of(path)),
            ),
            each(
                syntax.filter(functions),
                literal(kind == "AsyncFunctionDef", me, "is-async", F.lit("true"), "b"),
                literal(F.col("note").isNotNull(), me, "return-type", F.col("note")),
                link(always, me, "body", body),
                literal(always, body, "expr-kind", F.lit("block")),
                link((F.col("owner") == "class") & (F.col("field") == "body"), parent, "has-method", me),
            ),
            each(
                syntax.filter(param),
                literal(always, me, "name", _shown_name()),
                literal(~starred, me, "position", F.col("pos"), "i"),
                literal(F.col("note").isNotNull(), me, "has-type", F.col("note")),
                link(always, node_id(path, F.col("fn")), "has-param", me),
            ),
            each(
                syntax.filter(hangs),
                link(always, F.when(of_function, F.concat(over, F.lit("/body"))).otherwise(over), "has-child", child, child_text),
                literal(of_function, child, "position", F.col("pos"), "i"),
                link(of_variable & (F.col("field") == "value"), over, "body", child, child_text),
            ),
            each(syntax.filter(inner), literal(always, me, "expr-kind", expr_kind)),
            each(
                syntax.filter(takes | alias | typed | texts),
                link(takes, parent, "has-arg", me),
                literal(alias, parent, "has-child", F.col("name")),
                literal(typed, me, "has-type", F.col("note")),
                literal(
                    texts, parent, F.when(F.col("field") == "bases", "has-base").otherwise("has-decorator"), F.col("note")
                ),
            ),
            each(self._starred(), literal(always, me, "position", F.col("place"), "i")),
            each(
                self.resolved(existing),
                link(always, F.col("entity"), "calls", F.col("target"), long_text(F.col("target"), F.col("name"))),
            ),
        ]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        merged = merged.distinct()
        digest = F.sha2(F.concat_ws("\u001f", "l", "p", "r"), 256)
        return merged.select(
            F.concat(F.lit("c:py/"), F.substring(digest, 1, 24)).alias("cid"), "l", "p", "r",
            F.lit(f"t:{tx_seq}").alias("tx_id"), F.lit(tx_seq).cast("bigint").alias("tx_seq"),
            F.xxhash64("l", "p", "r").alias("ord"), "lit",
        )


def tag_module(files: DataFrame) -> DataFrame:
    """``(path, module)`` of each file."""
    return files.select("path", module_of(F.col("path")).alias("module")).distinct()

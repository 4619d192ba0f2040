"""Cross-field rules, compiled on the driver to Columns.

An expression becomes a pair of Columns, its value and whether it is
indeterminate; names resolve when compiled, a name outside the page type's scope
being indeterminate.  `and` and `or` look at all operands, so one indeterminate
operand makes them so; the conditional is lazy; `<` and the like, arithmetic and
`in` are indeterminate on null, `==` is not.  A rule fails when it is determinate
and not true.

Differences from an interpreter: minus signs before names and operators other
than + - * / are refused when compiled, and a division by zero or len() of null
is reported as `error` for the row.
"""

from __future__ import annotations

import ast
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Schema

NUMERIC = {"integer", "float"}
LISTS = {"table", "checkbox_group"}


class RuleError(ValueError):
    pass


class Node(NamedTuple):
    value: Column
    unknown: Column
    kind: str  # number, text, boolean, list, null
    error: Column




def names_in(expr: str) -> set[str]:
    """Names of a rule, without called functions."""
    tree = ast.parse(expr, mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called


def _truth(n: Node) -> Column:
    if n.kind == "list":
        return F.coalesce(F.size(n.value) > 0, F.lit(False))
    if n.kind == "text":
        return F.coalesce(F.length(n.value) > 0, F.lit(False))
    if n.kind == "number":
        return F.coalesce(n.value != 0, F.lit(False))
    if n.kind == "null":
        return F.lit(False)
    return F.coalesce(n.value, F.lit(False))


def _null(n: Node) -> Column:
    """Null for want of a value, not for an error."""
    return n.value.isNull() & ~n.error


class Compiler:
    def __init__(self, scope: dict[str, tuple[Column, str]]):
        self.scope = scope

    def __call__(self, node: ast.AST) -> Node:
        make = getattr(self, f"on_{type(node).__name__}", None)
        if make is None:
            raise RuleError(f"rule uses disallowed syntax: {type(node).__name__}")
        return make(node)

    def on_Expression(self, node):
        return self(node.body)

    def on_Constant(self, node):
        x = node.value
        kind = "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "text"
        return Node(F.lit(x), F.lit(False), kind, F.lit(False))

    def on_Name(self, node):
        if node.id not in self.scope:
            return Node(F.lit(None), F.lit(True), "null", F.lit(False))
        value, kind = self.scope[node.id]
        return Node(value, F.lit(False), kind, F.lit(False))

    def on_List(self, node):
        items = [self(e) for e in node.elts]
        value = F.array(*[i.value for i in items])  # empty: array<void>, which takes any element type
        return Node(value, self._any([i.unknown for i in items]), "list", self._any([i.error for i in items]))

    on_Tuple = on_List

    def on_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.func.id != "len" or len(node.args) != 1 or node.keywords:
            raise RuleError("rule may only call len()")
        arg = self(node.args[0])
        size = F.length(arg.value) if arg.kind == "text" else F.lit(None).cast("int") if arg.kind == "null" else F.when(arg.value.isNotNull(), F.size(arg.value))
        return Node(size, arg.unknown, "number", arg.error | (~arg.unknown & size.isNull()))

    @staticmethod
    def _any(flags: list[Column]) -> Column:
        out = F.lit(False)
        for f in flags:
            out = out | f
        return out

    def on_BoolOp(self, node):
        items = [self(v) for v in node.values]
        out = items[0]
        for nxt in items[1:]:
            keep = ~_truth(out) if isinstance(node.op, ast.And) else _truth(out)
            out = self._choose(keep, out, nxt)
        return out._replace(unknown=self._any([i.unknown for i in items]), error=self._any([i.error for i in items]))

    @staticmethod
    def _choose(cond: Column, a: Node, b: Node) -> Node:
        """Value of a where cond, else of b; of unlike kinds only truth counts."""
        if a.kind == b.kind or "null" in (a.kind, b.kind):
            kind = b.kind if a.kind == "null" else a.kind
            return Node(F.when(cond, a.value).otherwise(b.value), F.lit(False), kind, F.lit(False))
        return Node(F.when(cond, _truth(a)).otherwise(_truth(b)), F.lit(False), "boolean", F.lit(False))

    def on_UnaryOp(self, node):
        if isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, (int, float)):
            return self.on_Constant(ast.Constant(-node.operand.value))
        if not isinstance(node.op, ast.Not):
            raise RuleError(f"rule uses disallowed operator: {type(node.op).__name__}")
        arg = self(node.operand)
        return Node(~_truth(arg), arg.unknown, "boolean", arg.error)

    def on_IfExp(self, node):
        test, a, b = self(node.test), self(node.body), self(node.orelse)
        cond = _truth(test)
        out = self._choose(cond, a, b)
        pick = lambda x, y: F.when(cond, x).otherwise(y)
        return out._replace(unknown=test.unknown | pick(a.unknown, b.unknown), error=test.error | pick(a.error, b.error))

    def on_BinOp(self, node):
        ops = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}
        if type(node.op) not in ops:
            raise RuleError(f"rule uses disallowed operator: {type(node.op).__name__}")
        a, b = self(node.left), self(node.right)
        unknown = a.unknown | b.unknown | _null(a) | _null(b)
        error = a.error | b.error
        if isinstance(node.op, ast.Div):
            error = error | (~unknown & (b.value == 0))
        if a.kind == b.kind == "text" and isinstance(node.op, ast.Add):
            return Node(F.concat(a.value, b.value), unknown, "text", error)
        return Node(ops[type(node.op)](a.value, b.value), unknown, "number", error)

    def on_Compare(self, node):
        left, ok, unknown, error = self(node.left), F.lit(True), F.lit(False), F.lit(False)
        for op, right_node in zip(node.ops, node.comparators):
            right = self(right_node)
            link, null = self._link(op, left, right)
            # A link after a false one is not looked at; its operands' unknowns too.
            unknown = unknown | (ok & (left.unknown | right.unknown | null))
            error = error | (ok & (left.error | right.error))
            ok = ok & F.coalesce(link, F.lit(False))
            left = right
        return Node(ok, F.coalesce(unknown, F.lit(False)), "boolean", F.coalesce(error, F.lit(False)))

    @staticmethod
    def _link(op, a: Node, b: Node) -> tuple[Column, Column]:
        def equal():
            if a.kind == b.kind:
                return a.value.eqNullSafe(b.value)
            if "null" in (a.kind, b.kind):
                return a.value.isNull() & b.value.isNull()
            if {a.kind, b.kind} == {"number", "boolean"}:
                return a.value.cast("double").eqNullSafe(b.value.cast("double"))
            return a.value.isNull() & b.value.isNull()

        if isinstance(op, (ast.Eq, ast.Is)):
            return equal(), F.lit(False)
        if isinstance(op, (ast.NotEq, ast.IsNot)):
            return ~equal(), F.lit(False)
        if isinstance(op, (ast.In, ast.NotIn)):
            if b.kind == "text":
                inside = F.contains(b.value, a.value)
            else:
                inside = F.exists(b.value, lambda x: x.eqNullSafe(a.value)) if b.kind == "list" else F.lit(False)
            return (inside if isinstance(op, ast.In) else ~inside), _null(b)
        tests = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}
        return tests[type(op)](a.value, b.value), _null(a) | _null(b)


def kind_of(field_type: str) -> str:
    return "number" if field_type in NUMERIC else "boolean" if field_type == "boolean" else "list" if field_type in LISTS else "text"


def compile_rule(expr: str, scope: dict[str, tuple[Column, str]]) -> Column:
    """struct(failed, error) of a rule over columns in scope."""
    node = Compiler(scope)(ast.parse(expr, mode="eval"))
    unknown = F.coalesce(node.unknown, F.lit(False))
    error = F.coalesce(node.error, F.lit(False)) & ~unknown
    return F.struct((~unknown & ~error & ~_truth(node)).alias("failed"), error.alias("error"))


def failed_rules(records: DataFrame, schema: Schema, page_type: str | None, columns: dict[str, Column] | None = None) -> DataFrame:
    """`records` (one row for each page of the type, a column for each field) with
    failed_rules, array of (rule, message, names), and rule_error."""
    columns = columns or {f.name: F.col(f.name) for f in schema.fields}
    scope = {f.name: (columns[f.name], kind_of(f.type)) for f in schema.fields_for(page_type) if f.name in columns}
    out, errors = [], F.lit(False)
    for r in schema.rules:
        got = compile_rule(r.rule, scope)
        names = sorted(names_in(r.rule) & set(scope))
        info = F.struct(F.lit(r.rule).alias("rule"), F.lit(f"cross-field rule failed: {r.message or r.rule}").alias("message"), F.array(*map(F.lit, names)).cast("array<string>").alias("names"))
        out.append(F.when(got["failed"], info))
        errors = errors | got["error"]
    kind = "array<struct<rule:string,message:string,names:array<string>>>"
    return records.withColumn("failed_rules", F.array_compact(F.array(*out)).cast(kind) if out else F.array().cast(kind)).withColumn("rule_error", errors)


def flag_from_rules(extractions: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Extractions flagged by failed rules.  `failures` has `keys` and
    failed_rules; reasons are added to those there, in the order of the rules.
    It is computed from the reasons before rules, so a second run adds nothing."""
    each = failures.select(*keys, F.posexplode("failed_rules").alias("pos", "f"))
    each = each.select(*keys, "pos", F.explode("f.names").alias("field_name"), F.col("f.message").alias("message"))
    told = each.groupBy(*keys, "field_name").agg(F.array_sort(F.collect_list(F.struct("pos", "message")))["message"].alias("rule_reasons"))
    rows = extractions.join(told, [*keys, "field_name"], "left")
    reason = F.when(F.col("rule_reasons").isNotNull(), F.concat_ws("; ", "flag_reason", F.array_join("rule_reasons", "; "))).otherwise(F.col("flag_reason"))
    return rows.withColumn("flag_reason", reason).withColumn("flagged", F.col("flagged") | F.col("rule_reasons").isNotNull()).drop("rule_reasons")

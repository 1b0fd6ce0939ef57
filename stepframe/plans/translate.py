"""Plain Python bodies as column expressions, by their syntax trees.

``if`` and ``else``, local names, arithmetic, comparisons, ``and``/``or``/``not``, ``max``, ``min`` and ``abs`` of values, attributes
of the instance and numbers of the module become one expression for each output; ``sum``, ``max``, ``min`` and ``len`` of
``x.values()`` become aggregates. Anything else raises ``Untranslatable``, and the body runs as Python. As there, a row with a null
argument gets null; a division by zero gives null instead of an error.
"""

from __future__ import annotations

import ast
import functools
import inspect
import operator
import textwrap
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Untranslatable(ValueError):
    """The body needs Python."""


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: lambda a, b: F.pow(_column(a), _column(b))}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_AGGREGATE = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "max": F.max, "min": F.min, "len": lambda c: F.count(F.lit(1)).cast("double")}


def _column(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise Untranslatable(repr(x))
    return F.lit(float(x))


@functools.lru_cache(maxsize=1024)
def _tree(function: Callable) -> ast.FunctionDef:
    try:
        node = ast.parse(textwrap.dedent(inspect.getsource(function))).body[0]
    except (OSError, TypeError, SyntaxError) as e:
        raise Untranslatable(str(e)) from e
    if not isinstance(node, ast.FunctionDef):
        raise Untranslatable(type(node).__name__)
    return node


def output_names(function: Callable) -> list[str]:
    """The names in the tuples ``value, name, value, name, value ...`` that a body returns; they must agree."""
    found = {
        tuple(e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None for e in r.value.elts[1::2])
        for r in ast.walk(_tree(function)) if isinstance(r, ast.Return) and isinstance(r.value, ast.Tuple)
    }
    if len(found) != 1 or None in (names := next(iter(found))):
        raise TypeError(f"{function.__name__} must return tuples with the same names everywhere")
    return list(names)


class _Body:
    def __init__(self, function: Callable, instance, columns: dict[str, Column]):
        self.outer, self.instance, self.columns = inspect.getclosurevars(function), instance, columns
        self.own = next(iter(inspect.signature(function).parameters))

    def run(self, body: list[ast.stmt], held: dict) -> list:
        """What the statements return: the value, or the values and names of a tuple."""
        for k, s in enumerate(body):
            if isinstance(s, ast.Return) and s.value is not None:
                return [self.value(e, held) for e in (s.value.elts if isinstance(s.value, ast.Tuple) else [s.value])]
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                held = {**held, s.targets[0].id: self.value(s.value, held)}
            elif isinstance(s, ast.If):
                test = self.value(s.test, held)
                if not isinstance(test, Column):
                    return self.run([*(s.body if test else s.orelse), *body[k + 1 :]], held)
                yes, no = self.run([*s.body, *body[k + 1 :]], held), self.run([*s.orelse, *body[k + 1 :]], held)
                if len(yes) != len(no):
                    raise Untranslatable("outputs differ")
                return [a if isinstance(a, str) and a == b else F.when(test, _column(a)).otherwise(_column(b)) for a, b in zip(yes, no, strict=True)]
            elif not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)):
                raise Untranslatable(type(s).__name__)
        raise Untranslatable("no value")

    def value(self, e: ast.expr, held: dict):
        v = functools.partial(self.value, held=held)
        if isinstance(e, ast.Constant) and isinstance(e.value, (int, float, str)):
            return e.value
        if isinstance(e, ast.Name):
            for names in (held, self.columns, self.outer.nonlocals, self.outer.globals):
                if e.id in names and isinstance(names[e.id], (Column, int, float)):
                    return names[e.id]
            raise Untranslatable(e.id)
        if isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name) and e.value.id == self.own:
            found = getattr(self.instance, e.attr, None)
            if isinstance(found, (int, float)):
                return found
            raise Untranslatable(e.attr)
        if isinstance(e, ast.BinOp) and type(e.op) in _BINARY:
            a, b = v(e.left), v(e.right)
            if isinstance(a, Column) or isinstance(b, Column):
                return _BINARY[type(e.op)](_column(a), _column(b))
            return a**b if isinstance(e.op, ast.Pow) else _BINARY[type(e.op)](a, b)
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, (ast.USub, ast.UAdd)):
            a = v(e.operand)
            return -a if isinstance(e.op, ast.USub) else a
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
            a = v(e.operand)
            return ~a if isinstance(a, Column) else not a
        if isinstance(e, ast.Compare) and all(type(o) in _COMPARE for o in e.ops):
            sides = [v(x) for x in (e.left, *e.comparators)]
            return functools.reduce(operator.and_, [_COMPARE[type(o)](a, b) for o, a, b in zip(e.ops, sides, sides[1:], strict=False)])
        if isinstance(e, ast.BoolOp) and all(isinstance(x, ast.Compare) or isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not) or isinstance(x, ast.BoolOp) for x in e.values):
            return functools.reduce(operator.and_ if isinstance(e.op, ast.And) else operator.or_, [v(x) for x in e.values])
        if isinstance(e, ast.IfExp):
            test = v(e.test)
            if not isinstance(test, Column):
                return v(e.body if test else e.orelse)
            return F.when(test, _column(v(e.body))).otherwise(_column(v(e.orelse)))
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and not e.keywords:
            return self.call(e.func.id, e.args, v)
        raise Untranslatable(type(e).__name__)

    def call(self, name: str, args: list[ast.expr], v: Callable):
        if name in _AGGREGATE and len(args) == 1 and isinstance(args[0], ast.Call) and isinstance(args[0].func, ast.Attribute) and args[0].func.attr == "values" and not args[0].args:
            return _AGGREGATE[name](v(args[0].func.value))
        if name in ("max", "min") and len(args) > 1:
            found = [_column(v(a)) for a in args]
            keep = operator.gt if name == "max" else operator.lt  # the first of equals stays, as in Python
            return functools.reduce(lambda a, b: F.when(keep(b, a), b).otherwise(a), found)
        if name == "abs" and len(args) == 1:
            return F.abs(_column(v(args[0])))
        if name == "float" and len(args) == 1:
            return _column(v(args[0]))
        raise Untranslatable(name)


def translated(function: Callable, instance, columns: dict[str, Column]) -> list:
    """The value that a body returns (or values and names in turn), as columns."""
    return [x if isinstance(x, str) else _column(x) for x in _Body(function, instance, columns).run(_tree(function).body, {})]

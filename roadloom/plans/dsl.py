"""Profile scripts: prefix-notation cost rules compiled to column expressions.

A script has sections ``---context:global``, ``way`` and ``node`` of assignments ``assign name [=] expression``.  An
expression is an operator and its operands; a literal; a variable; ``tag=a|b`` (whether a tag has one of the values, or
``tag=`` for none); ``v:tag`` (a tag's number, null if unset); ``context:name`` (a variable of another context); or any of these in
parentheses.  All values are 32-bit floats, and true is 1.  Compiled assignments form a chain of projections, so
Catalyst prunes what isn't asked for, and the whole profile runs inside code generation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operators and their numbers of operands.
ARITY = {"or": 2, "and": 2, "xor": 2, "not": 1, "add": 2, "sub": 2, "multiply": 2, "divide": 2, "max": 2, "min": 2, "equal": 2, "greater": 2, "lesser": 2, "switch": 3}
CONTEXTS = ("global", "way", "node")


class ScriptError(ValueError):
    """A script that can't be read."""


@dataclass
class Script:
    """Assignments of each context, in order, and the model named by ``---model:``."""

    contexts: dict[str, list[tuple[str, tuple]]] = field(default_factory=lambda: {c: [] for c in CONTEXTS})
    model: str | None = None


def parse(text: str, parameters: dict[str, float] | None = None) -> Script:
    """The script's expressions; a parameter replaces the first assignment of its variable."""
    script, context, given = Script(), "global", dict(parameters or {})
    tokens: list[str] = []
    for line in text.splitlines():
        tokens += line.partition("#")[0].replace("(", " ( ").replace(")", " ) ").split()
    at, known = 0, {c: set() for c in CONTEXTS}

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ScriptError("the script ends within an expression")
        at += 1
        return tokens[at - 1]

    def expression() -> tuple:
        t = take()
        if t == "(":
            inner = expression()
            if take() != ")":
                raise ScriptError("missing )")
            return inner
        if t == "if":
            test = expression()
            if take() != "then":
                raise ScriptError("if without then")
            yes = expression()
            if take() != "else":
                raise ScriptError("if without else")
            return ("switch", test, yes, expression())
        if t in ARITY:
            return (t, *(expression() for _ in range(ARITY[t])))
        if t in ("true", "false"):
            return ("number", float(t == "true"))
        if t.startswith("v:"):
            return ("value", t[2:])
        if "=" in t:
            tag, _, values = t.partition("=")
            return ("tag", tag, tuple(values.split("|")) if values else ("",))
        try:
            return ("number", float(t))
        except ValueError:
            pass
        if ":" in t:
            where, _, name = t.partition(":")
            if where not in CONTEXTS or name not in known[where]:
                raise ScriptError(f"unknown variable {t}")
            return ("variable", where, name)
        for where in (context, "global"):
            if t in known[where]:
                return ("variable", where, t)
        raise ScriptError(f"unknown variable or tag {t}")

    while at < len(tokens):
        t = take()
        if t.startswith("---context:"):
            context = t[len("---context:") :]
            if context not in CONTEXTS:
                raise ScriptError(f"unknown context {context}")
        elif t.startswith("---model:"):
            script.model = t[len("---model:") :]
        elif t == "assign":
            name = take()
            if context != "global" and name in known["global"]:
                raise ScriptError(f"{name} is a global variable and read-only here")
            if at < len(tokens) and tokens[at] == "=":
                at += 1
            value = expression()
            if name in given:
                value = ("number", float(given.pop(name)))
            known[context].add(name)
            script.contexts[context].append((name, value))
        else:
            raise ScriptError(f"assign expected, not {t}")
    return script


def fold(node: tuple, constants: dict[tuple[str, str], float]) -> tuple:
    """The expression with constants worked out and branches that can't be taken left out."""
    kind = node[0]
    if kind == "variable":
        value = constants.get(node[1:])
        return node if value is None else ("number", value)
    if kind not in ARITY:
        return node
    parts = [fold(x, constants) for x in node[1:]]
    numbers = [x[1] if x[0] == "number" else None for x in parts]
    if None not in numbers:
        return ("number", evaluate((kind, *parts), {}, {}))
    first = numbers[0]
    if kind == "switch" and first is not None:
        return parts[1] if first else parts[2]
    if kind in ("or", "and") and (first is not None or numbers[1] is not None):
        constant = first if first is not None else numbers[1]
        other = parts[1] if first is not None else parts[0]
        if kind == "or" and constant:
            return ("number", 1.0)
        if kind == "and" and not constant:
            return ("number", 0.0)
        return ("not", ("not", other))
    return (kind, *parts)


def evaluate(node: tuple, variables: dict, tags: dict) -> float | None:
    """The value of an expression for one row, in plain Python; null compares as false."""
    import numpy as np

    f = np.float32
    kind, args = node[0], node[1:]
    if kind == "number":
        return float(f(args[0]))
    if kind == "variable":
        return variables[args]
    if kind == "tag":
        return float((tags.get(args[0]) or "") in args[1])
    if kind == "value":
        text = tags.get(args[0])
        if not text:
            return None
        try:
            return float(f(text))
        except ValueError:
            return 0.0
    if kind == "switch":
        return evaluate(args[1] if evaluate(args[0], variables, tags) else args[2], variables, tags)
    a = evaluate(args[0], variables, tags)
    if kind == "not":
        return float(not a)
    b = evaluate(args[1], variables, tags)
    if kind in ("or", "and", "xor"):
        x, y = bool(a), bool(b)
        return float({"or": x or y, "and": x and y, "xor": x != y}[kind])
    if kind in ("equal", "greater", "lesser"):
        return float(a is not None and b is not None and {"equal": a == b, "greater": a > b, "lesser": a < b}[kind])
    if kind in ("max", "min"):
        better = a is not None and b is not None and (a > b if kind == "max" else a < b)
        return a if better else b
    if a is None or b is None:
        return None
    if kind == "divide" and b == 0:
        raise ZeroDivisionError("division by zero in a profile")
    return float({"add": f(a) + f(b), "sub": f(a) - f(b), "multiply": f(a) * f(b), "divide": f(a) / f(b) if b else f(0)}[kind])


@dataclass
class Profile:
    """Folded assignments: global settings, and the chain of each context."""

    settings: dict[str, float]
    chains: dict[str, list[tuple[str, tuple]]]
    model: str | None

    def used_tags(self, context: str) -> list[str]:
        """Tags that the context's variables read."""
        found: set[str] = set()

        def walk(node):
            if node[0] in ("tag", "value"):
                found.add(node[1])
            for x in node[1:]:
                if isinstance(x, tuple) and x and isinstance(x[0], str) and (x[0] in ARITY or x[0] in ("tag", "value", "number", "variable")):
                    walk(x)

        for _, e in self.chains[context]:
            walk(e)
        return sorted(found)

    def apply(self, df: DataFrame, outputs: list[str], context: str = "way", tags: str = "tags", reverse: Column | None = None, granted: Column | None = None, foreign: dict[str, str] | None = None) -> DataFrame:
        """``df`` with these variables of the context, 0 where the script has none.

        ``reverse`` tells rows that go against the way's direction: the tag ``reversedirection`` is ``yes`` there.  ``granted``
        does the same for the tag ``nodeaccessgranted``.  ``foreign`` names the columns that hold the other context's
        variables, as ``{"way:cost": column}``; a variable that is read but not given is an error.
        """
        now: dict[tuple[str, str], str] = {tuple(k.split(":", 1)): c for k, c in (foreign or {}).items()}
        keep, wide = df.columns, df
        for number, (name, node) in enumerate(self.chains[context]):
            column = f"_{context}_{name}_{number}"
            wide = wide.withColumn(column, to_column(node, now, tags, {"reversedirection": reverse, "nodeaccessgranted": granted}))
            now[(context, name)] = column
        found = [F.col(now[(context, o)]) if (context, o) in now else F.lit(self.settings.get(o, 0.0)).cast("float") for o in outputs]
        return wide.select(*keep, *[c.alias(o) for c, o in zip(found, outputs, strict=True)])

    def foreign_of(self, context: str) -> list[str]:
        """The other contexts' variables that this one reads."""
        return sorted({n for _, e in self.chains[context] for where, n in _variables(e) if where not in (context, "global")})

    def apply_nodes(self, df: DataFrame, outputs: list[str], tags: str = "tags", way_tags: str = "way_tags", reverse: Column | None = None, granted: Column | None = None) -> DataFrame:
        """Node variables of rows that hold a node's tags and those of the way it was reached by."""
        read = self.foreign_of("node")
        wide = df.withColumn("_reverse", reverse if reverse is not None else F.lit(False))
        columns = {f"way:{n}": f"_foreign_{n}" for n in read}
        ways = self.apply(wide, read, "way", way_tags, F.col("_reverse"))
        ways = ways.withColumnsRenamed({n: columns[f"way:{n}"] for n in read}) if read else ways
        return self.apply(ways, outputs, "node", tags, F.col("_reverse"), granted, columns).select(*df.columns, *outputs)


def _variables(node: tuple):
    if node[0] == "variable":
        yield node[1:]
    elif node[0] in ARITY:
        for x in node[1:]:
            yield from _variables(x)


def access_type(profile: Profile, ways: DataFrame, tags: str = "tags") -> DataFrame:
    """``ways`` with ``access``: 2 where a direction costs less than 9999 a metre, 1 less than 10000 (only for decoding), else 0."""
    forward = profile.apply(ways.withColumn("_no", F.lit(False)), ["costfactor"], tags=tags, reverse=F.col("_no")).withColumnRenamed("costfactor", "_f")
    both = profile.apply(forward.withColumn("_yes", F.lit(True)), ["costfactor"], tags=tags, reverse=F.col("_yes"))
    least = F.when(F.col("_f") < 9999, F.col("_f")).otherwise(F.least("_f", "costfactor"))
    return both.withColumn("access", F.when(least < 9999, 2).when(least < 10000, 1).otherwise(0)).drop("_f", "_no", "_yes", "costfactor")


def start_exclusions(text: str) -> list[tuple[str, str]]:
    """The tags of ways where no route may start, from a comment ``noStartWay=key,value;key,value`` of a script."""
    for line in text.splitlines():
        found = line.partition("#")[2].partition("noStartWay=")[2].split()
        if found:
            return [tuple(x.split(",", 1)) for x in found[0].split(";") if "," in x]
    return []


def may_start(tags: Column, excluded: list[tuple[str, str]]) -> Column:
    """Whether a way with these tags may be where a route starts."""
    out = F.lit(True)
    for key, value in excluded:
        out = out & (F.coalesce(tags[key], F.lit("")) != value)
    return out


def checked_upload(text: str, most: int = 100_000) -> str | None:
    """What is wrong with a script that is to be kept: its size, or that it can't be compiled; null if nothing is."""
    if len(text.encode()) > most:
        return f"the script is too large: more than {most} bytes"
    try:
        compile_profile(text)
    except ScriptError as e:
        return str(e)
    return None


def compile_profile(text: str, parameters: dict[str, float] | None = None) -> Profile:
    script = parse(text, parameters)
    constants: dict[tuple[str, str], float] = {}
    for name, node in script.contexts["global"]:
        value = fold(node, constants)
        if value[0] != "number":
            raise ScriptError(f"{name} isn't constant")
        constants[("global", name)] = value[1]
    chains = {c: [(n, fold(e, constants)) for n, e in script.contexts[c]] for c in ("way", "node")}
    return Profile({n: v for (_, n), v in constants.items()}, chains, script.model)


def _truth(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")


def to_column(node: tuple, variables: dict[tuple[str, str], str], tags: str = "tags", synthetic: dict[str, Column | None] | None = None) -> Column:
    """The expression over the tags and the columns of earlier variables; ``synthetic`` tags are ``yes`` or nothing by a test of the row."""
    kind, args = node[0], node[1:]
    if kind == "number":
        return F.lit(args[0]).cast("float")
    if kind == "variable":
        if args not in variables:
            raise ScriptError(f"no column holds {args[0]}:{args[1]}")
        return F.col(variables[args])
    if kind == "tag":
        if args[0] in (synthetic or {}):
            test = synthetic[args[0]] if synthetic[args[0]] is not None else F.lit(False)
            return _truth(F.when(test, "yes").otherwise("").isin(*args[1]))
        return _truth(F.coalesce(F.col(tags)[args[0]], F.lit("")).isin(*args[1]))
    if kind == "value":
        text = F.nullif(F.col(tags)[args[0]], F.lit(""))
        return F.when(text.isNotNull(), F.coalesce(text.try_cast("float"), F.lit(0.0).cast("float"))).cast("float")
    parts = [to_column(x, variables, tags, synthetic) for x in args]
    zero = F.lit(0.0).cast("float")
    if kind == "switch":
        return F.when(F.coalesce(parts[0] != zero, F.lit(False)), parts[1]).otherwise(parts[2])
    true = [F.coalesce(p != zero, F.lit(False)) for p in parts]
    if kind == "not":
        return _truth(~true[0])
    a, b = parts
    if kind in ("or", "and", "xor"):
        return _truth({"or": true[0] | true[1], "and": true[0] & true[1], "xor": true[0] != true[1]}[kind])
    if kind in ("equal", "greater", "lesser"):
        return _truth({"equal": a == b, "greater": a > b, "lesser": a < b}[kind])
    if kind in ("max", "min"):
        return F.when(F.coalesce(a > b if kind == "max" else a < b, F.lit(False)), a).otherwise(b)
    return {"add": a + b, "sub": a - b, "multiply": a * b, "divide": a / b}[kind].cast("float")

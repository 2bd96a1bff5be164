"""Stratified Datalog over DataFrames: semi-naive closure, proofs of single facts, and an independent check of proofs.

An atom is (predicate, arg, ...); arguments that start with a capital are variables, all others constants. Facts of
a predicate are a DataFrame of string columns a0, a1, ... A rule is (head, body); a body item is an atom, ("not", atom),
("cmp", op, left, right) or ("is", Variable, (op, left, right)) with op one of + - *, on numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cut import cut

Atom = tuple
Rule = tuple[Atom, list]

_COMPARE = {
    "<": lambda a, b: a.cast("double") < b.cast("double"), "<=": lambda a, b: a.cast("double") <= b.cast("double"), ">": lambda a, b: a.cast("double") > b.cast("double"),
    ">=": lambda a, b: a.cast("double") >= b.cast("double"), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
_VALUE = {"<": lambda a, b: float(a) < float(b), "<=": lambda a, b: float(a) <= float(b), ">": lambda a, b: float(a) > float(b), ">=": lambda a, b: float(a) >= float(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}
#: Most steps from a proof's root to a base fact.
DEEPEST = 512


def is_variable(x: str) -> bool:
    return isinstance(x, str) and x[:1].isupper()


def _kind(item: tuple) -> str:
    return item[0] if item[0] in ("not", "cmp", "is") else "atom"


def strata(rules: list[Rule]) -> list[list[str]]:
    """Derived predicates in layers: each depends on its own and lower layers, negatively on lower ones only."""
    heads = {h[0] for h, _ in rules}
    level = dict.fromkeys(heads, 0)
    for _ in range(len(heads) + 1):
        changed = False
        for head, body in rules:
            for item in body:
                kind = _kind(item)
                if kind in ("cmp", "is"):
                    continue
                p = item[1][0] if kind == "not" else item[0]
                if p in level and (need := level[p] + (kind == "not")) > level[head[0]]:
                    level[head[0]] = need
                    changed = True
        if not changed:
            return [[p for p in sorted(heads) if level[p] == k] for k in range(max(level.values(), default=-1) + 1)]
    raise ValueError("negation through recursion")


def _term(x, bound: dict[str, Column]) -> Column:
    if isinstance(x, tuple):
        op, a, b = x
        return _ARITHMETIC[op](_term(a, bound).cast("double"), _term(b, bound).cast("double"))
    return bound[x] if is_variable(x) else F.lit(x)


def _text(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _selected(atom: Atom, facts: DataFrame) -> DataFrame:
    """The atom's variables as columns, from facts that agree with its constants and repeated variables."""
    first: dict[str, str] = {}
    for k, x in enumerate(atom[1:]):
        if not is_variable(x):
            facts = facts.where(F.col(f"a{k}") == x)
        elif x in first:
            facts = facts.where(F.col(f"a{k}") == F.col(first[x]))
        else:
            first[x] = f"a{k}"
    return facts.select(*(F.col(c).alias(v) for v, c in first.items())) if first else facts.select(F.lit(1).alias("__any")).distinct()


def evaluate(rule: Rule, facts: dict[str, DataFrame], delta: tuple[int, DataFrame] | None = None) -> DataFrame:
    """Distinct head facts of one pass of a rule; delta replaces the facts of one body item."""
    head, body = rule
    now: DataFrame | None = None
    for k, item in enumerate(body):
        kind = _kind(item)
        if kind == "atom":
            part = _selected(item, delta[1] if delta and delta[0] == k else facts[item[0]])
            if now is None:
                now = part
            else:
                shared = [c for c in part.columns if c in now.columns]
                now = now.join(part, shared) if shared else now.crossJoin(part)  # only where the rule itself asks for all pairs
        elif kind == "not":
            atom = item[1]
            part = _selected(atom, facts[atom[0]])
            shared = [c for c in part.columns if c in now.columns]
            now = now.join(part, shared, "left_anti")
        elif kind == "cmp":
            bound = {c: F.col(c) for c in now.columns}
            now = now.where(_COMPARE[item[1]](_term(item[2], bound), _term(item[3], bound)))
        else:
            bound = {c: F.col(c) for c in now.columns}
            now = now.withColumn(item[1], _text(_term(item[2], bound)))
    return now.select(*((F.col(x) if is_variable(x) else F.lit(x)).alias(f"a{k}") for k, x in enumerate(head[1:]))).distinct()


#: Rounds after which the known facts are written out as one table, so that plans stay small however long a chain is.
COMPACT_EVERY = 16


def closure(rules: list[Rule], facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All facts that follow, by predicate, up to the fixpoint. Each round joins only what the round before has added (semi-naive).

    Rules with arithmetic can derive without end, and then this does not return.
    """
    known = dict(facts)
    arity = {h[0]: len(h) - 1 for h, _ in rules}
    spark = next(iter(facts.values())).sparkSession
    for layer in strata(rules):
        own = [r for r in rules if r[0][0] in layer]
        for p in layer:
            known.setdefault(p, spark.createDataFrame([], ", ".join(f"a{k} string" for k in range(arity[p]))))

        def fresh(parts: list[tuple[str, DataFrame]]) -> dict[str, DataFrame]:
            out = {}
            for p in {p for p, _ in parts}:
                new = reduce(DataFrame.unionByName, [d for q, d in parts if q == p]).distinct()
                cols = new.columns
                new = cut(new.join(known[p], cols, "left_anti"))
                if not new.isEmpty():
                    out[p] = new
            return out

        added = fresh([(r[0][0], evaluate(r, known)) for r in own])
        rounds = 0
        while added:
            rounds += 1
            for p, d in added.items():
                known[p] = known[p].unionByName(d)
                if rounds % COMPACT_EVERY == 0:
                    known[p] = cut(known[p])
            added = fresh([(r[0][0], evaluate(r, known, (k, added[item[0]]))) for r in own for k, item in enumerate(r[1]) if _kind(item) == "atom" and item[0] in added])
    return known


def region_rule(head: str, bounds: dict[str, tuple[float | None, float | None]]) -> Rule:
    """head(X) for rows X in a region, a clause over facts row(X) and <column>(X, value): low < value <= high for each bounded column."""
    body: list = [("row", "X")]
    for k, (column, (low, high)) in enumerate(sorted(bounds.items())):
        body.append((column, "X", f"V{k}"))
        body += [("cmp", ">", f"V{k}", repr(float(low)))] if low is not None else []
        body += [("cmp", "<=", f"V{k}", repr(float(high)))] if high is not None else []
    return (head, "X"), body


def prove(fact: Atom, rules: list[Rule], base: set[Atom], derived: set[Atom] | None = None) -> tuple | None:
    """A proof (fact, rule or "base", premises) of one fact from a small set of base facts, or None.

    Facts are tuples; the driver searches rounds of the closure of the given facts, so use it on a neighbourhood.
    """
    proofs: dict[Atom, tuple] = {f: (f, "base", []) for f in base}
    for layer in strata(rules):
        own = [r for r in rules if r[0][0] in layer]
        changed = True
        while changed:
            changed = False
            for rule in own:
                for binding, used in _matches(rule[1], list(proofs), {}, []):
                    got = (rule[0][0], *(binding.get(x, x) for x in rule[0][1:]))
                    if got not in proofs:
                        proofs[got] = (got, rule, [proofs[u] for u in used])
                        changed = True
    return proofs.get(fact)


def _unify(atom: Atom, fact: Atom, binding: dict) -> dict | None:
    if atom[0] != fact[0] or len(atom) != len(fact):
        return None
    out = dict(binding)
    for x, v in zip(atom[1:], fact[1:], strict=True):
        if is_variable(x):
            if out.setdefault(x, v) != v:
                return None
        elif x != v:
            return None
    return out


def _number(x, binding: dict) -> float:
    if isinstance(x, tuple):
        return _ARITHMETIC[x[0]](_number(x[1], binding), _number(x[2], binding))
    return float(binding.get(x, x))


def _shown(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x)


def _matches(body: list, facts: list[Atom], binding: dict, used: list):
    if not body:
        yield binding, used
        return
    item, rest = body[0], body[1:]
    kind = _kind(item)
    if kind == "atom":
        for f in facts:
            if (b := _unify(item, f, binding)) is not None:
                yield from _matches(rest, facts, b, [*used, f])
    elif kind == "not":
        ground = (item[1][0], *(binding.get(x, x) for x in item[1][1:]))
        if ground not in facts:
            yield from _matches(rest, facts, binding, used)
    elif kind == "cmp":
        if _VALUE[item[1]](binding.get(item[2], item[2]), binding.get(item[3], item[3])):
            yield from _matches(rest, facts, binding, used)
    else:
        yield from _matches(rest, facts, binding | {item[1]: _shown(_number(item[2], binding))}, used)


def check(proof, base: set[Atom] | None = None, rules: list[Rule] | None = None, path: tuple = ()) -> bool:
    """Whether a proof holds, re-derived step by step; anything malformed, cyclic or too deep does not.

    base and rules, if given, are the only trusted ones. A negated item holds if its fact is neither in base nor follows
    by the rules; without base and rules nobody can tell, and the proof does not hold.
    """
    try:
        fact, rule, premises = proof
        if fact in path or len(path) > DEEPEST:
            return False
        if rule == "base":
            return not premises and (base is None or fact in base)
        if rules is not None and rule not in rules:
            return False
        head, body = rule
        given = [p[0] for p in premises]
        if sum(_kind(i) == "atom" for i in body) != len(given):
            return False
        binding: dict | None = {}
        at = 0
        for item in body:
            kind = _kind(item)
            if kind == "atom":
                binding = _unify(item, given[at], binding)
                at += 1
                if binding is None:
                    return False
            elif kind == "not":
                absent = (item[1][0], *(binding.get(x, x) for x in item[1][1:]))
                if base is None or rules is None or absent in base:
                    return False
                if any(h[0] == absent[0] for h, _ in rules) and prove(absent, rules, base) is not None:
                    return False
            elif kind == "cmp":
                if not _VALUE[item[1]](binding.get(item[2], item[2]), binding.get(item[3], item[3])):
                    return False
            elif binding.setdefault(item[1], _shown(_number(item[2], binding))) != _shown(_number(item[2], binding)):
                return False
        if (head[0], *(binding.get(x, x) for x in head[1:])) != fact:
            return False
        return all(check(p, base, rules, (*path, fact)) for p in premises)
    except (TypeError, ValueError, KeyError, IndexError):
        return False


def show(proof: tuple, depth: int = 0) -> str:
    """The proof as indented lines."""
    fact, rule, premises = proof
    line = "  " * depth + f"{fact[0]}({', '.join(map(str, fact[1:]))})" + ("" if rule != "base" else "  [base]")
    return "\n".join([line, *(show(p, depth + 1) for p in premises)])

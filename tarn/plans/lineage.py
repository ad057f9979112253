"""Which source columns an output column of a query is made from."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _seq(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def lineage(df: DataFrame) -> dict[str, set[str]]:
    """output column -> names of the source columns that its value is computed from.

    Walks the analysed plan: an alias hands on the references of its
    expression, a set operation those of the same position in each input, and
    an attribute that nothing defines is a source column.
    """
    defined: dict[int, list] = {}
    names: dict[int, str] = {}

    def references(expression) -> list[int]:
        out = []
        for a in _seq(expression.references().toSeq()):
            names[a.exprId().id()] = a.name()
            out.append(a.exprId().id())
        return out

    def note(expression) -> None:
        if expression.getClass().getSimpleName() == "Alias":
            defined.setdefault(expression.exprId().id(), []).extend(references(expression.child()))

    def walk(plan) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "Project":
            expressions = plan.projectList()
        elif kind == "Aggregate":
            expressions = plan.aggregateExpressions()
        elif kind == "Window":
            expressions = plan.windowExpressions()
        else:
            expressions = None
        for e in _seq(expressions) if expressions is not None else []:
            note(e)
        for a in _seq(plan.output()):
            names.setdefault(a.exprId().id(), a.name())
        children = _seq(plan.children())
        if kind in ("Union", "Intersect", "Except"):
            for i, a in enumerate(_seq(plan.output())):
                ids = [_seq(c.output())[i].exprId().id() for c in children]
                own = a.exprId().id()
                defined.setdefault(own, []).extend(x for x in ids if x != own)
        if kind == "Generate":
            for a in _seq(plan.generatorOutput()):
                defined.setdefault(a.exprId().id(), []).extend(references(plan.generator()))
        for c in children:
            walk(c)

    plan = df._jdf.queryExecution().analyzed()
    for a in _seq(plan.output()):
        names[a.exprId().id()] = a.name()
    walk(plan)

    def sources(i: int, seen: frozenset) -> set[str]:
        if i in seen:
            return set()
        if i not in defined:
            return {names[i]} if i in names else set()
        return set().union(*[sources(x, seen | {i}) for x in defined[i]], set())

    return {a.name(): sources(a.exprId().id(), frozenset()) for a in _seq(plan.output())}

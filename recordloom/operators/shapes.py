"""Shapes read from Turtle and compiled to Columns.

A shapes document is small and is read on the driver, into a tree of constraints.  All
constraints about a subject's own statements become Boolean Columns over its property
map, so that every shape is checked in one pass over the subjects, logical branches
and nested shapes included.  What needs other subjects (sequence paths, classes and
shapes of objects, targets by object) is joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.sources import turtle

SH = "http://www.w3.org/ns/shacl#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
_STRING = turtle.XSD + "string"
#: Severities; any other counts as a violation.
SEVERITIES = {SH + "Violation": "violation", SH + "Warning": "warning", SH + "Info": "info"}
VALUES = "array<struct<value:string,datatype:string,is_iri:boolean>>"


@dataclass
class Shape:
    """Constraints of a node, or of the values of `path` (predicates in sequence; ``^`` before one is its inverse)."""

    name: str
    path: tuple[str, ...] = ()
    severity: str = "violation"
    message: str | None = None
    targets: list[tuple[str, str]] = field(default_factory=list)
    own: dict[str, list] = field(default_factory=dict)
    properties: list[Shape] = field(default_factory=list)
    logic: list[tuple[str, list[Shape]]] = field(default_factory=list)
    nodes: list[Shape] = field(default_factory=list)
    closed: bool = False
    ignored: tuple[str, ...] = ()


class Shapes:
    """The shapes of a Turtle document, by name, and its subclasses."""

    _OWN = ("datatype", "class", "nodeKind", "pattern", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "hasValue", "minCount", "maxCount")

    def __init__(self, text: str):
        self.graph: dict[str, dict[str, list[tuple[str, str, str | None]]]] = {}
        for s, _, p, o, kind, datatype, _ in turtle.parse(text):
            self.graph.setdefault(s, {}).setdefault(p, []).append((o, kind, datatype))
        self.subclasses: dict[str, set[str]] = {}
        for s, props in self.graph.items():
            for o, *_ in props.get(RDFS + "subClassOf", []):
                self.subclasses.setdefault(o, set()).add(s)
        self._made: dict[str, Shape] = {}
        kinds = ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf")
        self.targeted = [self.shape(s) for s, props in self.graph.items() if any(SH + k in props for k in kinds)]
        for shape in self.targeted:
            shape.targets = [(k, o) for k in kinds for o, *_ in self.graph[shape.name].get(SH + k, [])]

    def _get(self, s: str, name: str) -> list[tuple[str, str, str | None]]:
        return self.graph.get(s, {}).get(SH + name, [])

    def _items(self, head: str) -> list[str]:
        out, rest, first = [], turtle.RDF + "rest", turtle.RDF + "first"
        while head in self.graph and first in self.graph[head] and head not in out:
            out.append(self.graph[head][first][0][0])
            head = self.graph[head][rest][0][0] if rest in self.graph[head] else ""
        return out

    def _path(self, node: str) -> tuple[str, ...]:
        if inverse := self._get(node, "inversePath"):
            return ("^" + inverse[0][0],)
        steps = self._items(node)
        return tuple(x for s in steps for x in self._path(s)) if steps else (node,)

    def shape(self, s: str) -> Shape:
        if s in self._made:
            return self._made[s]
        shape = self._made[s] = Shape(s)
        for o, *_ in self._get(s, "path"):
            shape.path = self._path(o)
        for o, *_ in self._get(s, "severity"):
            shape.severity = SEVERITIES.get(o, "violation")
        for o, *_ in self._get(s, "message"):
            shape.message = o
        for name in self._OWN:
            if found := self._get(s, name):
                shape.own[name] = [o for o, *_ in found]
        for o, *_ in self._get(s, "in"):
            shape.own["in"] = self._items(o)
        shape.closed = any(o == "true" for o, *_ in self._get(s, "closed"))
        shape.ignored = tuple(x for o, *_ in self._get(s, "ignoredProperties") for x in self._items(o))
        shape.properties = [self.shape(o) for o, *_ in self._get(s, "property")]
        shape.nodes = [self.shape(o) for o, *_ in self._get(s, "node")]
        for kind in ("or", "xone", "and"):
            shape.logic += [(kind, [self.shape(x) for x in self._items(o)]) for o, *_ in self._get(s, kind)]
        shape.logic += [("not", [self.shape(o)]) for o, *_ in self._get(s, "not")]
        return shape

    def below(self, cls: str) -> list[str]:
        """A class and all its subclasses."""
        out, todo = {cls}, [cls]
        while todo:
            for c in self.subclasses.get(todo.pop(), ()):
                if c not in out:
                    out.add(c)
                    todo.append(c)
        return sorted(out)

    def every(self) -> list[Shape]:
        return list(self._made.values())


def _truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _key(path: tuple[str, ...]) -> str:
    return "/".join(path)


def _values(props: Column, path: tuple[str, ...]) -> Column:
    return F.coalesce(F.element_at(props, F.lit(_key(path))), F.array().cast(VALUES))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _logic(kind: str, branches: list[Column]) -> Column:
    if kind == "or":
        return _any(branches)
    if kind == "xone":
        return sum((b.cast("int") for b in branches), F.lit(0)) == 1
    return ~branches[0] if kind == "not" else _all(branches)


def _is_number(x: str) -> bool:
    try:
        return float(x) == float(x)
    except ValueError:
        return False


def _value_tests(shape: Shape) -> dict[str, object]:
    """Tests of one value, by constraint."""
    tests: dict[str, object] = {}
    for name, wanted in shape.own.items():
        w = wanted[0]
        if name == "datatype":
            tests[name] = lambda v, w=w: ~_truth(v["is_iri"]) & (F.coalesce(v["datatype"], F.lit(_STRING)).isin(w, w.replace(turtle.XSD, "xsd:")))
        elif name == "in":
            tests[name] = lambda v, wanted=wanted: v["value"].isin(*wanted)
        elif name == "nodeKind":
            kind = w.removeprefix(SH)
            blank = lambda v: F.startswith(v["value"], F.lit("_:"))
            tests[name] = lambda v, kind=kind, blank=blank: _any(
                [_truth(v["is_iri"]) & ~blank(v)] * ("IRI" in kind) + [blank(v)] * ("BlankNode" in kind) + [~_truth(v["is_iri"]) & ~blank(v)] * ("Literal" in kind)
            )
        elif name == "pattern":
            tests[name] = lambda v, w=w: v["value"].rlike(w)
        elif name == "minLength":
            tests[name] = lambda v, w=w: F.length(v["value"]) >= int(w)
        elif name == "maxLength":
            tests[name] = lambda v, w=w: F.length(v["value"]) <= int(w)
        elif name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            def test(v: Column, w: str = w, name: str = name) -> Column:
                # Dates and times compare as text, numbers as numbers.
                x, y = (v["value"].try_cast("double"), F.lit(float(w))) if _is_number(w) else (v["value"], F.lit(w))
                return {"minInclusive": x >= y, "maxInclusive": x <= y, "minExclusive": x > y, "maxExclusive": x < y}[name]

            tests[name] = test
    for n, (kind, branches) in enumerate(shape.logic):
        if shape.path:
            tests[f"{kind}#{n}" if f"{kind}" in tests else kind] = lambda v, kind=kind, branches=branches: _logic(kind, [_all([_truth(t(v)) for t in _value_tests(b).values()]) for b in branches])
    return tests


def _failing(values: Column, test) -> Column:
    return F.filter(values, lambda v: ~_truth(test(v)))


def _parts(shape: Shape, props: Column) -> list[tuple[Shape, str, Column, Column]]:
    """(shape, constraint, holds, offending value) of everything a shape says about its focus' own statements."""
    none = F.lit(None).cast("string")
    out = []
    if shape.path:
        values = _values(props, shape.path)
        n = F.size(values)
        for name, wanted in shape.own.items():
            if name == "minCount":
                out.append((shape, name, n >= int(wanted[0]), none))
            elif name == "maxCount":
                out.append((shape, name, n <= int(wanted[0]), none))
            elif name == "hasValue":
                out.append((shape, name, _all([F.array_contains(F.transform(values, lambda v: v["value"]), w) for w in wanted]), none))
        for name, test in _value_tests(shape).items():
            bad = _failing(values, test)
            out.append((shape, name.split("#")[0], F.size(bad) == 0, F.get(bad, F.lit(0))["value"]))
        return out
    for p in shape.properties:
        out += _parts(p, props)
    for inner in shape.nodes:  # of the focus itself
        out += _parts(inner, props)
    for kind, branches in shape.logic:
        out.append((shape, kind, _logic(kind, [holds(b, props) for b in branches]), none))
    if shape.closed:
        known = [_key(p.path) for p in shape.properties if p.path] + list(shape.ignored) + [turtle.RDF + "type", "rdf:type"]
        extra = F.array_sort(F.filter(F.map_keys(props), lambda k: ~k.isin(*known) & ~k.contains("/^") & ~F.startswith(k, F.lit("^")) & ~k.isin(*[_key(p.path) for p in shape.properties if len(p.path) > 1])))
        out.append((shape, "closed", F.size(extra) == 0, F.get(extra, F.lit(0))))
    return out


def holds(shape: Shape, props: Column) -> Column:
    """Whether a subject with these properties conforms to a shape, by its own statements."""
    return _all([_truth(c) for _, _, c, _ in _parts(shape, props)])


def _walk(shapes: list[Shape]) -> list[Shape]:
    seen: dict[int, Shape] = {}
    todo = list(shapes)
    while todo:
        s = todo.pop()
        if id(s) not in seen:
            seen[id(s)] = s
            todo += [*s.properties, *s.nodes, *[b for _, bs in s.logic for b in bs]]
    return list(seen.values())


def with_paths(subjects: DataFrame, shapes: Shapes) -> DataFrame:
    """`subjects` with the values of all sequence and inverse paths added to ``props`` under the path's name."""
    paths = sorted({s.path for s in shapes.every() if len(s.path) > 1 or s.path and s.path[0].startswith("^")})
    if not paths:
        return subjects
    triples = subjects.select("s", F.explode("props").alias("p", "vs")).select("s", "p", F.explode("vs").alias("v"))
    out = subjects
    for path in paths:
        walk = None
        for step in path:
            edges = triples.where(F.col("p") == step.removeprefix("^"))
            if step.startswith("^"):
                edges = edges.where(F.col("v.is_iri")).select(F.col("v.value").alias("from"), F.struct(F.col("s").alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit(True).alias("is_iri")).alias("to"))
            else:
                edges = edges.select(F.col("s").alias("from"), F.col("v").alias("to"))
            walk = edges.withColumnRenamed("from", "s") if walk is None else walk.select("s", F.col("to.value").alias("from")).join(edges, "from").select("s", "to")
        reached = walk.groupBy("s").agg(F.collect_set("to").cast(VALUES).alias("_more"))
        out = out.join(reached, "s", "left").withColumn("props", F.when(F.col("_more").isNull(), F.col("props")).otherwise(F.map_concat("props", F.create_map(F.lit(_key(path)), F.col("_more"))))).drop("_more")
    return out


def _is_target(shape: Shape, shapes: Shapes) -> Column:
    tests = []
    for kind, what in shape.targets:
        if kind == "targetClass":
            tests.append(F.arrays_overlap("types", F.array(*[F.lit(c) for c in shapes.below(what)])))
        elif kind == "targetNode":
            tests.append(F.col("s") == what)
        elif kind == "targetSubjectsOf":
            tests.append(F.size(_values(F.col("props"), (what,))) > 0)
        else:
            tests.append(F.array_contains("object_of", what))
    return _truth(_any(tests))


def violations(subjects: DataFrame, shapes: Shapes) -> DataFrame:
    """(focus, shape, path, constraint, severity, value, message) of every constraint a target breaks.

    `subjects`: ``s``, ``types`` (array) and ``props`` (map of predicate to values).  Null types and
    properties are none; subjects that no shape targets are not checked; one row per
    constraint and subject, with its first offending value.
    """
    base = subjects.select("s", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("props", F.create_map().cast(f"map<string,{VALUES}>")).alias("props"))
    full = with_paths(base, shapes)
    wanted = sorted({what for s in shapes.targeted for kind, what in s.targets if kind == "targetObjectsOf"})
    if wanted:
        refs = base.select(F.explode("props").alias("p", "vs")).where(F.col("p").isin(*wanted)).select("p", F.explode("vs").alias("v")).where("v.is_iri")
        full = full.join(refs.groupBy(F.col("v.value").alias("s")).agg(F.collect_set("p").alias("object_of")), "s", "left")
    rows = []
    for shape in shapes.targeted:
        target = _is_target(shape, shapes)
        for at, name, ok, bad in _parts(shape, F.col("props")):
            row = F.struct(
                F.lit(shape.name).alias("shape"), F.lit(_key(at.path)).alias("path"), F.lit(name).alias("constraint"), F.lit(at.severity).alias("severity"), bad.cast("string").alias("value"),
                F.lit(at.message).cast("string").alias("message"),
            )
            rows.append(F.when(target & ~_truth(ok), row))
    out = full.select(F.col("s").alias("focus"), F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull()))) if rows else full.select(F.col("s").alias("focus"), *[F.lit("").alias(c) for c in ("shape", "path", "constraint", "severity", "value", "message")]).limit(0)
    # Constraints on the objects: their classes, and the shapes they must have.
    for shape in shapes.targeted:
        for p in _walk([shape]):
            if not p.path or not ("class" in p.own or p.nodes):
                continue
            objects = full.where(_is_target(shape, shapes)).select("s", F.explode(_values(F.col("props"), p.path)).alias("v")).select("s", F.col("v.value").alias("o"))
            checks = [("class", base.where(_truth(F.arrays_overlap("types", F.array(*[F.lit(c) for c in shapes.below(cls)]))))) for cls in p.own.get("class", [])]
            checks += [("node", full.where(holds(inner, F.col("props")))) for inner in p.nodes]
            for name, good in checks:
                lost = objects.join(good.select(F.col("s").alias("o")), "o", "left_anti").groupBy("s").agg(F.min("o").alias("value"))
                out = out.unionByName(lost.select(F.col("s").alias("focus"), F.lit(shape.name).alias("shape"), F.lit(_key(p.path)).alias("path"), F.lit(name).alias("constraint"), F.lit(p.severity).alias("severity"), "value", F.lit(p.message).cast("string").alias("message")))
    return out


def conforms(found: DataFrame, subjects: DataFrame) -> DataFrame:
    """(s, passed, n_violations, n_warnings, n_info): a subject fails by violations only."""
    n = found.groupBy(F.col("focus").alias("s")).agg(*[F.count_if(F.col("severity") == k).alias(f"n_{k}") for k in ("violation", "warning", "info")])
    count = lambda c: F.coalesce(c, F.lit(0))
    return subjects.select("s").join(n, "s", "left").select(
        "s", (count("n_violation") == 0).alias("passed"), count("n_violation").alias("n_violations"), count("n_warning").alias("n_warnings"), count("n_info").alias("n_info")
    )


def gate(incoming: DataFrame, shapes: Shapes) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): of `incoming` subjects, those without violations may be written."""
    bad = violations(incoming, shapes).where("severity = 'violation'").select(F.col("focus").alias("s")).distinct()
    return incoming.join(bad, "s", "left_anti"), incoming.join(bad, "s", "left_semi")


def uncovered_types(subjects: DataFrame, shapes: Shapes) -> DataFrame:
    """(type, n_subjects) of types that no shape targets, most frequent first."""
    known = [c for s in shapes.targeted for kind, what in s.targets if kind == "targetClass" for c in shapes.below(what)]
    t = subjects.select("s", F.explode("types").alias("type")).where(~F.col("type").isin(*known)) if known else subjects.select("s", F.explode("types").alias("type"))
    return t.groupBy("type").agg(F.count_distinct("s").alias("n_subjects")).orderBy(F.desc("n_subjects"), "type")

"""Small graphs as Turtle and JSON-LD, written on the driver; large ones go out as N-Triples (``sources.rdf``)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from strataweave.operators.ontology import RDF, XSD

#: Triples a pretty-printed export may hold.
MOST = 200_000


def _rows(triples: DataFrame) -> list:
    rows = triples.select("s", "p", "o", "o_kind", "datatype", "lang").distinct().orderBy("s", "p", "o").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} triples: write N-Triples instead")
    return rows


def to_turtle(triples: DataFrame, prefixes: dict[str, str]) -> str:
    """Turtle with the given prefixes, a block per subject."""

    def node(iri: str) -> str:
        if iri.startswith("_:"):
            return iri
        for p, ns in prefixes.items():
            local = iri.removeprefix(ns)
            if local != iri and local.replace("_", "a").isalnum():
                return f"{p}:{local}"
        return f"<{iri}>"

    def value(r) -> str:
        if r.o_kind != "literal":
            return node(r.o)
        text = json.dumps(r.o, ensure_ascii=False)
        return f"{text}@{r.lang}" if r.lang else text if r.datatype in (None, XSD + "string") else f"{text}^^{node(r.datatype)}"

    out = [f"@prefix {p}: <{ns}> ." for p, ns in prefixes.items()]
    blocks: dict[str, dict[str, list[str]]] = {}
    for r in _rows(triples):
        blocks.setdefault(r.s, {}).setdefault("a" if r.p == RDF + "type" else node(r.p), []).append(value(r))
    out += [f"{node(s)} " + " ;\n    ".join(f"{p} {', '.join(v)}" for p, v in ps.items()) + " ." for s, ps in blocks.items()]
    return "\n".join(out) + "\n"


def to_jsonld(triples: DataFrame) -> str:
    """Expanded JSON-LD."""
    nodes: dict[str, dict] = {}
    for r in _rows(triples):
        own = nodes.setdefault(r.s, {"@id": r.s})
        if r.p == RDF + "type":
            own.setdefault("@type", []).append(r.o)
        elif r.o_kind == "literal":
            own.setdefault(r.p, []).append({"@value": r.o} | ({"@language": r.lang} if r.lang else {"@type": r.datatype} if r.datatype not in (None, XSD + "string") else {}))
        else:
            own.setdefault(r.p, []).append({"@id": r.o})
    return json.dumps(list(nodes.values()), ensure_ascii=False, indent=1)


def coverage_markdown(coverage: DataFrame) -> str:
    """The coverage report as text."""
    rows = coverage.orderBy("module_action").collect()
    head = "| action | triples | mapped | strong | review |\n|---|---|---|---|---|"
    return "\n".join([head, *(f"| {r.module_action} | {r.n_triples} | {r.mapped_ratio:.2%} | {r.strong_ratio:.2%} | {r.n_review} |" for r in rows)])


def assemble(emitted: DataFrame, path: str, shapes: DataFrame | None = None, triples: DataFrame | None = None) -> str:
    """Emitted triples as CSV files under ``path``/triples and the report as ``path``/report (Spark's writers: any file system).

    With shapes and the ontology's triples the emitted ones are validated first, and the report says how many violations
    there are. Returns the report.
    """
    from strataweave.operators.emit import coverage
    from strataweave.operators.ontology import validate_shapes
    from strataweave.sources.rdf import emitted_to_rdf

    columns = ("subject", "predicate", "object", "confidence", "method", "review_flag", "module_action")
    emitted.select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}/triples")
    report = coverage_markdown(coverage(emitted))
    if shapes is not None:
        own = emitted_to_rdf(emitted)
        n = validate_shapes(own if triples is None else own.unionByName(triples), shapes).count()
        report += f"\n\nShapes: {'conforms' if n == 0 else f'{n} violations'}"
    spark = emitted.sparkSession
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return report

"""JSON-LD and RDF/XML texts as triples: the parts that ontologies use. Rows are as from ``rdf.parse_turtle``."""

from __future__ import annotations

import json
from itertools import count
from urllib.parse import urljoin
from xml.etree import ElementTree

from strataweave.operators.ontology import RDF, XSD

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


class RdfError(ValueError):
    pass


class _Rows:
    def __init__(self, where: str):
        self.out: list[tuple] = []
        self.numbers, self.where = count(1), where

    def fresh(self) -> str:
        return f"_:{self.where}{next(self.numbers)}"

    def name(self, label: str) -> str:
        return f"_:{self.where}-{label}"

    def node(self, s: str, p: str, o: str) -> None:
        self.out.append((s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))

    def literal(self, s: str, p: str, o: str, datatype: str | None = None, lang: str | None = None) -> None:
        self.out.append((s, p, o, "literal", None if lang else datatype or XSD + "string", lang))


def parse_jsonld(text: str, where: str = "j") -> list[tuple]:
    """Nodes under @graph or alone, nested nodes, @type, @value, @list; a context of prefixes and terms (with @type: @id or a
    datatype), @vocab and @base. A remote context raises RdfError. List members become members of a blank node."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise RdfError(str(e)) from None
    rows = _Rows(where)

    def context(of: dict, said) -> dict:
        for c in said if isinstance(said, list) else [said]:
            if isinstance(c, str):
                raise RdfError("remote contexts are not read")
            of = of | (c or {})
        return of

    def iri(x: str, ctx: dict, vocabulary: bool = False, key: bool = False) -> str:
        if x.startswith("_:"):
            return rows.name(x[2:])
        term = ctx.get(x)
        if term is not None and vocabulary:
            x = term["@id"] if isinstance(term, dict) else term
        prefix, colon, rest = x.partition(":")
        if colon and not rest.startswith("//") and isinstance(ctx.get(prefix), (str, dict)):
            base = ctx[prefix]["@id"] if isinstance(ctx[prefix], dict) else ctx[prefix]
            return iri(base, {k: v for k, v in ctx.items() if k != prefix}) + rest
        if colon or x.startswith("@"):
            return x
        if vocabulary and "@vocab" in ctx:
            return ctx["@vocab"] + x
        return x if key else urljoin(ctx.get("@base", ""), x)

    def value(s: str, p: str, v, ctx: dict, coerce: str | None) -> None:
        if isinstance(v, dict) and "@list" in v:
            node = rows.fresh()
            rows.node(s, p, node)
            for x in v["@list"]:
                value(node, RDF + "member", x, ctx, coerce)
        elif isinstance(v, dict) and "@value" in v:
            kind = v.get("@type")
            plain(s, p, v["@value"], iri(kind, ctx, True) if kind else None, v.get("@language"))
        elif isinstance(v, dict):
            rows.node(s, p, subject(v, ctx))
        elif coerce in ("@id", "@vocab") and isinstance(v, str):
            rows.node(s, p, iri(v, ctx, coerce == "@vocab"))
        elif v is not None:
            plain(s, p, v, iri(coerce, ctx, True) if coerce else None, ctx.get("@language") if isinstance(v, str) and not coerce else None)

    def plain(s: str, p: str, v, datatype: str | None, lang: str | None) -> None:
        if isinstance(v, bool):
            rows.literal(s, p, str(v).lower(), datatype or XSD + "boolean")
        elif isinstance(v, (int, float)):
            rows.literal(s, p, str(v), datatype or XSD + ("integer" if isinstance(v, int) else "double"))
        else:
            rows.literal(s, p, str(v), datatype, lang)

    def subject(node: dict, ctx: dict) -> str:
        ctx = context(ctx, node["@context"]) if "@context" in node else ctx
        own = iri(node["@id"], ctx) if "@id" in node else rows.fresh()
        for key, values in node.items():
            if key == "@type":
                for t in values if isinstance(values, list) else [values]:
                    rows.node(own, RDF + "type", iri(t, ctx, True))
            elif key == "@graph":
                for x in values:
                    subject(x, ctx)
            elif not key.startswith("@"):
                p = iri(key, ctx, True, True)
                if ":" not in p:
                    continue  # a key the context does not know says nothing
                term = ctx.get(key)
                for v in values if isinstance(values, list) else [values]:
                    value(own, p, v, ctx, term.get("@type") if isinstance(term, dict) else None)
        return own

    for node in data if isinstance(data, list) else [data]:
        subject(node, {})
    return rows.out


def parse_rdfxml(text: str, where: str = "x") -> list[tuple]:
    """Descriptions and typed nodes with about, ID or nodeID; properties as attributes or elements with resource, nodeID, datatype
    or a nested node; parseType Resource, Collection and Literal; xml:lang and xml:base."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise RdfError(str(e)) from None
    rows = _Rows(where)
    plain = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def subject(e, base: str, lang: str | None) -> str:
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang)
        if e.get(f"{_R}about") is not None:
            own = urljoin(base, e.get(f"{_R}about"))
        elif e.get(f"{_R}ID"):
            own = f"{base}#{e.get(f'{_R}ID')}"
        else:
            own = rows.name(e.get(f"{_R}nodeID")) if e.get(f"{_R}nodeID") else rows.fresh()
        if e.tag != f"{_R}Description":
            rows.node(own, RDF + "type", plain(e.tag))
        attributes(own, e, lang)
        for part in e:
            prop(own, part, base, lang)
        return own

    def attributes(own: str, e, lang: str | None) -> None:
        for key, v in e.attrib.items():
            if key == f"{_R}type":
                rows.node(own, RDF + "type", v)
            elif not key.startswith((_R, _XML)):
                rows.literal(own, plain(key), v, None, lang)

    def prop(own: str, e, base: str, lang: str | None) -> None:
        p, lang, kind = plain(e.tag), e.get(f"{_XML}lang", lang), e.get(f"{_R}parseType")
        if e.get(f"{_R}resource") is not None:
            rows.node(own, p, urljoin(base, e.get(f"{_R}resource")))
        elif e.get(f"{_R}nodeID"):
            rows.node(own, p, rows.name(e.get(f"{_R}nodeID")))
        elif kind in ("Collection", "Resource"):
            node = rows.fresh()
            rows.node(own, p, node)
            for part in e:
                if kind == "Resource":
                    prop(node, part, base, lang)
                else:
                    rows.node(node, RDF + "member", subject(part, base, lang))
        elif kind == "Literal":
            rows.literal(own, p, (e.text or "") + "".join(ElementTree.tostring(x, "unicode") for x in e), RDF + "XMLLiteral")
        elif len(e):
            for part in e:
                rows.node(own, p, subject(part, base, lang))
        else:
            rows.literal(own, p, e.text or "", e.get(f"{_R}datatype"), lang)

    for e in root if root.tag == f"{_R}RDF" else [root]:
        subject(e, root.get(f"{_XML}base", ""), root.get(f"{_XML}lang"))
    return rows.out

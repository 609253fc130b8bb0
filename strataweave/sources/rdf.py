"""RDF in and out. Turtle, RDF/XML and JSON-LD are read per file (they cannot be split); N-Triples are split by line."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataweave.operators.ontology import RDF, RDFS, TRIPLE, XSD
from strataweave.sources.rdf_formats import parse_jsonld, parse_rdfxml

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^<>"\s]*>)|(?P<string>\"{3}(?:\"{0,2}(?:[^"\\]|\\[\s\S]))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\[\s\S]))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@(?!prefix\b|base\b)[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<word>@prefix|@base|(?i:prefix|base)(?=\s+[\w.-]*:?\s*<))"""
    r"""|(?P<dtype>\^\^)|(?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)(?![\w:]))|(?P<bnode>_:[\w.-]*\w)|(?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w%](?:[\w%.:-]*[\w%:-])?)?)|(?P<bool>(?:true|false)\b)|(?P<a>a(?=[\s<\[]))|(?P<mark>[\[\](),;.])"""
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([\s\S]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "'": "'"}


class TurtleError(ValueError):
    pass


class Turtle:
    """Recursive descent over the subset that ontologies use; lists flatten to one member triple per item of a list node."""

    def __init__(self, text: str, where: str = "b"):
        self.tokens = list(self._scan(text))
        self.at, self.prefixes, self.base, self.out, self.blank, self.where = 0, {}, "", [], 0, where

    @staticmethod
    def _scan(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: cannot read {text[at : at + 30]!r}")
            if m.lastgroup != "ws":
                yield m.lastgroup, m[0]
            at = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def expect(self, mark: str) -> None:
        if self.next()[1] != mark:
            raise TurtleError(f"expected {mark!r} before {' '.join(x for _, x in self.tokens[self.at : self.at + 5])!r}")

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            if self.peek()[0] == "word":
                word = self.next()[1]
                if word.lower().endswith("base"):
                    self.base = urljoin(self.base, self.next()[1][1:-1])
                else:
                    name, iri = self.next()[1], self.next()[1]
                    self.prefixes[name] = urljoin(self.base, iri[1:-1])
                if word.startswith("@"):
                    self.expect(".")
            else:
                kind, text = self.peek()
                subject = self.term()[0]
                if not (text == "[" and self.peek()[1] == "."):
                    self.properties(subject, ".")
                self.expect(".")
        return self.out

    def properties(self, subject: str, end: str) -> None:
        while self.peek()[1] != end:
            kind, text = self.peek()
            if text == ";":
                self.next()
                continue
            if kind == "a":
                self.next()
                predicate = RDF + "type"
            else:
                predicate = self.term()[0]
            while True:
                self.out.append((subject, predicate, *self.term()))
                if self.peek()[1] != ",":
                    break
                self.next()

    def fresh(self) -> str:
        self.blank += 1
        return f"_:{self.where}{self.blank}"

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.next()
        if kind == "iri":
            return urljoin(self.base, text[1:-1]) if self.base else text[1:-1], "iri", None, None
        if kind == "name":
            prefix, _, local = text.partition(":")
            if f"{prefix}:" not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[f"{prefix}:"] + local, "iri", None, None
        if kind == "bnode":
            return f"_:{self.where}-{text[2:]}", "bnode", None, None
        if kind == "string":
            edge = 3 if text[:3] in ('"""', "'''") else 1
            value = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text[edge:-edge])
            if self.peek()[0] == "lang":
                return value, "literal", None, self.next()[1][1:]
            if self.peek()[0] == "dtype":
                self.next()
                return value, "literal", self.term()[0], None
            return value, "literal", XSD + "string", None
        if kind == "number":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if kind == "bool":
            return text, "literal", XSD + "boolean", None
        if text == "[":
            node = self.fresh()
            self.properties(node, "]")
            self.expect("]")
            return node, "bnode", None, None
        if text == "(":
            node = self.fresh()
            while self.peek()[1] != ")":
                self.out.append((node, RDF + "member", *self.term()))
            self.expect(")")
            return node, "bnode", None, None
        raise TurtleError(f"unexpected {text!r}")


#: Predicates whose object is a list: the list's members become their objects.
FLATTEN = tuple(f"http://www.w3.org/2002/07/owl#{x}" for x in ("members", "unionOf", "intersectionOf", "oneOf")) + ("http://www.w3.org/ns/shacl#alternativePath", "http://www.w3.org/ns/shacl#in")


def parse_turtle(text: str, where: str = "b") -> list[tuple]:
    """(s, p, o, o_kind, datatype, lang) rows of a Turtle text; raises TurtleError on what it does not know."""
    return _flattened(Turtle(text, where).parse())


def _flattened(rows: list[tuple]) -> list[tuple]:
    members: dict[str, list[tuple]] = {}
    for s, p, *o in rows:
        if p == RDF + "member":
            members.setdefault(s, []).append(tuple(o))
    unions = {s: members[o[0]] for s, p, *o in rows if p.endswith("#unionOf") and o[0] in members}
    out = []
    for s, p, *o in rows:
        if p == RDF + "member":
            continue
        if p in FLATTEN and o[0] in members:
            out += [(s, p, *m) for m in members[o[0]]]
        elif o[0] in unions and p.startswith("http://www.w3.org/2000/01/rdf-schema#"):
            out += [(s, p, *m) for m in unions[o[0]]]  # a union as domain or range counts as each of its classes
        else:
            out.append((s, p, *o))
    return out


def turtle_string(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_turtle(text), TRIPLE).dropDuplicates()


#: Formats by file suffix.
SUFFIXES = {"ttl": "turtle", "turtle": "turtle", "nt": "turtle", "n3": "turtle", "rdf": "xml", "owl": "xml", "xml": "xml", "jsonld": "json-ld", "json": "json-ld"}


def parse_rdf(text: str, format: str, where: str = "b") -> list[tuple]:
    """Rows of a text in "turtle" (N-Triples included), "xml" or "json-ld", lists flattened as in ``parse_turtle``."""
    parsers = {"turtle": lambda: Turtle(text, where).parse(), "xml": lambda: parse_rdfxml(text, where), "json-ld": lambda: parse_jsonld(text, where)}
    if format not in parsers:
        raise ValueError(f"unknown RDF format {format!r}")
    return _flattened(parsers[format]())


def _files(spark: SparkSession, path: str, glob: str, format: str | None) -> DataFrame:
    """(path, error) of files that cannot be read and rows of the others, one task per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        names = ["s", "p", "o", "o_kind", "datatype", "lang"]
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    kind = format or SUFFIXES.get(p.rsplit(".", 1)[-1].lower(), "turtle")
                    out = pd.DataFrame(parse_rdf(bytes(c).decode("utf-8"), kind, f"f{zlib.crc32(p.encode())}x"), columns=names)
                    out["error"] = None
                except ValueError as e:  # what a parser refuses, and bytes that are no UTF-8
                    out = pd.DataFrame([[None] * 6 + [f"{type(e).__name__}: {e}"]], columns=[*names, "error"])
                out["path"] = p
                yield out

    return files.mapInPandas(run, f"{TRIPLE}, error string, path string")


def read_rdf(spark: SparkSession, path: str, glob: str = "*", format: str | None = None, bad: str = "raise") -> DataFrame:
    """RDF files (path, folder or glob), the format by suffix unless given. A file that cannot be read raises ValueError with its
    path, or is left out with ``bad="skip"``; ``rdf_errors`` lists such files."""
    rows = _files(spark, path, glob, format)
    if bad == "raise":
        said = F.raise_error(F.concat_ws(": ", F.lit("cannot read RDF"), "path", "error"))
        rows = rows.withColumn("s", F.when(F.col("error").isNull(), F.col("s")).otherwise(said))
    return rows.filter("s is not null").select("s", "p", "o", "o_kind", "datatype", "lang").dropDuplicates()


def rdf_errors(spark: SparkSession, path: str, glob: str = "*", format: str | None = None) -> DataFrame:
    """(path, error) of the files that ``read_rdf`` cannot read."""
    return _files(spark, path, glob, format).filter("error is not null").select("path", "error")


def read_turtle(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Turtle files; one that cannot be read is left out unless ``strict`` (see ``rdf_errors``)."""
    return read_rdf(spark, path, "*.ttl", "turtle", "raise" if strict else "skip")


def load_ontology(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """Triples as they are, or from a path: N-Triples by line, folders and other files by their suffixes."""
    if isinstance(source, DataFrame):
        return source.select("s", "p", "o", "o_kind", "datatype", "lang")
    return read_ntriples(spark, source) if source.endswith(".nt") else read_rdf(spark, source)


def load_defaults(spark: SparkSession, sources: list[DataFrame | str], aliases: DataFrame | None = None) -> DataFrame:
    """Several ontologies in one, each predicate again under its alias(src, dst), until no alias gives anything new."""
    out = load_ontology(spark, sources[0])
    for source in sources[1:]:
        out = out.unionByName(load_ontology(spark, source))
    if aliases is None:
        return out.dropDuplicates()
    # Aliases of aliases: a rule table is small, its closure smaller still.
    rules = {(r.src, r.dst) for r in aliases.select("src", "dst").collect()}
    while new := {(a, d) for a, b in rules for c, d in rules if b == c} - rules:
        rules |= new
    return derive(out, spark.createDataFrame(sorted(rules), "src string, dst string"))


class TurtleSource(DataSource):
    """spark.read.format("turtle").load(local file): the same rows through the DataSource API, for small local files."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return TRIPLE

    def reader(self, schema) -> DataSourceReader:
        return _TurtleReader(self.options["path"])


class _TurtleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            yield from parse_turtle(f.read())


def ntriples_line(s: Column, p: Column, o: Column, o_kind: Column, datatype: Column, lang: Column) -> Column:
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.replace(F.replace(F.replace(o, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull() & (datatype != XSD + "string"), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    value = F.when(o_kind == "literal", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(node(o))
    return F.concat_ws(" ", node(s), node(p), value, F.lit("."))


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(ntriples_line(*(F.col(c) for c in ("s", "p", "o", "o_kind", "datatype", "lang"))).alias("value")).write.text(path)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples, split by line."""
    line = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
    raw = spark.read.text(path).filter(F.col("value").rlike(line))
    g = lambda i: F.nullif(F.regexp_extract("value", line, i), F.lit(""))
    literal = F.replace(F.replace(F.replace(F.regexp_extract("value", line, 6), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    is_literal = g(4).isNull() & g(5).isNull()
    kind = F.when(is_literal, "literal").when(g(4).isNotNull(), "iri").otherwise("bnode")
    return raw.select(F.coalesce(g(1), g(2)).alias("s"), g(3).alias("p"), F.when(is_literal, literal).otherwise(F.coalesce(g(4), g(5))).alias("o"), kind.alias("o_kind"), F.when(is_literal & g(7).isNull(), F.coalesce(g(8), F.lit(XSD + "string"))).alias("datatype"), g(7).alias("lang"))


def derive(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triples and, for aliases(src, dst), each again under the alias of its predicate."""
    more = triples.join(F.broadcast(aliases), F.col("p") == F.col("src")).select("s", F.col("dst").alias("p"), "o", "o_kind", "datatype", "lang")
    return triples.unionByName(more).dropDuplicates()


def emitted_to_rdf(emitted: DataFrame, namespace: str = "urn:strataweave:id/") -> DataFrame:
    """Emitted triples as RDF: subjects and links get IRIs, literals a datatype by their shape."""
    from strataweave.operators.ontology import typed_literal

    slug = lambda c: F.when(c.rlike("^(https?|urn):"), c).otherwise(F.concat(F.lit(namespace), F.url_encode(c)))
    is_iri = F.col("object").rlike("^(https?|urn):") | (F.col("method") == "Schema-Driven-SubjectLink")
    return emitted.select(slug(F.col("subject")).alias("s"), F.col("predicate").alias("p"), F.when(is_iri, slug(F.col("object"))).otherwise(F.col("object")).alias("o"), F.when(is_iri, "iri").otherwise("literal").alias("o_kind"), F.when(~is_iri, typed_literal(F.col("object"))).alias("datatype"), F.lit(None).cast("string").alias("lang"))


def enrich(edges: DataFrame, labels: DataFrame, namespace: str, language: str = "en") -> DataFrame:
    """Mesh edges(s, p, o, quantity) and labels(iri, label, type) as RDF.

    An edge with a quantity goes through a blank node that holds the item and the amount; one without goes straight. Every
    node gets its type and its label with a language tag. ``namespace`` makes predicates and types IRIs. Projections and
    one explode: nothing is shuffled but for the last distinct.
    """
    none = F.lit(None).cast("string")
    term = lambda c: F.when(c.contains(":"), c).otherwise(F.concat(F.lit(namespace), c))
    row = lambda s, p, o, kind, datatype=none, lang=none: F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("datatype"), lang.alias("lang"))
    node = F.concat(F.lit("_:q"), F.lower(F.hex(F.xxhash64("s", "p", "o", "quantity"))))
    whole = F.col("quantity") == F.floor("quantity")
    amount = F.when(whole, F.col("quantity").cast("long").cast("string")).otherwise(F.col("quantity").cast("string"))
    typed = F.when(whole, XSD + "integer").otherwise(XSD + "double")
    through = F.array(row(F.col("s"), term(F.col("p")), node, "bnode"), row(node, F.lit(namespace + "item"), F.col("o"), "iri"), row(node, F.lit(namespace + "quantity"), amount, "literal", typed))
    straight = F.array(row(F.col("s"), term(F.col("p")), F.col("o"), "iri"))
    out = edges.select(F.explode(F.when(F.col("quantity").isNotNull(), through).otherwise(straight)).alias("t")).select("t.*")
    said = F.array(row(F.col("iri"), F.lit(RDF + "type"), term(F.col("type")), "iri"), row(F.col("iri"), F.lit(RDFS + "label"), F.col("label"), "literal", none, F.lit(language)))
    return out.unionByName(labels.select(F.explode(said).alias("t")).select("t.*")).distinct()

"""A search index over an ontology's terms: filled from triples, a catalogue, defaults or by hand; saved and loaded as Parquet;
searched by dense and lexical likeness or by stored vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from strataweave.functions.normalize import local_name
from strataweave.operators.ontology import classes, individuals, labels, properties
from strataweave.operators.retrieval import hybrid_search, knn

ITEM = "kind string, iri string, label string, aliases array<string>, types array<string>, description string, parents array<string>, domains array<string>, ranges array<string>"
#: Kinds that count as properties.
RELATIONS = ("ObjectProperty", "DatatypeProperty", "Property")
Embed = Callable[[Column], Column]


def entity_text(kind: Column, iri: Column, label: Column, description: Column, aliases: Column, parents: Column, types: Column, domains: Column, ranges: Column) -> Column:
    """What a term is embedded as: "[kind] label (iri). Description: .. Synonyms: .. Subclass of: .. Type: .. Domain: .. Range: .."
    with the parts it has. A camel-case or underscored label is also spelled out among the (ten at most) synonyms."""
    label, iri, text = F.trim(F.coalesce(label, F.lit(""))), F.trim(F.coalesce(iri, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    spelled = F.trim(F.regexp_replace(F.regexp_replace(label, "([a-z])([A-Z])", "$1 $2"), "_", " "))
    given = F.coalesce(aliases, F.array().cast("array<string>"))
    given = F.when((F.lower(spelled) != F.lower(label)) & ~F.array_contains(given, spelled), F.array_append(given, spelled)).otherwise(given)
    head = F.concat(F.lit("["), kind, F.lit("] "), label, F.when((iri != "") & (F.lower(iri) != F.lower(label)), F.concat(F.lit(" ("), iri, F.lit(")"))).otherwise(""))
    some = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", ")))
    local = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), local_name)
    said = F.when(text != "", F.concat(F.lit("Description: "), text))
    return F.concat(F.concat_ws(". ", head, said, some("Synonyms", F.slice(given, 1, 10)), some("Subclass of", local(parents)), some("Type", local(types)), some("Domain", local(domains)), some("Range", local(ranges))), F.lit("."))


def word_char_embed(text: str, dim: int = 384) -> np.ndarray:
    """Feature hashing by CRC-32 in two halves: words 2 and word pairs 1.5 (over the root of the words' number), then 3- to 5-grams
    of the marked text 1 (over the root of theirs); leading characters 0.25 anywhere. Unit length; blank text is zero."""
    import re

    out, half = np.zeros(dim, np.float64), dim // 2
    s = (text or "").lower().strip()
    if not s:
        return out.astype(np.float32)
    slot = lambda f, n: zlib.crc32(f.encode()) % n
    words = re.findall(r"\b\w+\b", s)
    for feature, weight in [(w, 2.0) for w in words] + [("_".join(p), 1.5) for p in zip(words, words[1:], strict=False)]:
        out[slot(feature, half)] += weight / np.sqrt(len(words))
    marked = f"^{s}$"
    grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(max(1, len(marked) - n + 1))]
    for g in grams:
        out[half + slot(g, dim - half)] += 1 / np.sqrt(len(grams))
    for i, c in enumerate(s[:32]):
        out[(slot(c, 1 << 32) + 31 * i) % dim] += 0.25
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def word_char_embed_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: word_char_embed(x or "").tolist())


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Embed:
    """An embedder around any model: ``load`` runs once per worker and gives a function from texts to rows; batches are Arrow's."""
    held: dict = {}

    @F.pandas_udf(ArrayType(FloatType()))
    def run(s: pd.Series) -> pd.Series:
        if "model" not in held:
            held["model"] = load()
        return pd.Series([np.asarray(v, np.float32).tolist() for v in held["model"](s.fillna("").tolist())], index=s.index)

    return run


# Terms an index has before anything is loaded, as (kind, name, label).
DEFAULT_TERMS = (
    ("Class", "Item", "Item"), ("Class", "CraftingMaterial", "Crafting Material"), ("Class", "PrecursorWeapon", "Precursor Weapon"), ("Class", "LegendaryWeapon", "Legendary Weapon"),
    ("Class", "ComponentItem", "Component Item"), ("Class", "TrophyItem", "Trophy Item"), ("Class", "NPCVendor", "NPC Vendor"), ("Class", "Zone", "Zone"),
    ("Class", "CraftingDiscipline", "Crafting Discipline"), ("Class", "Currency", "Currency"), ("Class", "Recipe", "Recipe"), ("Class", "MysticForgeRecipe", "Mystic Forge Recipe"),
    ("Class", "CollectionTier", "Collection Tier"), ("Class", "CollectionStep", "Collection Step"), ("Class", "IngredientQuantity", "Ingredient Quantity"), ("Class", "DisciplineRating", "Discipline Rating"),
    ("ObjectProperty", "requiresIngredient", "requires ingredient"), ("ObjectProperty", "outputItem", "output item"), ("ObjectProperty", "craftedByDiscipline", "crafted by discipline"), ("ObjectProperty", "obtainedFromVendor", "obtained from vendor"),
    ("ObjectProperty", "locatedInZone", "located in zone"), ("ObjectProperty", "precursorTo", "precursor to"), ("ObjectProperty", "costsCurrency", "costs currency"), ("ObjectProperty", "upgradesTo", "upgrades to"),
    ("DatatypeProperty", "minRating", "min rating"), ("DatatypeProperty", "ingredientQuantity", "ingredient quantity"),
)


def _items(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of ITEM from the given columns; arrays that are not given are empty."""
    fields = [f.split() for f in ITEM.split(", ")]
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    return df.select(*((columns[n].cast(k) if n in columns else empty(k)).alias(n) for n, k in fields))


@dataclass(frozen=True)
class SearchIndex:
    """Terms (rows of ITEM, one per kind and iri: the first one added stays) and how they are embedded."""

    items: DataFrame
    embed: Embed = word_char_embed_udf

    @classmethod
    def empty(cls, spark: SparkSession, embed: Embed = word_char_embed_udf) -> SearchIndex:
        return cls(spark.createDataFrame([], ITEM), embed)

    def add(self, more: DataFrame) -> SearchIndex:
        here = self.items.withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1)))
        fields = [f.split()[0] for f in ITEM.split(", ")]
        one = here.groupBy("kind", "iri").agg(F.min_by(F.struct(*fields), F.struct("_n", "label", F.xxhash64(*fields[2:]))).alias("x")).select("x.*")
        return replace(self, items=one)

    def add_item(self, kind: str, iri: str, label: str, aliases: tuple[str, ...] = (), types: tuple[str, ...] = (), description: str | None = None, parents: tuple[str, ...] = (), domains: tuple[str, ...] = (), ranges: tuple[str, ...] = ()) -> SearchIndex:
        """One term by hand: an entity (kind Individual), a class, or a property."""
        row = (kind, iri, label, list(aliases), list(types), description, list(parents), list(domains), list(ranges))
        return self.add(self.items.sparkSession.createDataFrame([row], ITEM))

    def add_defaults(self, namespace: str) -> SearchIndex:
        rows = [(k, namespace + n, label, [], [], None, [], [], []) for k, n, label in DEFAULT_TERMS]
        return self.add(self.items.sparkSession.createDataFrame(rows, ITEM))

    def add_catalog(self, catalog: DataFrame) -> SearchIndex:
        """catalog(uri, type, label, alt_labels), as from ``ontology.entity_catalog``."""
        return self.add(_items(catalog, kind=F.lit("Individual"), iri=F.col("uri"), label=F.col("label"), aliases=F.col("alt_labels"), types=F.array("type")))

    def add_ontology(self, triples: DataFrame) -> SearchIndex:
        """Classes, properties and typed individuals of an ontology."""
        known = classes(triples)
        found = _items(known, kind=F.lit("Class"), iri=F.col("uri"), label=F.col("label"), aliases=F.col("alt_labels"), types=F.array("uri"), description=F.col("comment"), parents=F.col("super_classes"))
        props = _items(properties(triples), kind=F.col("property_type"), iri=F.col("uri"), label=F.col("label"), aliases=F.col("alt_labels"), description=F.col("comment"), domains=F.col("domains"), ranges=F.col("ranges"))
        typed = individuals(triples).groupBy("uri").agg(F.array_sort(F.collect_set("type")).alias("types"))
        people = typed.join(labels(triples), "uri")
        people = _items(people, kind=F.lit("Individual"), iri=F.col("uri"), label=F.col("label"), aliases=F.col("alt_labels"), types=F.col("types"), description=F.col("comment"))
        return self.add(found.unionByName(props).unionByName(people))

    def texts(self) -> DataFrame:
        """(kind, iri, label, text): what each term is embedded as."""
        return self.items.select("kind", "iri", "label", entity_text(*(F.col(c) for c in ("kind", "iri", "label", "description", "aliases", "parents", "types", "domains", "ranges"))).alias("text"))

    def save(self, path: str) -> None:
        """Terms with their vectors, as Parquet."""
        vectors = self.texts().select("kind", "iri", self.embed(F.col("text")).alias("vec"))
        self.items.join(vectors, ["kind", "iri"]).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embed: Embed = word_char_embed_udf) -> SearchIndex:
        return cls(spark.read.parquet(path), embed)

    # ---- hybrid search by spelling and meaning

    def search(self, queries: DataFrame, top_k: int = 10, type_filter: str | None = None) -> DataFrame:
        """Entities for queries(query); see ``retrieval.hybrid_search``."""
        return hybrid_search(queries, self.items.filter("kind = 'Individual'"), top_k, type_filter)

    search_entities = search

    def search_classes(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        return hybrid_search(queries, self.items.filter("kind = 'Class'").withColumn("types", F.array("iri")), top_k)

    def search_properties(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        found = self.items.filter(F.col("kind").isin(*RELATIONS)).withColumn("types", F.array().cast("array<string>"))
        return hybrid_search(queries, found, top_k)

    # ---- search by vectors alone

    def nearest(self, queries: DataFrame, top_k: int = 10, kinds: tuple[str, ...] = ()) -> DataFrame:
        """queries(query) -> (query, rank, iri, label, kind, score): terms whose text lies nearest, of the given kinds."""
        items = self.items if "vec" in self.items.columns else self.items.join(self.texts().select("kind", "iri", self.embed(F.col("text")).alias("vec")), ["kind", "iri"])
        items = items.filter(F.col("kind").isin(*kinds)) if kinds else items
        items = items.select(F.xxhash64("kind", "iri").alias("id"), "iri", "label", "kind", "vec")
        asked = queries.select("query").distinct().filter(F.trim("query") != "").select(F.xxhash64("query").alias("qid"), "query", self.embed(F.col("query")).alias("qvec"))
        hits = knn(items, asked, top_k)
        return hits.join(items.drop("vec"), "id").join(asked.select("qid", "query"), "qid").select("query", "rank", "iri", "label", "kind", "score")

    def search_concept(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.nearest(queries, top_k)

    def search_class(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.nearest(queries, top_k, ("Class",))

    def search_relation(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.nearest(queries, top_k, RELATIONS)

    def search_object_property(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.nearest(queries, top_k, ("ObjectProperty",))

    def search_datatype_property(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.nearest(queries, top_k, ("DatatypeProperty",))

    def search_individual(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.nearest(queries, top_k, ("Individual",))

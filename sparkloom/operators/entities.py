"""Merging records of one entity, and small property graphs as tables."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import written


def match_key(*keys: Column) -> Column:
    """The first key that is neither null nor blank, marked with its place so that keys of different kinds never meet."""
    return F.coalesce(*[F.when(F.trim(k) != "", F.concat(F.lit(f"{i}:"), F.trim(k))) for i, k in enumerate(keys)])


def merge_entities(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: how many rows, and of each field the first non-blank value by `order` and whether values conflict.

    Partial aggregates only; no group is gathered. Rows with a null key stay alone and come out as they are.
    """
    good = lambda f: F.when(F.trim(f) != "", F.trim(f))
    picks = [F.min_by(good(f), F.when(good(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    clashes = [F.coalesce(F.min(good(f)) != F.max(good(f)), F.lit(False)).alias(f"{f}_conflict") for f in fields]
    return df.groupBy(F.coalesce(F.col(key), F.concat(F.lit("row:"), F.col(order).cast("string"))).alias(key)).agg(F.count(F.lit(1)).alias("copies"), *picks, *clashes)


def dominant_variant(df: DataFrame, key: str, variant: str, amount: str, name: str) -> DataFrame:
    """(key, name): of each key the variant with the largest sum, then the most rows, then the smallest text.

    Sums by key and variant, then a partial maximum; blank variants and null keys take no part, null amounts count as 0.
    """
    sums = df.where((F.trim(variant) != "") & F.col(key).isNotNull()).groupBy(key, variant).agg(F.sum(F.coalesce(amount, F.lit(0))).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return sums.groupBy(key).agg(F.min_by(variant, F.struct(-F.col("_sum"), -F.col("_n"), variant)).alias(name))


def resolve_terms(terms: DataFrame, nodes: DataFrame, prefix: str, preferred: str) -> DataFrame:
    """(term, id): each distinct term's node, null if none: the id itself, else prefix + term, else a label in any case.

    terms has `term`; nodes has `id` (unique), `type`, `label`. Of nodes with the same label one of the preferred
    type wins, then the smallest id. Candidates are met by equality and ranked by a partial minimum.
    """
    asked = terms.select("term", F.trim("term").alias("_t")).where(F.col("_t") != "").distinct()
    ways = [(F.col("_t"), F.col("id"), F.lit(0)), (F.concat(F.lit(prefix), "_t"), F.col("id"), F.lit(1)), (F.lower("_t"), F.lower("label"), F.when(F.col("type") == preferred, 2).otherwise(3))]
    tried = reduce(DataFrame.unionByName, [asked.withColumn("_k", wanted).join(nodes.withColumn("_k", has), "_k").select("term", rank.alias("_rank"), "id") for wanted, has, rank in ways])
    best = tried.groupBy("term").agg(F.min(F.struct("_rank", "id"))["id"].alias("id"))
    return asked.select("term").distinct().join(best, "term", "left")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, rel, other, direction): each edge seen from both of its ends."""
    out = edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), "rel", F.col("src").alias("other"), F.lit("in").alias("direction")))


def distances(edges: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(id, distance) of all nodes reached from start over undirected edges, breadth first.

    Each round joins only the newest ring with the edges and is written to the shared folder; the
    loop ends when a ring is empty. With `most`, a graph that reaches farther is an error, never a cut result.
    """
    both = neighbours(edges).select("id", "other").where(F.col("id").isNotNull() & F.col("other").isNotNull()).distinct()
    both = written(both)
    spark = edges.sparkSession
    rings = [written(spark.createDataFrame([(start, 0)], "id string, distance int"))]
    for step in count(1):
        seen = reduce(DataFrame.unionByName, rings[-2:])
        ring = written(both.join(rings[-1].select("id"), "id").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)))
        if ring.isEmpty():
            break
        if most is not None and step > most:
            raise ValueError(f"nodes farther than {most} steps from {start}")
        rings.append(ring)
    return reduce(DataFrame.unionByName, rings)


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(step, id, rel, direction) from start to goal over undirected edges; no rows if they aren't connected, one if they are the same.

    Breadth first, a ring at a time, until the goal is in a ring or a ring is empty; each node remembers the smallest
    (node, relation, direction) it was reached by, a partial minimum. Then the steps are read back, one row each.
    """
    spark = edges.sparkSession
    schema = "step int, id string, prev string, rel string, direction string"
    around = neighbours(edges).where(F.col("id").isNotNull() & F.col("other").isNotNull())
    both = written(around.repartition("id"))
    rings = [written(spark.createDataFrame([(0, start, None, None, None)], schema))]
    while rings[-1].where(F.col("id") == goal).isEmpty():
        seen = reduce(DataFrame.unionByName, rings[-2:]).select("id")
        met = both.join(rings[-1].select("id"), "id").groupBy(F.col("other").alias("id")).agg(F.min(F.struct(F.col("id").alias("prev"), "rel", "direction")).alias("by"))
        ring = written(met.join(seen, "id", "left_anti").select(F.lit(len(rings)).alias("step"), "id", "by.*"))
        if ring.isEmpty():
            return spark.createDataFrame([], schema).select("step", "id", "rel", "direction")
        rings.append(ring)
    steps, at = [], goal
    for ring in reversed(rings):
        row = ring.where(F.col("id") == at).first()
        steps.append(tuple(row))
        at = row["prev"]
    return spark.createDataFrame(steps, schema).select("step", "id", "rel", "direction")


def slug(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def _is_slug(wanted: Column):  # noqa: ANN202
    return lambda v: slug(v) == wanted


def find(df: DataFrame, equal: dict[str, str], has: dict[str, str], text: list[str], words: str = "") -> DataFrame:
    """Rows whose columns equal and whose lists have the given terms, compared as slugs, and whose text columns together hold `words` in any case.

    Null columns equal nothing, null lists have nothing, null texts are empty.
    """
    term = lambda x: slug(F.lit(x))
    out = F.lit(True)
    for c, x in equal.items():
        out = out & (slug(F.col(c)) == term(x))
    for c, x in has.items():
        wanted = term(x)
        out = out & F.exists(c, _is_slug(wanted))
    if words:
        out = out & F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in text])), F.lit(words.lower()))
    return df.where(out)


def context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, label, link, other, other_type, other_label): every node with its neighbours, by relation and direction."""
    link = F.concat("rel", F.when(F.col("direction") == "out", " ->").otherwise(" <-")).alias("link")
    around = neighbours(edges).select("id", link, "other")
    others = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.col("label").alias("other_label"))
    return nodes.select("id", "type", "label").join(around, "id").join(others, "other").select("id", "type", "label", "link", "other", "other_type", "other_label")


def graph_of_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label) and edges (src, rel, dst), each once, of documents {id, name, nation: {id, name, region: {id, name}}, tags: [...]}.

    A document without an id has no node; missing parts lay down no edge; of labels of one id the smallest counts.
    """
    s, n, r = (F.concat(F.lit(x), F.col(c).cast("string")) for x, c in (("s", "id"), ("n", "nation.id"), ("r", "nation.region.id")))
    tag = F.concat(F.lit("t:"), F.col("tag"))
    tags = docs.select(s.alias("src"), F.explode("tags").alias("tag"))
    ways = [
        docs.select(s.alias("src"), F.lit("in_nation").alias("rel"), n.alias("dst")),
        docs.select(n.alias("src"), F.lit("in_region").alias("rel"), r.alias("dst")),
        tags.select("src", F.lit("tagged").alias("rel"), tag.alias("dst")),
    ]
    kinds = [(s, "supplier", F.col("name")), (n, "nation", F.col("nation.name")), (r, "region", F.col("nation.region.name"))]
    named = [docs.select(i.alias("id"), F.lit(k).alias("type"), label.alias("label")) for i, k, label in kinds] + [tags.select(tag.alias("id"), F.lit("tag").alias("type"), F.col("tag").alias("label"))]
    nodes = reduce(DataFrame.unionByName, named).where(F.col("id").isNotNull()).groupBy("id", "type").agg(F.min("label").alias("label"))
    return nodes, reduce(DataFrame.unionByName, ways).where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables under one place."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def search_score(title: Column, tags: Column, headings: Column, body: Column, term: str) -> Column:
    """Additive score of a search term: whole title, else start of title, else within title; within the tags, the headings, the body."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    t, x = text(title), term.lower()
    points = F.when(t == x, 100).when(t.startswith(x), 60).when(t.contains(x), 40).otherwise(0)
    return reduce(lambda a, b: a + b, [F.when(text(c).contains(x), n).otherwise(0) for c, n in ((tags, 12), (headings, 10), (body, 8))], points)

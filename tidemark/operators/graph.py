"""Triples (rel, head, tail): chains of relations, what they reach, how they score, and rules made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import wilson_lower
from tidemark.operators.cut import cut

ARROW = "→"


def edges(triples: DataFrame) -> DataFrame:
    """Distinct triples without nulls."""
    return triples.select("rel", "head", "tail").where("rel is not null and head is not null and tail is not null").distinct()


def with_inverses(triples: DataFrame) -> DataFrame:
    """Each relation also backwards, as <rel>_inv."""
    return triples.unionByName(triples.select(F.concat("rel", F.lit("_inv")).alias("rel"), F.col("tail").alias("head"), F.col("head").alias("tail")))


def step(frontier: DataFrame, triples: DataFrame, rel: str) -> DataFrame:
    """frontier(source, node) moved along a relation, distinct."""
    hop = triples.where(F.col("rel") == rel).select(F.col("head").alias("node"), "tail")
    return frontier.join(hop, "node").select("source", F.col("tail").alias("node")).distinct()


def reach(triples: DataFrame, sources: DataFrame, chains: list[tuple[str, ...]]) -> dict[tuple[str, ...], DataFrame]:
    """For each chain its distinct (source, node); a prefix that several need is computed once and written out. sources has a column source."""
    done: dict[tuple[str, ...], DataFrame] = {(): sources.select("source", F.col("source").alias("node")).distinct()}
    prefixes = {c[:k] for c in chains for k in range(1, len(c) + 1)}
    for p in sorted(prefixes, key=len):
        found = step(done[p[:-1]], triples, p[-1])
        uses = (p in chains) + sum(q[:-1] == p for q in prefixes)
        done[p] = cut(found) if uses > 1 else found
    return {c: done[c] for c in chains}


def name(chain: tuple[str, ...]) -> str:
    return ARROW.join(chain)


def reach_counts(triples: DataFrame, sources: DataFrame, chains: list[tuple[str, ...]]) -> DataFrame:
    """source, chain, n: distinct nodes reached, where there are any."""
    parts = [f.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.lit(name(c)).alias("chain"), "n") for c, f in reach(triples, sources, chains).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def features(triples: DataFrame, sources: DataFrame, chains: list[tuple[str, ...]], binary: bool = False) -> DataFrame:
    """source and one column a chain with the number of nodes reached (or 0/1), 0 without any."""
    counts = reach_counts(triples, sources, chains)
    value = F.max(F.when(F.col("n") > 0, 1) if binary else F.col("n"))
    wide = counts.groupBy("source").pivot("chain", [name(c) for c in chains]).agg(value)
    return sources.select("source").distinct().join(wide, "source", "left").na.fill(0, [name(c) for c in chains])


def observed_chains(triples: DataFrame, sources: DataFrame, longest: int) -> DataFrame:
    """chain, source, n of every relation chain up to a length that reaches something, grown level by level."""
    hop = triples.select(F.col("head").alias("node"), "rel", "tail")
    now = sources.select("source", F.col("source").alias("node"), F.lit("").alias("chain")).distinct()
    out = None
    for _ in range(longest):
        label = F.when(F.col("chain") == "", F.col("rel")).otherwise(F.concat("chain", F.lit(ARROW), "rel"))
        now = cut(now.join(hop, "node").select("source", F.col("tail").alias("node"), label.alias("chain")).distinct())
        counts = now.groupBy("chain", "source").agg(F.count(F.lit(1)).alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out


def scored_chains(counts: DataFrame, sources: DataFrame, most: int, discriminative: bool = True) -> DataFrame:
    """chain, distinct_counts, non_zero, rank of the best chains; sources that a chain does not reach count as 0.

    Discriminative: constant chains go; ranked by falling distinct counts, falling non-zero, name. Else by non-zero, name.
    """
    n = F.broadcast(sources.select("source").distinct().agg(F.count(F.lit(1)).alias("N")))
    per = counts.groupBy("chain").agg(F.count_distinct("n").alias("d"), F.count(F.lit(1)).alias("non_zero")).crossJoin(n)
    scored = per.select("chain", (F.col("d") + (F.col("non_zero") < F.col("N")).cast("long")).alias("distinct_counts"), "non_zero")
    if discriminative:
        scored = scored.where("distinct_counts > 1")
        order = [F.desc("distinct_counts"), F.desc("non_zero"), F.col("chain")]
    else:
        order = [F.desc("non_zero"), F.col("chain")]
    best = scored.orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `most` rows


def promoted(triples: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """triples with a chain's pairs as one new relation, @r1→r2."""
    heads = triples.where(F.col("rel") == chain[0]).select(F.col("head").alias("source"))
    pairs = reach(triples, heads, [chain])[chain]
    return triples.unionByName(pairs.select(F.lit("@" + name(chain)).alias("rel"), F.col("source").alias("head"), F.col("node").alias("tail")))


def meet_in_the_middle(triples: DataFrame, sources: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """source, n like reach_counts for one chain, from its two halves met at their middle nodes."""
    k = len(chain) // 2
    first = reach(triples, sources, [chain[:k]])[chain[:k]] if k else sources.select("source", F.col("source").alias("node"))
    starts = triples.where(F.col("rel") == chain[k]).select(F.col("head").alias("source"))
    second = reach(triples, starts, [chain[k:]])[chain[k:]].select(F.col("source").alias("node"), F.col("node").alias("end"))
    return first.join(second, "node").groupBy("source").agg(F.count_distinct("end").alias("n"))


def path_counts(triples: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """chain, paths: number of relation paths (not distinct ends) that link the given (head, tail) pairs.

    Paths go on only at nodes from which a tail can be reached in the steps left, and the last step is a join on both its ends.
    """
    hop = triples.select(F.col("head").alias("node"), "rel", F.col("tail").alias("next"))
    to = lambda nodes: hop.join(nodes.select(F.col("node").alias("__to")), F.col("next") == F.col("__to"), "left_semi")
    near = [cut(pairs.select(F.col("tail").alias("node")).distinct())]  # near[j]: a tail is j steps away
    for _ in range(longest - 1):
        near.append(cut(to(near[-1]).select("node").distinct()))
    now = cut(pairs.select("head", "tail", F.col("head").alias("node"), F.lit("").alias("chain"), F.lit(1).cast("long").alias("paths")))
    label = F.when(F.col("chain") == "", F.col("rel")).otherwise(F.concat("chain", F.lit(ARROW), "rel")).alias("chain")
    out = None
    for k in range(1, longest + 1):
        last = to(near[0]).withColumnRenamed("next", "tail")
        hit = now.join(last, ["node", "tail"]).groupBy(label).agg(F.sum("paths").alias("paths"))
        out = hit if out is None else out.unionByName(hit)
        if k < longest:
            useful = near[1]
            for x in near[2 : longest - k + 1]:
                useful = useful.unionByName(x)
            now = cut(now.join(to(useful), "node").groupBy("head", "tail", F.col("next").alias("node"), label).agg(F.sum("paths").alias("paths")))
    return out


def chain_quality(triples: DataFrame, chains: list[tuple[str, ...]], positives: DataFrame) -> DataFrame:
    """chain, derived, hits, precision, recall of each chain's pairs against positives(head, tail)."""
    total = F.broadcast(positives.select("head", "tail").distinct().agg(F.count(F.lit(1)).alias("P")))
    heads = triples.where(F.col("rel").isin(sorted({c[0] for c in chains}))).select(F.col("head").alias("source")).distinct()
    parts = []
    for c, pairs in reach(triples, heads, chains).items():
        marked = pairs.join(positives.select(F.col("head").alias("source"), F.col("tail").alias("node"), F.lit(1).alias("hit")).distinct(), ["source", "node"], "left")
        parts.append(marked.agg(F.count(F.lit(1)).alias("derived"), F.count("hit").alias("hits")).select(F.lit(name(c)).alias("chain"), "derived", "hits"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.crossJoin(total).select("chain", "derived", "hits", F.coalesce(F.try_divide("hits", "derived"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hits", "P"), F.lit(0.0)).alias("recall"))


def induced_rules(triples: DataFrame, target: str, longest: int = 2, candidates: int = 40, precision: float = 0.7, support: int = 8, recall: float = 0.1, most: int = 3) -> DataFrame:
    """rank, chain, derived, hits, precision, recall of the best chain rules for a relation, from its most frequent bodies."""
    positives = triples.where(F.col("rel") == target).select("head", "tail").distinct()
    base = triples.where(~F.col("rel").isin(target, f"{target}_inv"))
    found = path_counts(base, positives, longest).orderBy(F.desc("paths"), "chain").limit(candidates).collect()
    if not found:
        return triples.sparkSession.createDataFrame([], "rank int, chain string, derived long, hits long, precision double, recall double")
    quality = chain_quality(base, [tuple(r["chain"].split(ARROW)) for r in found], positives)
    kept = quality.where((F.col("precision") >= precision) & (F.col("hits") >= support) & (F.col("recall") >= recall))
    order = [F.desc("precision"), F.desc("recall"), F.col("chain")]
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= most)  # `candidates` rows at most


def derive_certified(triples: DataFrame, rules: list[tuple[tuple[str, ...], int, int]], sources: DataFrame) -> DataFrame:
    """source, tail, chain, confidence: each derived tail with the rule of the largest Wilson lower bound of hits in derived."""
    pairs = None
    for (chain, hits, derived), (_, found) in zip(rules, reach(triples, sources, [r[0] for r in rules]).items(), strict=True):
        part = found.select("source", F.col("node").alias("tail"), F.lit(name(chain)).alias("chain"), wilson_lower(F.lit(float(hits)), F.lit(float(derived))).alias("confidence"))
        pairs = part if pairs is None else pairs.unionByName(part)
    best = pairs.groupBy("source", "tail").agg(F.min_by(F.struct("chain", "confidence"), F.struct(-F.col("confidence"), F.col("chain"))).alias("b"))
    return best.select("source", "tail", "b.chain", "b.confidence")


def neighbourhood(triples: DataFrame, sources: DataFrame, rels: list[str], depth: int) -> DataFrame:
    """node, depth: nodes within so many steps of any source along the relations, with their least depth."""
    hop = triples.where(F.col("rel").isin(rels)).select(F.col("head").alias("node"), "tail")
    seen = frontier = cut(sources.select(F.col("source").alias("node"), F.lit(0).alias("depth")).distinct())
    for k in range(1, depth + 1):
        frontier = cut(frontier.join(hop, "node").select(F.col("tail").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def dictionary(triples: DataFrame) -> DataFrame:
    """node, id: dense ids of all nodes by name, dealt out by ranges of like sizes."""
    from tidemark.operators.prefix import numbered

    nodes = triples.select(F.explode(F.array("head", "tail")).alias("node")).distinct()
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(nodes.repartitionByRange(parts, "node").withColumn("__range", F.spark_partition_id()))  # written, so that the ranges stay what they are
    return numbered(ranged, [F.col("node")], F.col("__range"), "id").drop("__range")

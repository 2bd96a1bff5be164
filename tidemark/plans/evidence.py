"""Queries of contingency evidence, splits, phrases and neighbour votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.special import bernoulli_bits
from tidemark.operators import evidence as V
from tidemark.operators import phrases as P
from tidemark.plans.registry import load, query

_LINES_SQL = "l AS (SELECT l_returnflag AS flag, l_linestatus AS status, (l_quantity > 25)::VARCHAR AS big, (l_linenumber + l_orderkey) % 3 AS c FROM lineitem)"
_FAMILIES = [("flag",), ("status",), ("big",), ("flag", "status"), ("flag", "big"), ("flag", "status", "big")]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") > 25).cast("string").alias("big"), F.pmod(F.col("l_linenumber") + F.col("l_orderkey"), F.lit(3)).alias("c"))


def _counts_sql() -> str:
    parts = [f"SELECT '{'*'.join(f)}' AS family, concat_ws('/', {', '.join(f)}) AS levels, c AS class, count(*) AS n FROM l GROUP BY {', '.join(f)}, c" for f in _FAMILIES]
    return f"WITH {_LINES_SQL}, t AS ({' UNION ALL '.join(parts)}), pi AS (SELECT c AS class, count(*) / (SELECT count(*) FROM l)::DOUBLE AS prior FROM l GROUP BY c)"


@query(_counts_sql() + " SELECT * FROM t")
def contingency_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG14, AG37: class counts of several column families in one pass."""
    return V.contingency(_lines(spark, sf_dir), _FAMILIES, "c").withColumn("levels", F.array_join("levels", "/"))


@query(_counts_sql() + ", j AS (SELECT *, n / sum(n) OVER (PARTITION BY family) AS joint, sum(n) OVER (PARTITION BY family, levels) / sum(n) OVER (PARTITION BY family) AS support FROM t) SELECT family, round(sum(joint * ln(joint / (support * prior))), 9) + 0.0 AS information FROM j JOIN pi USING (class) GROUP BY family")
def mi_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15: mutual information of each family, with the prior of all rows."""
    lines = _lines(spark, sf_dir)
    return V.information(V.contingency(lines, _FAMILIES, "c"), V.class_prior(lines, "c")).select("family", (F.round("information", 9) + 0.0).alias("information"))


_POSTERIOR_SQL = _counts_sql() + ", k AS (SELECT family, levels, sum(n) AS support FROM t GROUP BY ALL), p AS (SELECT family, levels, class, coalesce(n, 0) AS n, support, prior, (coalesce(n, 0) + 3 * prior) / (support + 3) AS posterior FROM k CROSS JOIN pi LEFT JOIN t USING (family, levels, class) WHERE support >= 3)"


@query(_POSTERIOR_SQL + " SELECT family, levels, class, n, support::BIGINT AS support, round(posterior, 9) AS posterior FROM p")
def dirichlet_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, AG19: smoothed class posteriors of every level tuple."""
    lines = _lines(spark, sf_dir)
    out = V.posteriors(V.contingency(lines, _FAMILIES, "c"), V.class_prior(lines, "c"))
    return out.select("family", F.array_join("levels", "/").alias("levels"), "class", "n", "support", F.round("posterior", 9).alias("posterior"))


@query(_POSTERIOR_SQL + """, s AS (SELECT f.levels AS flag, b.levels AS big, f.class, f.prior, ln(f.prior) + ln(f.posterior) - ln(f.prior) + ln(b.posterior) - ln(b.prior) AS z FROM p f JOIN p b ON b.class = f.class AND b.family = 'big' WHERE f.family = 'flag'),
q AS (SELECT flag, big, class, exp(z) / sum(exp(z)) OVER (PARTITION BY flag, big) AS shrink FROM s), h AS (SELECT q.*, coalesce(t.n, 0) AS n, sum(coalesce(t.n, 0)) OVER (PARTITION BY flag, big) AS support FROM q LEFT JOIN t ON t.family = 'flag*big' AND t.levels = flag || '/' || big AND t.class = q.class)
SELECT flag, big, class, round(shrink, 9) AS pooled, round((n + 3 * shrink) / (support + 3), 9) AS posterior FROM h""")
def hierarchical_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20, ML17: a pair's posterior shrunk towards its pooled single-column posteriors."""
    lines = _lines(spark, sf_dir)
    table, prior = V.contingency(lines, _FAMILIES, "c"), V.class_prior(lines, "c")
    single = V.posteriors(table, prior)
    pairs = table.where("family = 'flag*big'").select(F.col("levels")[0].alias("flag"), F.col("levels")[1].alias("big"), "class", "n")
    keys = pairs.select("flag", "big").distinct()
    part = lambda c: keys.join(single.where(F.col("family") == c).select(F.col("levels")[0].alias(c), "class", "prior", "posterior"), c)
    pooled = V.pooled(part("flag").unionByName(part("big")), ["flag", "big"])
    joined = pooled.join(pairs, ["flag", "big", "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    support = F.sum("n").over(Window.partitionBy("flag", "big"))
    return joined.select("flag", "big", "class", F.round("pooled", 9).alias("pooled"), F.round((F.col("n") + 3 * F.col("pooled")) / (support + 3), 9).alias("posterior"))


@query("""
WITH e AS (SELECT event_id, 1 / (1 + exp(-(value - 50) / 50)) AS p, CASE WHEN event_type = 'view' THEN 0.7 ELSE 0.45 END AS q FROM events)
SELECT event_id, round(exp(ln(p) + 0.5 * (ln(q) - ln(0.5))) / (exp(ln(p) + 0.5 * (ln(q) - ln(0.5))) + exp(ln(1 - p) + 0.5 * (ln(1 - q) - ln(0.5)))), 6) AS combined FROM e""")
def posterior_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML19, FN14: a base probability moved by a posterior over its prior."""
    from tidemark.functions.expressions import logistic, softmax

    p, q = logistic((F.col("value") - 50) / 50), F.when(F.col("event_type") == "view", 0.7).otherwise(0.45)
    z = [F.ln(b) + 0.5 * (F.ln(e) - F.ln(F.lit(0.5))) for b, e in ((1 - p, 1 - q), (p, q))]
    return load(spark, sf_dir, "events").select("event_id", F.round(softmax(z)[1], 6).alias("combined"))


_BITS_SQL = "b AS (SELECT event_id, (value > 30)::INT AS b0, (user_id % 2)::INT AS b1, (event_type = 'view')::INT AS b2, (event_id % 3 = 0)::INT AS b3, ((value > 30) <> (user_id % 2 = 1))::INT AS y FROM events)"


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    return load(spark, sf_dir, "events").select("event_id", flag(F.col("value") > 30).alias("b0"), flag(F.col("user_id") % 2).alias("b1"), flag(F.col("event_type") == "view").alias("b2"), flag(F.col("event_id") % 3 == 0).alias("b3"), flag((F.col("value") > 30) != (F.col("user_id") % 2 == 1)).alias("y"))


def _pairs_sql() -> str:
    parts = [f"SELECT 'b{i}' AS a, 'b{j}' AS b, b{i} * 2 + b{j} AS s, y, count(*) AS n FROM b GROUP BY ALL" for i in range(4) for j in range(i + 1, 4)]
    return f"WITH {_BITS_SQL}, t AS ({' UNION ALL '.join(parts)}), j AS (SELECT *, sum(n) OVER (PARTITION BY a, b) AS tot, sum(n) OVER (PARTITION BY a, b, s) AS ns, sum(n) OVER (PARTITION BY a, b, y) AS ny FROM t) SELECT a, b, round(sum(n / tot * ln(n * tot / (ns * ny))), 9) + 0.0 AS information FROM j GROUP BY a, b"


@query(_pairs_sql())
def bit_pair_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: information of all bit pairs about a target that is their exclusive or."""
    return V.bit_pair_information(_bits(spark, sf_dir), "event_id", ["b0", "b1", "b2", "b3"], "y").select("a", "b", (F.round("information", 9) + 0.0).alias("information"))


@query(f"""WITH {_BITS_SQL}, c AS (SELECT b0, b1, y, count(*) AS n FROM b GROUP BY ALL), h AS (SELECT -sum(p * ln(p)) AS before FROM (SELECT count(*) / (SELECT count(*) FROM b)::DOUBLE AS p FROM b GROUP BY y)),
w AS (SELECT -sum(n / (SELECT count(*) FROM b)::DOUBLE * ln(n / s)) AS within FROM (SELECT *, sum(n) OVER (PARTITION BY b0, b1) AS s FROM c)) SELECT round(before - within, 6) AS information FROM h, w""")
def path_partition_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: entropy of the label less its entropy within leaves."""
    return V.partition_information(_bits(spark, sf_dir), ["b0", "b1"], "y").select(F.round("information", 6).alias("information"))


_MASKS = {"b0": "b0 = 1", "xor": "b0 <> b1", "and": "b0 = 1 AND b2 = 1", "none_of": "b1 = 0 AND b2 = 0 AND b3 = 0"}


@query(f"WITH {_BITS_SQL}, m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS predicate, ({s}) AS m, y FROM b" for k, s in _MASKS.items()) + """),
g AS (SELECT predicate, 0.5 * abs(avg(y) FILTER (m) - avg(y) FILTER (NOT m)) AS association, sum(0.5 - y) FILTER (m) AS gl, 0.25 * count(*) FILTER (m) AS hl, sum(0.5 - y) AS gt, 0.25 * count(*) AS ht, count(*) AS n FROM m GROUP BY predicate)
SELECT predicate, round(association, 6) AS association, round(greatest(0.5 * (gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)) / n, 0), 6) AS gain FROM g""")
def predicate_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, AG23: association and Newton gain of predicates."""
    masks = {k: F.expr(s.replace(" = ", " == ")) for k, s in _MASKS.items()}
    b = _bits(spark, sf_dir)
    gains = V.newton_gains(b, masks, 0.5 - F.col("y"), F.lit(0.25))
    return V.association(b, masks, F.col("y")).join(F.broadcast(gains), "predicate").select("predicate", F.round("association", 6).alias("association"), F.round("gain", 6).alias("gain"))  # a row a predicate


@query("WITH t AS (SELECT event_type, sum((value > 50)::INT) AS p, sum((value <= 50)::INT) AS n FROM events GROUP BY event_type) SELECT event_type, round(-(lgamma(p + 0.5) + lgamma(n + 0.5) - lgamma(p + n + 1.0) - ln(pi())) / ln(2), 4) AS bits FROM t")
def bernoulli_codelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24, ML43: bits to code each group's outcomes."""
    t = load(spark, sf_dir, "events").groupBy("event_type").agg(F.sum((F.col("value") > 50).cast("long")).alias("p"), F.sum((F.col("value") <= 50).cast("long")).alias("n"))
    return t.select("event_type", F.round(bernoulli_bits(F.col("p").cast("double"), F.col("n").cast("double")), 4).alias("bits"))


_HIST_SQL = """WITH t AS (SELECT 0 AS node, floor(l_quantity / 5)::INT AS q, floor(l_discount * 100)::INT AS d, (l_returnflag = 'R')::INT * 1.0 - 0.3 AS g FROM lineitem),
u AS (SELECT node, 'd' AS feature, d AS bin, g FROM t UNION ALL SELECT node, 'q', q, g FROM t), h AS (SELECT node, feature, bin, sum(g) AS g, count(*) * 1.0 AS h, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER p AS gt, sum(h) OVER p AS ht, sum(n) OVER p AS nt FROM h WINDOW w AS (PARTITION BY feature ORDER BY bin), p AS (PARTITION BY feature)),
s AS (SELECT feature, bin, gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1) AS gain, nl FROM c WHERE nl >= 20 AND nt - nl >= 20)"""


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.lit(0).alias("node"), F.floor(F.col("l_quantity") / 5).cast("int").alias("q"), F.floor(F.col("l_discount") * 100).cast("int").alias("d"), ((F.col("l_returnflag") == "R").cast("int") * 1.0 - 0.3).alias("g"))


@query(_HIST_SQL + " SELECT feature, bin, round(gain, 6) AS gain, nl::BIGINT AS n_left FROM s")
def split_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25, AG26, ML1: gain of every binned split."""
    return V.split_gains(V.histogram(_binned(spark, sf_dir), "node", ["q", "d"], F.col("g"), F.lit(1.0)), "node", 1.0, 20).select("feature", "bin", F.round("gain", 6).alias("gain"), F.col("nl").alias("n_left"))


@query(_HIST_SQL + " SELECT feature, bin, round(gain, 6) AS gain FROM s ORDER BY round(gain, 9) DESC, feature, bin LIMIT 1")
def hist_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26, ML6: the best binned split, first of equals."""
    return V.best_splits(V.histogram(_binned(spark, sf_dir), "node", ["q", "d"], F.col("g"), F.lit(1.0)), "node").select("feature", "bin", F.round("gain", 6).alias("gain"))


@query("""
WITH g AS (SELECT l_quantity AS x, sum(l_extendedprice / 1000) AS s, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT x, coalesce(sum(s) OVER w, 0) AS ss, coalesce(sum(n) OVER w, 0) AS ns, sum(s) OVER () AS st, sum(n) OVER () AS nt FROM g WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT x AS from_value, round(ss ** 2 / ns + (st - ss) ** 2 / (nt - ns) - st ** 2 / nt, 2) AS gain, ns::BIGINT AS n_left FROM c WHERE ns >= 20 AND nt - ns >= 20""")
def variance_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27, ML39: every exact variance split of a column."""
    t = load(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("r"))
    return V.exact_splits(t, "l_quantity", "r", 20).select("from_value", F.round("gain", 2).alias("gain"), "n_left")


_GRAMS_SQL = """WITH x AS (SELECT d.doc_id, l.quality, 'FF' || hex(encode(d.text)) || 'FE' AS x FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT doc_id, quality, n AS len, substr(x, 2 * i - 1, 2 * n) AS gram FROM (SELECT doc_id, quality, x, n, unnest(range(1, greatest(length(x) // 2 - n + 2, 1)::BIGINT)) AS i FROM x, (SELECT unnest([3, 4, 5]) AS n))),
c AS (SELECT len, gram, quality AS class, count(*) AS n, count(DISTINCT doc_id) AS d FROM g GROUP BY ALL), k AS (SELECT len, gram, class, n, sum(d) OVER (PARTITION BY len, gram) AS df FROM c)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality").hint("shuffle_hash")  # texts are not sorted
    return load(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


@query(_GRAMS_SQL + " SELECT len::INT AS len, gram, class, n, df::BIGINT AS df FROM k")
def byte_ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG34, FN10, FN11: byte n-grams of whole texts by class, with document frequency."""
    counts = P.phrase_counts(P.class_ngrams(_labelled(spark, sf_dir), "text", "quality"), "quality")
    return counts.withColumn("gram", P.shown("len", "gram"))


_WEIGHTS_SQL = _GRAMS_SQL + """, pos AS (SELECT len, count(DISTINCT gram) AS v, sum(n) FILTER (class = 0) AS t0, sum(n) FILTER (class = 1) AS t1 FROM k GROUP BY len),
w AS (SELECT len, gram, max(df) AS df, coalesce(sum(n) FILTER (class = 0), 0) AS n0, coalesce(sum(n) FILTER (class = 1), 0) AS n1 FROM k GROUP BY len, gram HAVING max(df) >= 2),
p AS (SELECT w.*, (n0 + 0.5) / (t0 + 0.5 * v) AS p0, (n1 + 0.5) / (t1 + 0.5 * v) AS p1 FROM w JOIN pos USING (len)), q AS (SELECT *, log2(p0 / ((p0 + p1) / 2)) AS l0, log2(p1 / ((p0 + p1) / 2)) AS l1 FROM p),
s AS (SELECT *, round(abs(l0 - l1) * sqrt(df) * (1 + 0.15 * (len - 3)), 6) AS score FROM q WHERE abs(l0 - l1) >= 0.5),
top AS (SELECT len, gram, df, score, round_even(greatest(least(l0, 12), -12) * 256, 0)::INT AS w0, round_even(greatest(least(l1, 12), -12) * 256, 0)::INT AS w1 FROM s ORDER BY score DESC, gram LIMIT 2048)"""


@query(_WEIGHTS_SQL + " SELECT len::INT AS len, gram, df::BIGINT AS df, w0, w1 FROM top")
def phrase_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG36, SL3: the strongest phrases with quantized class weights."""
    return P.phrase_weights(P.class_ngrams(_labelled(spark, sf_dir), "text", "quality"), "quality", [0, 1]).select("len", P.shown("len", "gram").alias("gram"), "df", "w0", "w1")


@query("""
WITH x AS (SELECT d.doc_id, l.quality, encode(coalesce(d.text, '')) AS raw, row_number() OVER (PARTITION BY l.quality ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) AS rank FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
s AS (SELECT *, octet_length(raw) AS b FROM x WHERE rank <= 4096), p AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY quality ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
g AS (SELECT greatest(least(65536, floor(524288 / count(*)), min(t)), 1024) AS budget FROM (SELECT sum(b) AS t FROM s GROUP BY quality))
SELECT doc_id, quality, least(b, budget - before)::BIGINT AS n_bytes, lower(substr(hex(raw), 1, (2 * least(b, budget - before))::BIGINT)) AS bytes FROM p, g WHERE budget > before""")
def reference_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG35: equal bytes a class of the documents that phrases are learnt from."""
    labelled = load(spark, sf_dir, "documents").select("doc_id", "text").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    out = P.reference_budget(labelled, "doc_id", "text", "quality")
    return out.select("doc_id", "quality", F.length("reference").cast("long").alias("n_bytes"), F.lower(F.hex("reference")).alias("bytes"))


@query(_WEIGHTS_SQL + ", h AS (SELECT doc_id, count(*) AS hits, sum(w0) AS w0, sum(w1) AS w1 FROM g JOIN top USING (len, gram) GROUP BY doc_id) SELECT x.doc_id, round(coalesce(w0, 0) / (256.0 * greatest(length(x) // 2 - 2, 1)), 6) AS s0, round(coalesce(w1, 0) / (256.0 * greatest(length(x) // 2 - 2, 1)), 6) AS s1, round(coalesce(hits, 0) / greatest(length(x) // 2 - 2, 1)::DOUBLE, 6) AS coverage FROM x LEFT JOIN h ON h.doc_id = x.doc_id")
def phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN12: class scores of documents from the chosen phrases."""
    labelled = _labelled(spark, sf_dir)
    weights = P.phrase_weights(P.class_ngrams(labelled, "text", "quality"), "quality", [0, 1])
    hits = P.phrase_hits(labelled, "doc_id", "text", weights, [0, 1])
    out = P.phrase_scores(hits, "doc_id", [0, 1], labelled.select("doc_id", (F.octet_length("text") + 2).alias("bytes")))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("s0", "s1", "coverage")))


@query("""
WITH f AS (SELECT p_partkey AS id, unnest(['p_brand=' || p_brand, 'p_type=' || p_type, 'p_size=' || p_size]) AS fact FROM part), w AS (SELECT fact, ln(1 + (SELECT count(*) FROM part) / count(*)::DOUBLE) AS w FROM f GROUP BY fact),
s AS (SELECT a.id AS query, b.id AS row, sum(w) AS score FROM f a JOIN w USING (fact) JOIN f b USING (fact) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, row) AS rank FROM s) SELECT query, row, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17, SL4, ML15: for every part with an id divisible by 20, the parts that share most."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size")
    return V.overlap_scores(part.where("id % 20 = 0"), part, ["p_brand", "p_type", "p_size"], 5).select("query", "row", F.round("score", 6).alias("score"), "rank")


@query("""
WITH e AS (SELECT event_id, abs(sin(value)) AS bm, abs(cos(value)) AS em, user_id % 3 <> 0 AS same, event_id % 5 < 3 AS br, event_id % 7 < 5 AS er FROM events),
c AS (SELECT CASE WHEN bm < 0.25 THEN 0 WHEN bm < 0.5 THEN 1 WHEN bm < 0.75 THEN 2 ELSE 3 END + CASE WHEN em > bm THEN 4 ELSE 0 END + CASE WHEN same THEN 8 ELSE 0 END AS context, sum((er AND NOT br)::INT) AS w, sum((br AND NOT er)::INT) AS l FROM e GROUP BY 1)
SELECT context::INT AS context, w::BIGINT AS wins, l::BIGINT AS losses, w + l >= 8 AND w - l >= 2 AND (w + 0.5) / (w + l + 1) - sqrt((w + 0.5) * (l + 0.5) / ((w + l + 1.0) ** 2 * (w + l + 2))) > 0.5 AS enabled FROM c""")
def expert_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML21, ML47: contexts in which an expert may overrule the base."""
    e = load(spark, sf_dir, "events")
    return V.routed(e, F.abs(F.sin("value")), F.abs(F.cos("value")), F.col("user_id") % 3 != 0, F.col("event_id") % 5 < 3, F.col("event_id") % 7 < 5)

"""Template hits: identifiers, dates, prefilter, scores and residue mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.columns import chars
from seqloom.session import materialize


# Fixed value: the form of a hit's name, identifier and chain.
HIT_FORM = r"^([a-zA-Z\d]{4})_([a-zA-Z0-9.]+)"


def hit_id(name: Column) -> Column:
    """struct(id, chain): four word characters in lower case, and the chain; null where the name has another form."""
    form = HIT_FORM
    return F.when(F.regexp_extract(name, form, 1) != "", F.struct(F.lower(F.regexp_extract(name, form, 1)).alias("id"), F.regexp_extract(name, form, 2).alias("chain")))


def closure(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(from_id, to_id): replacements followed to their end, by doubling: each round joins the map with itself.

    A chain of n replacements takes log2(n) rounds. Cycles end at the max_rounds-th round with an error.
    """
    now = materialize(links.filter("from_id is not null and to_id is not null and from_id <> to_id").groupBy("from_id").agg(F.max("to_id").alias("to_id")), "closure")
    for _ in range(max_rounds):
        ahead = now.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next"))
        moved = now.join(ahead, "to_id", "left").select("from_id", F.coalesce("next", "to_id").alias("to_id"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "closure")
        if not moved.filter("moved").limit(1).count():
            return moved.drop("moved")
        now = moved.drop("moved")
    raise ValueError("the replacements have a cycle")


def prefilter(hits: DataFrame, cutoff: Column, query: str = "query", template: str = "template", aligned: str = "aligned_cols", date: str = "release_date", min_ratio: float = 0.1, max_subsequence: float = 0.95, min_length: int = 10) -> DataFrame:
    """Hits with ``reject_reason``: the first of date, ratio, duplicate, length that applies, or null.

    A missing date passes. query and template are sequences without gaps.
    """
    q, t = F.col(query), F.col(template)
    ratio = F.col(aligned) / F.length(q)
    reason = (
        F.when(F.coalesce(F.col(date) > cutoff, F.lit(False)), "date")
        .when(ratio <= min_ratio, "ratio")
        .when((F.instr(q, t) > 0) & (F.length(t) / F.length(q) > max_subsequence), "duplicate")
        .when(F.length(t) < min_length, "length")
    )
    return hits.withColumn("reject_reason", reason)


# Weights of regions when hits of an unpaired heavy chain are scored.
HIT_WEIGHTS = {"FR1": 1, "CDR1": 3, "FR2": 1, "CDR2": 3, "FR3": 0, "CDR3": 0, "FR4": 0}


def hit_score(query: Column, hit: Column, weights: Column | None = None) -> Column:
    """(matches - mismatches) over columns, or with weights the weighted sum over the weights' sum."""
    score = F.zip_with(chars(query), chars(hit), lambda a, b: F.when(a == b, 1.0).otherwise(-1.0))
    if weights is None:
        return F.aggregate(score, F.lit(0.0), lambda s, x: s + x) / F.length(query)
    return F.aggregate(F.zip_with(score, weights, lambda s, w: s * w), F.lit(0.0), lambda s, x: s + x) / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)


def index_array(seq: Column, start: Column | int) -> Column:
    """Residue number of each column: capital letters count, gaps are -1, insertions (lower case) are left out but count."""
    begin = start if isinstance(start, Column) else F.lit(start)
    before = lambda i: F.length(F.translate(F.substring(seq, F.lit(1), i), "-", ""))
    number = F.transform(chars(seq), lambda c, i: F.when(c == "-", F.lit(-1)).when(c == F.upper(c), (begin + before(i)).cast("int")))
    return F.filter(number, lambda n: n.isNotNull())


def _once(value: Column, of) -> Column:
    """of(value) with value computed once, not again for each element of a lambda that uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def residue_mapping(query: Column, hit: Column, indices_query: Column, indices_hit: Column, full_query: Column) -> Column:
    """map<query position, hit position> of columns in which both have a residue, rebased to the first hit residue."""
    shift = F.instr(full_query, F.translate(query, "-", "")) - 1
    arrays = F.struct(indices_query.alias("q"), indices_hit.alias("h"), shift.alias("shift"), F.length(full_query).alias("nq"), F.length(F.translate(hit, "-", "")).alias("nh"))
    lowest = lambda a: F.array_min(F.filter(a, lambda i: i > -1))

    def mapped(v: Column) -> Column:
        pairs = F.zip_with(v["q"], v["h"], lambda q, h: F.struct((q - v["first"] + v["shift"]).cast("int").alias("q"), (h - v["low"]).cast("int").alias("h"), ((q > -1) & (h > -1)).alias("ok")))
        fit = F.filter(pairs, lambda p: p["ok"] & (p["q"] < v["nq"]) & (p["h"] < v["nh"]))
        return F.map_from_entries(F.transform(fit, lambda p: F.struct(p["q"], p["h"])))

    with_ends = lambda v: F.struct(*[v[c].alias(c) for c in ("q", "h", "shift", "nq", "nh")], lowest(v["q"]).alias("first"), lowest(v["h"]).alias("low"))
    return _once(_once(arrays, with_ends), mapped)


def locate_chain(hits: DataFrame, chains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each hit's chain in its structure: the named chain if it holds the template, else any chain that holds it, else
    one that matches with X as any residue. keys + chain, template; chains: file_id, chain, seq, chain_ord.

    ``how`` is 1, 2 or 3; hits without any chain are left out. Ties go to the first chain.
    """
    joined = hits.withColumnRenamed("chain", "__named").join(chains, "file_id")
    holds = F.instr("seq", F.col("template")) > 0
    pattern = F.translate("template", "X", ".")
    how = F.when(holds & (F.col("chain") == F.col("__named")), 1).when(holds, 2).when(F.regexp_like("seq", pattern), 3)
    best = joined.withColumn("how", how).filter(F.col("how").isNotNull()).groupBy(*keys).agg(F.min(F.struct("how", "chain_ord", "chain")).alias("b"))
    return best.select(*keys, "b.how", F.col("b.chain").alias("chain"))


def place_template(mapping: DataFrame, atoms: DataFrame, queries: DataFrame, keys: Sequence[str], least_atoms: int = 5) -> DataFrame:
    """Template residues at the query's positions: keys, q, letter, x, y, z, mask and ``reject_reason``.

    mapping: keys, q (0-based query position), h (residue of the template); atoms: keys, h, letter, x, y, z; queries: keys,
    length. Positions without a template residue have a gap, zeros and mask 0. A template with fewer than
    least_atoms placed residues is marked 'few_atoms'.
    """
    met = mapping.join(atoms, [*keys, "h"]).drop("h")
    line = queries.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).drop("length")
    out = line.join(met, [*keys, "q"], "left")
    placed = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    reason = F.when(F.coalesce("__n", F.lit(0)) < least_atoms, "few_atoms").alias("reject_reason")
    return out.join(placed, list(keys), "left").select(*keys, "q", F.coalesce("letter", F.lit("-")).alias("letter"), zero("x"), zero("y"), zero("z"), F.col("letter").isNotNull().cast("int").alias("mask"), reason)


def empty_template(queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a query without templates gets: gaps, zeros and mask 0 at every position. queries: keys, length."""
    line = queries.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).drop("length")
    return line.select(*keys, "q", F.lit("-").alias("letter"), *[F.lit(0.0).alias(c) for c in "xyz"], F.lit(0).alias("mask"), F.lit(None).cast("string").alias("reject_reason"))


def templates_or_empty(placed: DataFrame, queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The accepted templates' positions, and empty ones for queries without any."""
    good = placed.filter("reject_reason is null")
    return good.unionByName(empty_template(queries.join(good.select(*keys).distinct(), list(keys), "left_anti"), keys))


def identity_mapping(queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, q, h of a template that is the query's own structure."""
    return queries.select(*keys, F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("q")).withColumn("h", F.col("q"))


def realigned(mapping_query: Column, mapping_hit: Column, least: float = 0.9) -> Column:
    """Whether two aligned texts (gaps as ``-``) agree in at least a share of the shorter one's residues."""
    same = F.aggregate(F.zip_with(chars(mapping_query), chars(mapping_hit), lambda a, b: ((a == b) & (a != "-")).cast("int")), F.lit(0), lambda s, x: s + x)
    shorter = F.least(F.length(F.translate(mapping_query, "-", "")), F.length(F.translate(mapping_hit, "-", "")))
    return F.coalesce(same >= least * shorter, F.lit(False))


def search_input(paired: Column, front: Column, back: Column) -> Column:
    """What templates are searched with: the alignment if it is paired and nothing flanks the domain, else the query alone."""
    return F.when(paired & (F.coalesce(front, F.lit(0)) == 0) & (F.coalesce(back, F.lit(0)) == 0), "alignment").otherwise("query")


def region_hit_weights(lengths: Column) -> Column:
    """Weight of each position of a heavy chain from its seven region lengths, for hit_score."""
    table = F.array(*[F.lit(float(w)) for w in HIT_WEIGHTS.values()])
    return F.flatten(F.zip_with(lengths, table, lambda n, w: F.array_repeat(w, n.cast("int"))))

"""Pattern detection over clusters: emerging themes, orphans, contradictions, concepts; the store of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import identity as I
from corpusgraph.functions import vectors as V
from corpusgraph.operators.rounds import first_independent, near_sets, ranked
from corpusgraph.operators.search import by_blocks, small_side
from corpusgraph.session import discard, materialise

#: Columns of a detection.
FOUND = ["concept_key", "pattern_type", "cluster_ids", "confidence", "signals"]


def signals(concept: Column, values: dict[str, Column]) -> Column:
    """The evidence of a detection as JSON with sorted keys."""
    rows = {"concept_key": concept, **values}
    return F.to_json(F.struct(*[rows[k].alias(k) for k in sorted(rows)]))


def _row(concept: str, pattern: str, ids: Column, confidence: Column, values: dict[str, Column]) -> list[Column]:
    key = F.lit(concept)
    return [key.alias("concept_key"), F.lit(pattern).alias("pattern_type"), ids.alias("cluster_ids"), confidence.alias("confidence"), signals(key, values).alias("signals")]


def cluster_ids(vecs: DataFrame, column: str, most: int = 10_000) -> DataFrame:
    """The ids of clusters as text, in the order of the text; a scan reads ``most`` at most."""
    return vecs.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("cluster_id")).distinct().orderBy("cluster_id").limit(most)


def emerging(stats: DataFrame, reps: DataFrame, min_recent: int = 3, max_previous: int = 1) -> DataFrame:
    """Clusters (cluster_id, recent, previous, total) that grew lately and have a representation."""
    fit = stats.where((F.col("recent") >= min_recent) & (F.col("previous") <= max_previous)).join(reps.select("cluster_id"), "cluster_id", "left_semi")
    share = F.round(F.col("recent") / F.greatest("total", F.lit(1)), 6)
    return fit.select(*_row("emerging_theme", "emerging_theme", F.array("cluster_id"), share, {"recent_notes": F.col("recent").cast("double"), "previous_notes": F.col("previous").cast("double"), "total_notes": F.col("total").cast("double")}))


def orphans(ids: DataFrame, links: DataFrame, reps: DataFrame, min_neighbors: int = 1) -> DataFrame:
    """Clusters with fewer neighbours (links of cluster_id and neighbor) than asked and a representation."""
    counted = ids.join(links.groupBy("cluster_id").agg(F.count("neighbor").alias("n")), "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lone = counted.where(F.col("n") < min_neighbors).join(reps.select("cluster_id"), "cluster_id", "left_semi")
    return lone.select(*_row("orphan_cluster", "orphan", F.array("cluster_id"), F.lit(1.0), {"neighbor_count": F.col("n").cast("double")}))


def contradictions(reps: DataFrame, similar: float = 0.75, apart: float = 0.5) -> DataFrame:
    """Pairs of similar clusters (cluster_id, embedding, polarity) of opposite polarity; the cluster first by id comes first.

    Only clusters with a polarity can contradict, and only those of the other sign, so one side travels in blocks.
    """
    side = lambda k, cond: reps.where(cond).select(F.col("cluster_id").alias(k), F.col("embedding").alias(f"v{k}"), F.col("polarity").alias(f"p{k}"))
    up, down = side("a", "polarity > 0"), side("b", "polarity < 0")
    near = F.round(V.cosine(F.col("va"), F.col("vb")), 6)
    pairs = by_blocks(down, "b", lambda block: up.crossJoin(block).withColumn("similarity", near).where((F.col("similarity") >= similar) & (F.col("pa") - F.col("pb") >= apart)))
    first = F.col("a") < F.col("b")
    left, right = F.when(first, F.col("pa")).otherwise(F.col("pb")), F.when(first, F.col("pb")).otherwise(F.col("pa"))
    confidence = F.round(F.least(F.lit(1.0), F.col("similarity") * (F.col("pa") - F.col("pb"))), 6)
    return pairs.select(*_row("contradiction", "contradiction", F.array_sort(F.array("a", "b")), confidence, {"similarity": F.col("similarity"), "polarity_left": left, "polarity_right": right}))


def margin(vector: Column, positive: list[list[float]], negative: list[list[float]]) -> Column:
    """(score, positive_max, negative_max) of a vector against a concept's prototypes; no prototypes count 0."""
    vec = lambda v: F.array(*[F.lit(float(x)) for x in v])
    best = lambda some: F.greatest(*[V.cosine(vector, vec(v)) for v in some], F.lit(-1.0)) if some else F.lit(0.0)
    up, down = best(positive), best(negative)
    return F.struct(F.round(up - down, 6).alias("score"), F.round(up, 6).alias("positive_max"), F.round(down, 6).alias("negative_max"))


def radar(reps: DataFrame, concept: str, positive: list[list[float]], negative: list[list[float]], threshold: float, pattern: str = "concept") -> DataFrame:
    """Clusters (cluster_id, embedding) whose representation is a concept's by the threshold."""
    fit = reps.withColumn("m", margin(F.col("embedding"), positive, negative)).where(F.col("m.score") >= threshold)
    return _concepts(fit, concept, threshold, pattern, {})


def project_candidates(reps: DataFrame, concept: str, positive: list[list[float]], negative: list[list[float]], threshold: float = 0.05) -> DataFrame:
    """The best margin over a cluster's representatives (cluster_id, rank, embedding); of equal ones the first counts."""
    scored = reps.withColumn("m", margin(F.col("embedding"), positive, negative))
    best = scored.groupBy("cluster_id").agg(F.max(F.struct(F.col("m.score").alias("s"), (-F.col("rank")).alias("r"), "m"))["m"].alias("m"), F.count("*").alias("rep_count"))
    return _concepts(best.where(F.col("m.score") >= threshold), concept, threshold, "project_candidate", {"rep_count": F.col("rep_count").cast("double")})


def _concepts(fit: DataFrame, concept: str, threshold: float, pattern: str, more: dict[str, Column]) -> DataFrame:
    one = F.array(F.col("cluster_id").cast("string"))
    values = {"positive_max": F.col("m.positive_max"), "negative_max": F.col("m.negative_max"), "threshold": F.lit(float(threshold)), **more}
    key = I.set_key(one)
    return fit.select(*_row(concept, pattern, one, F.col("m.score"), values), key.alias("candidate_key"), F.concat(F.lit(f"{concept}:"), key).alias("discovery_id"))


def all_found(*parts: DataFrame) -> DataFrame:
    """The detections of several detectors, one after the other, repeated ones included."""
    out = parts[0].select(*FOUND)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FOUND))
    return out


def run_summary(found: DataFrame, run_id: str, clusters: int, seconds: float, dry_run: bool = False, target: float | None = None, errors: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts by pattern, and an error where the run took longer than its target."""
    late = [f"Run exceeded performance target ({seconds:.2f}s > {target}s)"] if target is not None and seconds > target else []
    counts = found.groupBy("pattern_type").agg(F.count("*").alias("n"))
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern_type", "n"))))
    said = F.array(*[F.lit(e) for e in (*errors, *late)]).cast("array<string>")
    return counts.agg(by_type.alias("detections_by_type")).select(F.lit(run_id).alias("run_id"), F.lit(clusters).cast("long").alias("clusters_analyzed"), "detections_by_type", F.lit(dry_run).alias("dry_run"), F.lit(float(seconds)).alias("duration_seconds"), said.alias("errors"))


def cluster_set(raw: Column) -> Column:
    """A set of clusters written as a JSON list or as values between commas; empty where it is null."""
    listed = F.from_json(raw, "array<string>")
    plain = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    is_list = F.coalesce(raw.rlike(r"^\s*\["), F.lit(False)) & F.try_parse_json(raw).isNotNull()
    return F.coalesce(F.when(is_list, listed).otherwise(plain), F.array().cast("array<string>"))


def greedy_distinct(found: DataFrame, group: str, members: str, order: list[tuple[str, bool]], threshold: float = 0.8, existing: DataFrame | None = None) -> DataFrame:
    """Rows whose set is no near copy (Jaccard similarity by ``threshold``) of one kept before it, or of an existing one, of their group.

    Rows are taken in ``order`` ((column, ascending) pairs). Of equal sets only the first can be kept, so they are counted as one, and
    so are existing ones; two empty sets are equal. The rest is a graph of near sets, in which the choice is made in rounds: a
    group, however large, is never in one task. A null set counts as empty.
    """
    places = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    as_set = lambda: F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array().cast(found.schema[members].dataType))))
    rows = ranked(found.withColumn("_set", as_set()), *places, F.col(group), F.col("_set"), rank="_rank")
    first = rows.groupBy(group, "_set").agg(F.min("_rank").alias("_rank"))
    if existing is not None:
        known = existing.select(F.col(group).alias("_group"), as_set().alias("_known")).distinct()
        first = first.join(known, [F.col(group).eqNullSafe(F.col("_group")), F.col("_set") == F.col("_known")], "left_anti")
    first = materialise(first, "first")
    named = lambda ids, df: df.where(F.size("_set") > 0).select(ids.alias("id"), F.transform("_set", lambda x: F.struct(F.col(group).alias("g"), x.alias("x"))).alias("members"))
    sets = named(F.col("_rank"), first)
    if existing is not None:  # existing sets come before all rows
        sets = sets.unionByName(named(-1 - F.shiftrightunsigned(F.xxhash64(group, "_set"), 1), known.select(F.col("_group").alias(group), F.col("_known").alias("_set"))))
    edges = near_sets(sets, threshold)
    by_old = edges.where("a < 0 and b >= 0").select(F.col("b").alias("node")).distinct()
    left = edges.where("a >= 0").join(by_old, F.col("a") == F.col("node"), "left_anti").join(by_old, F.col("b") == F.col("node"), "left_anti")
    dropped = first_independent(left)
    kept = first.select("_rank").join(by_old.unionByName(dropped), F.col("_rank") == F.col("node"), "left_anti")
    out = materialise(rows.join(kept, "_rank", "left_semi").select(*found.columns), "distinct")
    discard(rows, first, edges, dropped)
    return out


def store(found: DataFrame, existing: DataFrame, run_id: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the store after a run, one row with stored and skipped): near copies are skipped, a dry run stores nothing."""
    new = greedy_distinct(found, "pattern_type", "cluster_ids", [("confidence", False), ("signals", True)], existing=existing.select("pattern_type", "cluster_ids"))
    n = found.agg(F.count("*").alias("all")).crossJoin(new.agg(F.count("*").alias("kept")))
    counts = n.select(F.lit(0 if dry_run else 1).cast("long").alias("f"), "all", "kept").select((F.col("f") * F.col("kept")).alias("stored"), (F.col("all") - F.col("kept")).alias("skipped"))
    return existing if dry_run else existing.unionByName(new.withColumn("run_id", F.lit(run_id)).select(*existing.columns)), counts


def wanted(discoveries: DataFrame, least: float, most: int) -> DataFrame:
    """Valid project candidates by confidence: the best ``most`` (ties by id). Rows without ids are no records; no confidence counts 0."""
    valid = discoveries.where("coalesce(discovery_id, '') != '' and coalesce(candidate_key, '') != ''").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return valid.where((F.col("pattern_type") == "project_candidate") & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "discovery_id").limit(most)


def with_profiles(ids: DataFrame, profiles: DataFrame, source: str) -> DataFrame:
    """The profiles of the chosen clusters from one source."""
    return small_side(ids.select("cluster_id")).join(profiles.where(F.col("source") == source), "cluster_id")

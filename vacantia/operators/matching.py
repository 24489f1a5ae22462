"""Scores of profiles against postings from explainable parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vacantia.functions import vectors
from vacantia.operators.relational import spread

#: Penalty of each kind of gap; formal prerequisites are gates and cost nothing here (fixed values).
PENALTIES = {"domain": 25, "professional_experience": 20, "skill": 15, "title_domain": 25}
FORMAL = ("education", "certification", "enrolment")
DEFAULT_PENALTY = 15
#: Weight of skill coverage: main role, secondary role, role wished but not met, no wish.
WEIGHTS = {"role": 45, "secondary": 20, "wished": 25, "none": 100}


def skill_weight(kind: Column, context: Column, has_role: Column) -> Column:
    """A matched skill's weight: mentioned 1, optional .25, title .4 (only without a role), incidental 0; halved if academic."""
    half = F.when(F.coalesce(context, F.lit("")).isin("academic", "research"), 0.5).otherwise(1.0)
    return half * F.when(kind == "incidental", 0.0).when(kind == "title", F.when(has_role, 0.0).otherwise(0.4)).when(kind == "optional", 0.25).otherwise(1.0)


def lexical_score(role: Column, secondary: Column, wished: Column, matched_weight: Column, n_skills: Column) -> Column:
    base = F.when(role, 55.0).when(secondary, 35.0).otherwise(0.0)
    weight = F.when(role, WEIGHTS["role"]).when(secondary, WEIGHTS["secondary"]).when(wished, WEIGHTS["wished"]).otherwise(WEIGHTS["none"])
    return base + weight * matched_weight / F.greatest(F.lit(1), n_skills)


def gap_penalty(gaps: Column) -> Column:
    """Sum over distinct gaps (array<struct<gap, kind>>) of their kind's penalty."""
    table = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    costly = F.filter(F.array_distinct(gaps), lambda g: ~g["kind"].isin(*FORMAL))
    return F.aggregate(costly, F.lit(0), lambda a, g: a + F.coalesce(F.try_element_at(table, g["kind"]), F.lit(DEFAULT_PENALTY)))


def adjusted_score(score: Column, penalty: Column, limit: Column, experience: Column, language: Column, location: Column) -> Column:
    """Gaps cap at 60 and cost at most 40; experience -10..5, language -20..10; clamped to the limit before and after location."""
    v = F.least(F.lit(100), F.bround(score, 0).cast("int"))
    v = F.when(penalty > 0, F.greatest(F.lit(0), F.least(v, F.lit(60)) - F.least(F.lit(40), penalty))).otherwise(v)
    v = v + vectors.clamp(experience, -10, 5) + vectors.clamp(language, -20, 10)
    v = F.greatest(F.lit(0), F.least(limit, v))
    return F.greatest(F.lit(0), F.least(limit, v + location))


def score_limit(*, uncovered_specialist: Column, missing_experience: Column, unknown_experience: Column, substantive: Column, limited: Column, role: Column, n_substantive: Column, secondary: Column, content: Column) -> Column:
    cap = lambda c, n: F.when(c, n).otherwise(100)
    return F.least(cap(uncovered_specialist, 29), cap(missing_experience, 29), cap(unknown_experience, 59), cap(~substantive, 59), cap(limited, 60), cap(role & (n_substantive < 2), 85), cap(secondary & ~role & (content < 65), 59))


def tier(score: Column, task_fit: Column, conflicts: Column, blocking: Column, open_questions: Column) -> Column:
    return F.when(conflicts | blocking | (score < 30), "unlikely").when((score >= 65) & (task_fit >= 65) & ~open_questions, "recommended").otherwise("possible")


def semantic_overlay(score: Column, baseline: Column, semantic: Column) -> Column:
    """Semantic similarity lifts a score to at most 59, or to what the rules gave anyway."""
    lifted = F.greatest(score, vectors.clamp(semantic, 0, 59))
    return F.when(lifted > score, F.least(lifted, F.greatest(F.lit(59), baseline))).otherwise(score)


def content_overlap(job_skills: DataFrame, profile_skills: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, coverage): 85 * overlap / total; 59 at most below two full-strength specifics, 0 below one.

    job_skills: by, name, kind, general boolean.  profile_skills: profile (part of ``by``), name, strength.
    """
    weight = F.when(F.col("kind") == "mentioned", 1.0).when(F.col("kind") == "optional", 0.25).otherwise(0.0)
    j = job_skills.withColumn("w", weight).join(profile_skills, [*(c for c in by if c in profile_skills.columns), "name"], "left")
    got = F.when(F.col("w") > 0, F.col("w") * F.col("strength"))
    special = F.when((F.col("kind") == "mentioned") & ~F.col("general"), F.col("strength"))
    per = j.groupBy(*by, "name").agg(F.max("w").alias("w"), F.max(got).alias("g"), F.max(special).alias("s"))
    sums = per.groupBy(*by).agg(F.sum("w").alias("total"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("overlap"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("specific"))
    part = F.col("overlap") / F.greatest(F.lit(1.0), F.col("total"))
    score = F.when(F.col("specific") >= 1, F.least(85 * part, F.when(F.col("specific") >= 2, 85.0).otherwise(59.0))).otherwise(0.0)
    return sums.select(*by, F.bround(score, 0).cast("int").alias("score"), F.round(part, 3).alias("coverage"))


def assessment_overlay(local: DataFrame, assessments: DataFrame, *, version: str) -> DataFrame:
    """Stored assessments replace local scores where version and source hash are current; local vetoes stay.

    local: profile, job, source_hash, score, tier, eligible, mandatory_review, language_review.
    assessments: profile, job, source_hash, version, a_score, a_eligible, a_unresolved.
    """
    current = assessments.filter(F.col("version") == version).drop("version")
    j = local.join(current, ["profile", "job", "source_hash"], "left")
    has = F.col("a_score").isNotNull()
    eligible = F.col("eligible") & F.col("a_eligible")
    model = F.when(~eligible | (F.col("a_score") < 30), "unlikely").when((F.col("a_score") >= 65) & ~F.col("mandatory_review") & ~F.col("language_review") & ~F.col("a_unresolved"), "recommended").otherwise("possible")
    down = F.when(F.col("eligible") & (F.col("tier") == "recommended"), "possible").otherwise(F.col("tier"))
    return j.select("profile", "job", F.when(has, F.col("a_score")).otherwise(F.col("score")).alias("score"), F.when(has, model).otherwise(down).alias("tier"), F.when(has, eligible).otherwise(F.col("eligible")).alias("eligible"), F.when(has, "llm").otherwise("local").alias("score_source"))


def scope_overlay(matches: DataFrame) -> DataFrame:
    """The area decides: a posting out of scope is not eligible, whatever its score (columns eligible, tier, in_scope)."""
    return matches.withColumn("tier", F.when(F.col("in_scope"), F.col("tier")).otherwise("unlikely")).withColumn("eligible", F.col("eligible") & F.col("in_scope"))


#: Profile sections broadcast at once on average; pairs of sections that a task holds at once; similarities so near the best are worked out again in order.
MAX_SECTIONS, CELLS, NEAR = 10_000, 2_000_000, 1e-9


def best_section_pairs(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(job, profile, similarity, job_text, profile_text): the most similar pair of sections, of equal ones that of the largest texts; null without comparable vectors.

    jobs: job, text, vector.  profiles: profile, text, vector.  Profiles are a query set, broadcast in blocks; every posting meets each of them in products of
    matrices, and only the best pair of a posting and profile leaves a batch of postings.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    unit = lambda rows, name: rows.select(F.col(name).alias("key"), F.col("text").cast("string").alias("text"), vectors.normalize(F.col("vector")).alias("v"))
    asked = unit(profiles, "profile")
    blocks = max(1, -(-asked.count() // MAX_SECTIONS))

    def side(rows, none: int) -> tuple:
        """Sections in the order of their keys: rows, codes, places of texts in order, lengths of vectors (``none``: no vector), vectors with zeros behind."""
        codes = np.asarray(rows.column(0).dictionary_encode(null_encoding="encode").indices)
        rows, codes = rows.take(pa.array(order := np.argsort(codes, kind="stable"))), codes[order]
        size = np.asarray(pc.fill_null(pc.list_value_length(rows.column(2)), none)).astype(np.int64)
        held = np.arange(max(size.max(initial=0), 1)) < np.maximum(size, 0)[:, None]
        x = np.zeros(held.shape)
        x[held] = np.asarray(rows.column(2).flatten())
        return rows, codes, np.asarray(pc.rank(rows.column(1), null_placement="at_start", tiebreaker="dense")).astype(np.int64), size, x

    def best(batches, table):
        theirs, p_codes, p_place, p_size, p = side(table, -1)
        for batch in batches:
            if not len(batch) or not len(theirs):
                continue
            own, j_codes, j_place, j_size, j = side(batch, -2)
            d = min(j.shape[1], p.shape[1])
            first = np.flatnonzero(np.diff(j_codes, prepend=-1))
            group = np.cumsum(np.diff(j_codes, prepend=-1) != 0) - 1
            step = max(1, CELLS // len(own))
            for at in range(0, len(theirs), step):  # profile sections that the batch meets at once
                some = slice(at, at + step)
                s = j[:, :d] @ p[some, :d].T
                s[j_size[:, None] != p_size[some]] = -np.inf
                new = np.diff(p_codes[some], prepend=-1) != 0
                top = np.maximum.reduceat(np.maximum.reduceat(s, first, axis=0), np.flatnonzero(new), axis=1)
                column = np.cumsum(new) - 1
                a, b = np.nonzero(s >= (top - NEAR)[group][:, column])
                exact, b = s[a, b], b + at
                for k in range(0, len(a), max(1, CELLS // d)):  # sums in the order of the entries, whatever the matrix product did
                    part = slice(k, k + max(1, CELLS // d))
                    exact[part] = np.where(np.isinf(exact[part]), -np.inf, np.cumsum(j[a[part], :d] * p[b[part], :d], axis=1)[:, -1] + 0.0)
                order = np.lexsort((p_place[b], j_place[a], exact, p_codes[b], group[a]))
                a, b, exact = a[order], b[order], exact[order]
                last = np.flatnonzero((np.diff(group[a], append=-1) != 0) | (np.diff(p_codes[b], append=-1) != 0))
                i, k = pa.array(a[last]), pa.array(b[last])
                yield pa.RecordBatch.from_arrays([own.column(0).take(i), theirs.column(0).take(k), pa.array(exact[last], mask=np.isinf(exact[last])), own.column(1).take(i), theirs.column(1).take(k)], names=["job", "profile", "s", "job_text", "profile_text"])

    def block(number: int):
        table = asked.filter(F.pmod(F.xxhash64("key", "text", "v"), F.lit(blocks)) == number).toArrow().combine_chunks()
        held = jobs.sparkSession.sparkContext.broadcast(table)
        return lambda batches: best(batches, pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in held.value.columns], names=held.value.column_names))

    fields = StructType([StructField("job", jobs.schema["job"].dataType), StructField("profile", profiles.schema["profile"].dataType), StructField("s", DoubleType()), StructField("job_text", StringType()), StructField("profile_text", StringType())])
    rows = spread(unit(jobs, "job"))
    scored = reduce(DataFrame.unionByName, [rows.mapInArrow(block(n), fields) for n in range(blocks)])
    top = scored.groupBy("job", "profile").agg(F.max(F.struct("s", "job_text", "profile_text")).alias("b"))
    return top.select("job", "profile", F.when(F.col("b.s").isNotNull(), F.round(vectors.clamp(F.col("b.s"), -1.0, 1.0), 4)).alias("similarity"), "b.job_text", "b.profile_text")

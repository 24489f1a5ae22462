"""Profiles against postings: the composite score from enriched postings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vacantia.functions import requirements as R
from vacantia.functions import tasks
from vacantia.operators import applicability, matching
from vacantia.operators.relational import against_all

MATCH = "struct<role:boolean,secondary:boolean,weight:double,n_skills:int,substantive:int,matched:array<string>,missing:array<string>,gaps:array<struct<gap:string,kind:string>>,conflicts:array<string>,unknowns:array<string>,language_gate:string,language_points:int,experience_points:int,content:int,uncovered:array<string>,stated:boolean>"


def _texts(value) -> list[str]:
    """The texts in a JSON value, in order."""
    if isinstance(value, str):
        return [value]
    return [t for v in (value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()) for t in _texts(v)]


def _content(rows: dict, abilities: dict[str, float]) -> int:
    """What the posting's skills share with the profile's: 85 at most, 59 below two full specific ones, 0 below one."""
    weight = {n: {"mentioned": 1.0, "optional": 0.25}.get(r["kind"], 0.0) for n, r in rows.items()}
    shared = sum(w * abilities.get(n, 0.0) for n, w in weight.items())
    special = sum(abilities.get(n, 0.0) for n, r in rows.items() if r["kind"] == "mentioned" and n not in R.GENERAL_SKILLS)
    return round(min(85 * shared / max(1, sum(weight.values())), 85 if special >= 2 else 59)) if special >= 1 else 0


def compare(job: dict, profile: dict) -> dict:
    """Facts of one pair: matched skills and their weight, gaps, conflicts, open questions, gates."""
    e = job["enriched"]
    have = {s.casefold() for s in profile.get("skills") or []}
    context = {k.casefold(): v for k, v in (profile.get("skill_context") or {}).items()}
    role, secondary = R.role_matches(job["title"], profile.get("desired_roles") or []), R.role_matches(job["title"], profile.get("secondary_roles") or [])
    rows = {r["name"]: r for r in e["skills"]}
    matched = [n for n in rows if n.casefold() in have]
    weight, substantive = 0.0, 0
    for n in matched:
        half = 0.5 if context.get(n.casefold()) in ("academic", "research") else 1.0
        kind = rows[n]["kind"]
        substantive += kind == "mentioned"
        weight += half * {"mentioned": 1.0, "optional": 0.25, "incidental": 0.0, "title": 0.0 if role or secondary else 0.4}[kind]
    stated = {n: 0.5 if context.get(n.casefold(), "professional") != "professional" else 1.0 for n in R.SKILLS if n.casefold() in have}
    told = R.claimed_skills(_texts([profile.get("summary"), profile.get("experience"), profile.get("career_evidence")]))
    abilities = {n: max(stated.get(n, 0.0), told.get(n, 0.0)) for n in stated | told}
    able = {n for n, strength in abilities.items() if strength == 1} | set(stated)
    uncovered = [d["quote"] for d in e["specialist"] if not able.intersection(d["skills"])]
    gaps, conflicts, unknowns = [], [], []
    for q in e["qualifications"]:
        held = [str(x).casefold() for x in (profile.get("education") or []) + (profile.get("certifications") or [])]
        if not held:
            kind = {"degree": "education", "certificate": "certification"}.get(q["kind"], q["kind"])
            gaps.append({"gap": "Verify requirement: " + q["evidence"], "kind": kind})
    years, asked = profile.get("experience_years"), None if pd.isna(e["experience"]) else e["experience"]  # a batch holds NaN for null
    if asked is not None and years is None:
        gaps.append({"gap": f"Verify experience: {asked:g} years", "kind": "experience"})
    points = 0 if asked is None or years is None else 5 if years >= asked else -10
    levels = {k.casefold(): v for k, v in (profile.get("language_levels") or {}).items()}
    gate, bonus = "pass", 0
    for row in e["languages"]:
        if not row["required"]:
            continue
        own = levels.get(row["language"].casefold())
        if own is None:
            gate = "unknown" if gate != "fail" else gate
            unknowns.append(f"{row['language']} level not stated")
        elif row["level"] and R.CEFR.index(own.upper()) < R.CEFR.index(row["level"]):
            gate, bonus = "fail", bonus - 20
            conflicts.append(f"{row['language']} {row['level']} required")
        else:
            bonus += 5
    for t in profile.get("excluded_terms") or []:
        if R.term(t).search(job["title"] or ""):
            conflicts.append("Excluded title term: " + t)
    if e["quality"] == "limited":
        unknowns.append("Full job description needs checking")
    unknowns += ["Verify uncovered specialist duties: " + d for d in uncovered]
    return {
        "role": role, "secondary": secondary, "weight": weight, "n_skills": len(rows), "substantive": substantive, "matched": matched, "missing": [n for n in rows if n not in matched], "gaps": gaps,
        "conflicts": conflicts, "unknowns": unknowns, "language_gate": gate, "language_points": max(-20, min(10, bonus)), "experience_points": points,
        "content": _content(rows, abilities), "uncovered": uncovered, "stated": bool(e["has_duties"]) or any(r["kind"] == "mentioned" for r in rows.values()),
    }


def match(jobs: DataFrame, profiles: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """(job_id, profile_id, score, tier, eligible, uncertain, mandatory_review, …) for every posting and profile.

    jobs: job_id, title, enriched, and, to compare duties, units (``tasks.task_units``).  profiles: profile_id, profile
    (JSON text), and facts (``tasks.profile_facts``): a stated query set, which every posting meets.  Without units or
    facts no duty counts as done.

    conditions: rows of ``applicability.condition_rows`` or ``reconcile``; pairs without rows have nothing to meet.  A group of conditions that
    failed is a conflict; one that is unknown is an open question, and either puts the pair up for review and out of the tiers that
    suggest it.  A tenure that is too short limits the score to 29, one without proof to 59.
    """
    import json

    names = [x.split(":")[0] for x in re.split(r",(?=[a-z_]+:)", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", MATCH[7:-1])))]

    @pandas_udf(MATCH)
    def run(titles: pd.Series, enriched: pd.DataFrame, texts: pd.Series) -> pd.DataFrame:
        parsed = {t: json.loads(t) for t in texts.unique()}
        rows = [compare({"title": a, "enriched": b}, parsed[p]) for a, b, p in zip(titles, enriched.to_dict("records"), texts, strict=True)]
        return pd.DataFrame(rows, columns=names)

    for column, kind, df in (("units", tasks.UNIT, jobs), ("facts", tasks.FACT, profiles)):
        if column not in df.columns:
            empty = df.withColumn(column, F.from_json(F.lit("[]"), f"array<{kind}>"))
            jobs, profiles = (empty, profiles) if column == "units" else (jobs, empty)
    m = against_all(jobs, profiles).withColumn("m", run("title", "enriched", "profile")).withColumn("duties", tasks.alignment(F.col("units"), F.col("facts")))
    none = F.expr("cast(array() as array<string>)")
    if conditions is None:
        m = m.withColumns({"eligibility": F.lit("pass"), "location": F.lit("pass"), "failed": none, "open": none, "short": F.lit(False), "unproven": F.lit(False)})
    else:
        m = m.join(applicability.verdicts(conditions), ["job_id", "profile_id"], "left")
        m = m.fillna({"eligibility": "pass", "location": "pass", "short": False, "unproven": False}).withColumns({k: F.coalesce(k, none) for k in ("failed", "open")})
    c = lambda n: F.col(f"m.{n}")
    done = F.filter("duties.requirements", lambda r: r["evidence"]["status"] != "unknown")
    proven = F.exists("duties.requirements", lambda r: (r["evidence"]["status"] == "supported") & (r["evidence"]["context"] != "academic"))
    shown = F.coalesce(F.when(F.size(done) > 0, F.col("duties.score")), F.lit(0))
    grounded = (F.size("units") >= 2) & (shown >= 65) & F.coalesce(proven, F.lit(False))
    m = m.withColumn("shown", shown).withColumn("grounded", grounded)
    lexical = matching.lexical_score(c("role"), c("secondary"), F.get_json_object("profile", "$.desired_roles[0]").isNotNull(), c("weight"), c("n_skills"))
    raw = F.greatest(lexical, c("content"), F.least("shown", F.when(F.col("grounded"), 85).otherwise(59)))
    limited = (F.col("enriched.quality") == "limited") & ~F.col("grounded")
    special, stated = F.size(c("uncovered")) > 0, c("stated") | (F.size("units") > 0)
    limit = matching.score_limit(uncovered_specialist=special, missing_experience=F.col("short"), unknown_experience=F.col("unproven"), substantive=stated, limited=limited, role=c("role"), n_substantive=c("substantive"), secondary=c("secondary"), content=c("content"))
    fit = F.when(stated, F.least(F.greatest(c("content"), "shown"), F.when(special, 29).otherwise(100))).otherwise(0)
    m = m.withColumn("task_fit", fit).withColumn("score", matching.adjusted_score(raw, matching.gap_penalty(c("gaps")), limit, c("experience_points"), c("language_points"), F.lit(0)))
    conflicts = F.concat(c("conflicts"), F.transform("failed", lambda q: F.concat(F.lit("Condition not met: "), q)))
    unknowns = F.concat(c("unknowns"), F.transform("open", lambda q: F.concat(F.lit("Verify condition: "), q)))
    bad, blocking = F.size(conflicts) > 0, (F.size("failed") > 0) | (F.size("open") > 0)
    open_ = (c("language_gate") == "unknown") | limited | (F.size(c("gaps")) > 0)
    return m.select(
        "job_id", "profile_id", "score", matching.tier(F.col("score"), F.col("task_fit"), bad, blocking, open_).alias("tier"), (~bad).alias("eligible"), (F.size(unknowns) > 0).alias("uncertain"), blocking.alias("mandatory_review"),
        c("matched").alias("matched_skills"), c("missing").alias("missing_skills"), c("gaps").alias("gaps"), conflicts.alias("conflicts"), unknowns.alias("unknowns"), c("language_gate").alias("language_gate"),
        F.col("eligibility").alias("eligibility_gate"), F.col("location").alias("location_gate"), "task_fit", c("content").alias("content_score"), F.col("duties").alias("task_alignment"),
    )


def validate_assessments(stored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(profile, job, score, valid) of stored assessments (JSON): all dimensions there and within 0..100, all gates of a known state; the score is the weighted mean of the scored dimensions."""
    dims = F.from_json("assessment", "dimensions map<string,struct<score:double>>, gates map<string,struct<status:string>>")
    d = stored.withColumn("d", dims)
    at = lambda k: F.try_element_at("d.dimensions", F.lit(k))["score"]
    inside = [F.coalesce(at(k).between(0, 100), F.lit(True)) for k in weights]
    ok = F.col("d.dimensions").isNotNull() & F.coalesce(F.forall(F.map_values("d.gates"), lambda g: g["status"].isin("pass", "fail", "unknown")), F.lit(False))
    for x in (*inside, *(F.array_contains(F.map_keys("d.dimensions"), k) for k in weights)):
        ok = ok & F.coalesce(x, F.lit(False))
    total = sum((F.when(at(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    mean = sum((F.coalesce(at(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    return d.select("profile", "job", F.when(ok, F.bround(mean, 0)).cast("int").alias("score"), F.coalesce(ok, F.lit(False)).alias("valid"))

"""Titles to roles: a fuzzy matcher over catalogs of roles, and a second one by synonyms and keywords.

Each distinct title meets each role of its program once; titles that are left out never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import best_ratio_col, token_set_ratio_col
from ..functions.scoring import priority_score, priority_tier, title_points
from ..functions.text import clean_text, confidence_in_notes, normalize_role_title
from ..functions.titles import with_normalized_title
from .common import first_per_key, with_seq

# fixed values: the role catalogs and word lists
LAW_ROLES = [
    "Library Director", "Law Library Director", "Director of the Law Library", "Director of Law Library", "Associate Law Librarian",
    "Associate Law Library Director", "Head Librarian", "Law Librarian", "Head of Reference", "Reference Librarian",
    "Instructional Technology Librarian", "Technology Librarian", "Associate Dean for Academic Affairs", "Associate Dean of Academic Affairs",
    "Associate Dean, Academic Affairs", "Assistant Dean for Academic Affairs", "Assistant Dean of Academic Affairs", "Assistant Dean, Academic Affairs",
    "Dean of Academic Affairs", "Dean of Students", "Associate Dean of Students", "Associate Dean for Students",
    "Associate Dean for Information Services", "Associate Dean of Information Services", "Assistant Dean for Information Services",
    "Assistant Dean of Information Services", "Director of Information Services", "IT Director", "Information Services Director",
    "Legal Writing Director", "Director of Legal Writing", "Director, Legal Writing", "Legal Writing Program Director",
    "Associate Director of Legal Writing", "Experiential Learning Director", "Director of Experiential Learning", "Director, Experiential Learning",
    "Experiential Programs Director", "Associate Director of Experiential Learning", "Associate Director, Experiential Learning",
    "Clinical Programs Director", "Director of Clinical Programs", "Director, Clinical Programs", "Clinical Director", "Associate Clinical Director",
    "Clinical Faculty Director",
]
PARALEGAL_ROLES = [
    "Paralegal Program Director", "Director of Paralegal Studies", "Director, Paralegal Studies", "Director of Paralegal Program",
    "Paralegal Studies Program Director", "Legal Studies Program Director", "Director of Legal Studies", "Director, Legal Studies",
    "Paralegal Studies Coordinator", "Paralegal Program Coordinator", "Legal Studies Coordinator", "Program Coordinator", "Paralegal Coordinator",
    "Department Chair", "Program Chair", "Chair, Legal Studies", "Legal Studies Department Chair", "Paralegal Studies Department Chair",
    "Department Head", "Dean of Workforce Programs", "Dean of Career and Technical Education", "Dean of Career Education", "CTE Dean",
    "Workforce Development Dean", "Dean, Workforce Programs", "Dean, Career and Technical Education", "Legal Studies Faculty",
    "Legal Studies Instructor", "Paralegal Studies Faculty", "Paralegal Instructor", "Legal Studies Professor", "Paralegal Studies Professor",
    "Legal Studies Lecturer",
]
GENERIC = ["director", "dean", "coordinator", "assistant", "associate", "manager", "head", "chair", "chief", "officer"]
SPECIFIC = {
    "it": ["it", "information", "technology", "internet"], "library": ["library", "librarian"], "clinical": ["clinical", "clinic"],
    "legal writing": ["legal", "writing"], "experiential": ["experiential", "learning"], "paralegal": ["paralegal"],
}
#: role: (synonyms, keywords, words one of which must be there too)
LAW_TARGETS = {
    "Law Library Director": (
        ["Library Director", "Head Librarian", "Law Librarian", "Director of Library Services", "Director of the Law Library", "Associate Director Law Library", "Assistant Director Law Library"],
        ["library", "librarian"], ["director", "head", "associate director", "assistant director"]),
    "Associate Dean for Academic Affairs": (
        ["Associate Dean Academic", "Assistant Dean Academic Affairs", "Academic Dean", "Associate Dean of Academic Affairs", "Assistant Dean for Academic Affairs", "Vice Dean Academic Affairs", "Vice Dean for Academic Affairs"],
        ["dean", "academic"], ["associate", "assistant", "vice"]),
    "Legal Writing Director": (
        ["Director of Legal Writing", "Legal Writing Program Director", "Director Legal Research and Writing", "Director of Legal Research & Writing", "Director of the Legal Writing Program", "Legal Research and Writing Director", "Assistant Director Legal Writing"],
        ["legal writing", "legal research"], ["director", "program director"]),
    "Experiential Learning Director": (
        ["Clinical Director", "Externship Director", "Skills Director", "Practical Training Director", "Director of Experiential Learning", "Director of Clinical Programs", "Director of Externships", "Associate Dean Experiential Learning", "Assistant Dean Clinical Programs"],
        ["experiential", "clinical", "externship", "skills", "practical"], ["director", "dean"]),
    "Instructional Technology Librarian": (
        ["Technology Librarian", "Digital Services Librarian", "IT Librarian", "Instructional Technologist", "Educational Technology Librarian", "Technology Services Librarian"],
        ["technology", "librarian", "digital"], ["instructional", "educational", "it", "digital"]),
}
PARALEGAL_TARGETS = {
    "Paralegal Program Director": (
        ["Director Paralegal Studies", "Paralegal Coordinator", "Paralegal Program Coordinator", "Director of Paralegal Program", "Paralegal Studies Director", "Program Director Paralegal", "Coordinator Paralegal Studies"],
        ["paralegal"], ["director", "coordinator", "program"]),
    "Dean of Workforce Programs": (
        ["Workforce Development Dean", "Career Programs Dean", "Dean Workforce Development", "Dean of Workforce Development", "Dean Career and Technical Education", "Dean CTE Programs"],
        ["workforce", "dean"], ["development", "programs", "career"]),
    "Legal Studies Faculty": (
        ["Paralegal Instructor", "Legal Studies Professor", "Paralegal Studies Faculty", "Legal Studies Instructor", "Paralegal Professor", "Paralegal Studies Instructor"],
        ["legal studies", "paralegal"], ["faculty", "instructor", "professor", "teacher"]),
    "Program Chair": (
        ["Department Chair", "Program Coordinator", "Division Chair", "Chair Paralegal", "Chair Legal Studies", "Department Head"],
        ["chair", "coordinator"], ["program", "department", "division"]),
    "Academic Affairs": (
        ["Director Academic Affairs", "Associate Dean Academic Affairs", "Academic Services Director", "Director of Academic Services", "Academic Success Director", "Dean of Academic Affairs"],
        ["academic"], ["affairs", "services", "success", "director", "dean"]),
}


def catalog(spark: SparkSession, law: list[str] = LAW_ROLES, paralegal: list[str] = PARALEGAL_ROLES) -> DataFrame:
    """``law`` (boolean), ``role_ord``, ``role``: the roles of either kind of program, in order."""
    rows = [(True, i, r) for i, r in enumerate(law)] + [(False, i, r) for i, r in enumerate(paralegal)]
    return spark.createDataFrame(rows, "law boolean, role_ord int, role string")


def meaningful_boost(title: Column, role: Column) -> Column:
    """Five points for each word in common that is no generic one, ten at most."""
    both = F.array_intersect(F.split(title, r"\s+"), F.split(role, r"\s+"))
    return F.least(F.lit(10), F.size(F.array_except(both, F.array(*map(F.lit, GENERIC)))) * 5)


def professor_penalty(title: Column, role: Column) -> Column:
    """20 where a professor meets a role of administration."""
    is_prof = lambda c: F.array_contains(F.split(c, r"\s+"), "professor")
    excused = F.contains(role, F.lit("faculty")) | F.contains(role, F.lit("academic")) | F.contains(role, F.lit("dean"))
    return F.when(is_prof(title) & ~is_prof(role) & ~excused, 20).otherwise(0)


def context_penalty(title: Column, role: Column) -> Column:
    """25 where a role names a field of its own and the title has nothing of that field."""
    out = F.lit(False)
    for word, needed in SPECIFIC.items():
        lacks = F.lit(True)
        for n in needed:
            lacks = lacks & ~F.contains(title, F.lit(n))
        out = out | (F.contains(role, F.lit(word)) & lacks)
    return F.when(out, 25).otherwise(0)


def role_scores(titles: DataFrame, roles: DataFrame) -> DataFrame:
    """``title, law, modifier, role, role_ord, score`` of each distinct title, if not left out, with each role of its kind."""
    t = with_normalized_title(titles.select("title", "law").distinct(), "title", "__n").where(~F.col("__n.should_exclude"))
    t = t.select("title", "law", F.col("__n.confidence_modifier").alias("modifier"), F.lower(clean_text(F.col("__n.normalized"))).alias("__t"))
    pairs = t.join(F.broadcast(roles), "law").withColumn("__r", F.lower(clean_text(F.col("role"))))
    pairs = pairs.withColumn("__s", best_ratio_col(F.col("__t"), F.col("__r")))
    boosted = F.least(F.lit(100), F.col("__s") + meaningful_boost(F.col("__t"), F.col("__r")))
    less = F.greatest(F.lit(0), boosted - professor_penalty(F.col("__t"), F.col("__r")))
    return pairs.select("title", "law", "modifier", "role", "role_ord", F.greatest(F.lit(0), less - context_penalty(F.col("__t"), F.col("__r"))).cast("int").alias("score"))


def match_roles(contacts: DataFrame, roles: DataFrame, threshold: int = 70) -> DataFrame:
    """``contacts`` with ``matched_role, title_match_score, title_points, all_matched_roles`` (those after the first).

    Ties go by the catalog's order; no role at ``threshold`` or more: null, 0, 0, none.
    """
    law = F.col("program_type") == "Law School"
    c = contacts.withColumn("__law", F.coalesce(law, F.lit(False)))
    good = role_scores(c.select("title", F.col("__law").alias("law")), roles).where(F.col("score") >= threshold)
    per = good.groupBy("title", "law").agg(F.first("modifier").alias("__mod"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "role_ord", "role"))).alias("m"))
    per = per.select(F.col("title").alias("__t"), F.col("law").alias("__l"), "m", "__mod")
    j = c.join(per, (F.col("title") == F.col("__t")) & (F.col("__law") == F.col("__l")), "left")
    best = F.get("m", F.lit(0))
    points = F.greatest(F.lit(0), F.least(F.lit(20), title_points(-best["s"]) + F.col("__mod")))
    return j.select(
        *[x for x in contacts.columns if x not in ("matched_role", "title_match_score", "title_points", "all_matched_roles")],
        best["role"].alias("matched_role"),
        F.coalesce(-best["s"], F.lit(0)).cast("int").alias("title_match_score"),
        F.when(best.isNotNull(), points).otherwise(0).cast("int").alias("title_points"),
        F.when(F.size("m") > 1, F.transform(F.slice("m", 2, F.size("m")), lambda x: x["role"])).otherwise(F.array().cast("array<string>")).alias("all_matched_roles"),
    )


def target_catalog(spark: SparkSession) -> DataFrame:
    rows = [(law, i, r, [r], *v) for law, t in ((True, LAW_TARGETS), (False, PARALEGAL_TARGETS)) for i, (r, v) in enumerate(t.items())]
    df = spark.createDataFrame([(a, b, c, e, f, g) for a, b, c, _, e, f, g in rows], "law boolean, role_ord int, role string, synonyms array<string>, keywords array<string>, context array<string>")
    clean = lambda c: F.transform(c, normalize_role_title)
    return df.select("law", "role_ord", "role", normalize_role_title(F.col("role")).alias("primary"), clean("synonyms").alias("synonyms"), clean("keywords").alias("keywords"), clean("context").alias("context"))


def target_scores(titles: DataFrame, targets: DataFrame) -> DataFrame:
    """``title, law, role, role_ord, score, kind, why`` of the second matcher: the first strategy that fits a role decides."""
    t = titles.select("title", "law").distinct().where("title IS NOT NULL AND title <> ''").withColumn("__t", normalize_role_title(F.col("title")))
    pairs = t.join(F.broadcast(targets), "law")
    each = pairs.select("title", "law", "role", "__t", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("first"), F.lit(0).alias("at"), F.col("primary").alias("s"))), F.transform("synonyms", lambda s, i: F.struct(F.lit(False).alias("first"), i.alias("at"), s.alias("s"))))).alias("x"))
    rated = each.withColumn("__s", token_set_ratio_col(F.col("__t"), F.col("x.s")))
    near = rated.groupBy("title", "law", "role").agg(F.max(F.when(F.col("x.first"), F.col("__s"))).alias("near_primary"), F.max(F.when(~F.col("x.first"), F.struct(F.col("__s").alias("s"), (-F.col("x.at")).alias("at"), F.col("x.s").alias("syn")))).alias("near"))
    p = pairs.join(near, ["title", "law", "role"]).withColumn("near_synonym", F.col("near.s"))
    inside = lambda c: F.filter(c, lambda w: F.contains(F.col("__t"), w))
    k, c = F.size(inside("keywords")), F.size(inside("context"))
    kind = (
        F.when(F.col("__t") == F.col("primary"), "Exact")
        .when(F.array_contains("synonyms", F.col("__t")), "Exact Synonym")
        .when(F.col("near_primary") >= 90, "Fuzzy Primary")
        .when(F.col("near_synonym") >= 85, "Fuzzy Synonym")
        .when((k > 0) & (c > 0), "Context")
    )
    score = (
        F.when(kind == "Exact", 100)
        .when(kind == "Exact Synonym", 95)
        .when(kind == "Fuzzy Primary", F.col("near_primary"))
        .when(kind == "Fuzzy Synonym", F.col("near_synonym") - 2)
        .when(kind == "Context", F.least(F.lit(80), 65 + k * 5 + c * 3))
        .otherwise(0)
    )
    listed = lambda c: F.concat(F.lit("['"), F.array_join(inside(c), "', '"), F.lit("']"))
    # fixed values: how a match is explained
    why = (
        F.when(kind == "Exact", F.concat(F.lit("Exact match: '"), "role", F.lit("'")))
        .when(kind == "Exact Synonym", F.concat(F.lit("Exact synonym: '"), "__t", F.lit("'")))
        .when(kind == "Fuzzy Primary", F.concat(F.lit("Strong fuzzy match: "), "near_primary", F.lit("% similar to '"), "role", F.lit("'")))
        .when(kind == "Fuzzy Synonym", F.concat(F.lit("Fuzzy synonym match: "), "near_synonym", F.lit("% similar to '"), "near.syn", F.lit("'")))
        .when(kind == "Context", F.concat(F.lit("Context match: keywords="), listed("keywords"), F.lit(", context="), listed("context")))
    )
    return p.select("title", "law", "role", "role_ord", score.cast("int").alias("score"), kind.alias("kind"), why.alias("why"))


def match_targets(contacts: DataFrame, targets: DataFrame, least: int = 65) -> DataFrame:
    """``contacts`` with ``target_role, match_score, match_type, match_explanation`` of the best role, the first of equals; null under ``least``."""
    law = F.coalesce(F.col("program_type") == "Law School", F.lit(False))
    c = contacts.withColumn("__law", law)
    s = target_scores(c.select("title", F.col("__law").alias("law")), targets).where(F.col("score") >= least)
    w = Window.partitionBy("title", "law").orderBy(F.desc("score"), "role_ord")
    best = s.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(F.col("title").alias("__t"), F.col("law").alias("__l"), F.col("role").alias("target_role"), F.col("score").alias("match_score"), F.col("kind").alias("match_type"), F.col("why").alias("match_explanation"))
    j = c.join(best, (F.col("title") == F.col("__t")) & (F.col("__law") == F.col("__l")), "left")
    return j.select(*contacts.columns, "target_role", F.coalesce("match_score", F.lit(0)).alias("match_score"), "match_type", "match_explanation")


def filter_by_roles(contacts: DataFrame, targets: DataFrame, least: int = 65) -> DataFrame:
    """Contacts that match a target role, with priority and tier: the best-scored row of each e-mail, the first of equals."""
    m = match_targets(with_seq(contacts), targets, least).where("target_role IS NOT NULL")
    score = priority_score(F.col("match_score"), confidence_in_notes(F.col("notes")) if "notes" in m.columns else F.lit(50), F.col("email"))
    m = m.withColumn("__p", score).withColumn("priority_tier", priority_tier(F.col("__p"))).withColumn("priority_score", F.round("__p", 1))
    return first_per_key(m, [F.col("email")], [F.desc("__p"), F.col("_seq")]).drop("__p")

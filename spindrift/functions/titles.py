"""Job titles: abbreviations, qualifiers, modifiers and exclusions, as one struct-valued expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import any_match, any_within

# fixed values: word tables, in the order in which they apply
ABBREVIATIONS = {
    "dir": "Director", "assoc": "Associate", "asst": "Assistant", "dept": "Department", "coord": "Coordinator", "prog": "Program", "mgr": "Manager",
    "admin": "Administrator", "libn": "Librarian", "prof": "Professor", "adj": "Adjunct", "sr": "Senior", "jr": "Junior", "info": "Information",
    "tech": "Technology", "acad": "Academic", "stud": "Student", "svcs": "Services",
}
TEMPORARY = ["interim", "acting", "temporary", "temp", "provisional", "ad interim", "pro tem", "pro tempore"]
SENIORITY = ["senior", "sr", "junior", "jr", "chief", "lead", "principal"]
SHARED = ["co-director", "co-chair", "co-coordinator", "co director", "co chair", "co coordinator", "joint"]
EMERITUS = ["emeritus", "emerita", "retired", "former", "ex-"]
STUDENT = [r"\bstudent\s+(?:director|coordinator|assistant)", r"graduate\s+assistant", r"student\s+worker", r"work[\s-]?study"]
VISITING = ["visiting", "adjunct", "affiliate", "courtesy", "lecturer"]
SUPPORT = [r"assistant\s+to\s+the", r"aide\s+to", r"executive\s+assistant\s+to"]
DEGREES = r"(?i),\s+(J\.D\.|LL\.M\.|Ph\.D\.|Esq\.|Law School|School of Law)"


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def _taken(steps: list[Column]) -> Column:
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def expand_abbreviations(c: Column) -> tuple[Column, Column]:
    """The title with abbreviations written out, and those it held; each is looked for in what the ones before left."""
    seen = []
    for short, full in ABBREVIATIONS.items():
        pattern = rf"(?i)\b{short}\.?\b"
        seen.append(_found(c, pattern))
        c = F.regexp_replace(c, pattern, full)
    for pattern, to in ((r"\.\.+", "."), (r"\s+\.", "."), (r"\.\s+of", " of")):
        c = F.regexp_replace(c, pattern, to)
    return c, _taken(seen)


def strip_qualifiers(c: Column) -> Column:
    """Without what stands in parentheses, after a spaced dash, and degrees after a comma."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\s+[-–—]\s*.*$", ""), DEGREES, "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def extract_modifiers(c: Column) -> tuple[Column, Column]:
    """The title without words of time and rank, and those words; a co-director's prefix is part of the role."""
    seen = []
    for word in TEMPORARY + SENIORITY:
        pattern = rf"(?i)\b{re.escape(word)}\b"
        seen.append(_found(c, pattern))
        c = F.regexp_replace(c, pattern, "")
    return F.trim(F.regexp_replace(c, r"\s+", " ")), _taken(seen)


def exclusions(c: Column) -> dict[str, Column]:
    """Why a title is left out; what stands in parentheses is no reason."""
    t = F.trim(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""))
    return {"is_emeritus": any_within(t, EMERITUS), "is_student": any_match(t, STUDENT), "is_visiting": any_within(t, VISITING), "is_support_staff": any_match(t, SUPPORT)}


def should_exclude(c: Column) -> Column:
    a, b, x, y = exclusions(F.coalesce(c, F.lit(""))).values()
    return c.isNull() | (c == "") | a | b | x | y


def with_normalized_title(df: DataFrame, title: str = "title", out: str = "normalized_title") -> DataFrame:
    """``df`` with a struct of the normalised title and all that was learned on the way; a null title is an excluded, empty one.

    Every step is a projection of its own, so that no step's expression is repeated within the next.
    """
    step = df.withColumn("__t", F.coalesce(F.col(title), F.lit("")))
    step = step.withColumn("__e", F.col("__t"))
    seen = {"__a": [], "__m": []}

    def take(frame: DataFrame, name: str, patterns: list[tuple[str, str]]) -> DataFrame:
        for i, (pattern, to) in enumerate(patterns):
            frame = frame.withColumns({f"{name}{i}": _found(F.col("__e"), pattern), "__e": F.regexp_replace("__e", pattern, to)})
            seen[name].append(f"{name}{i}")
        return frame.withColumn(name, _taken([F.col(x) for x in seen[name]])).drop(*seen[name])

    step = take(step, "__a", [(rf"(?i)\b{short}\.?\b", full) for short, full in ABBREVIATIONS.items()])
    for pattern, to in ((r"\.\.+", "."), (r"\s+\.", "."), (r"\.\s+of", " of")):
        step = step.withColumn("__e", F.regexp_replace("__e", pattern, to))
    step = take(step.withColumn("__e", strip_qualifiers(F.col("__e"))), "__m", [(rf"(?i)\b{re.escape(w)}\b", "") for w in TEMPORARY + SENIORITY])
    step = step.withColumn("__n", F.trim(F.regexp_replace("__e", r"\s+", " ")))
    why = exclusions(F.col("__t"))
    step = step.withColumns({f"__{k}": v for k, v in why.items()})
    step = step.withColumns({"__temp": F.exists("__m", lambda m: F.lower(m).isin(TEMPORARY)), "__shared": any_match(F.lower("__n"), [rf"\b{re.escape(p)}\b" for p in SHARED])})
    points = lambda c, n, otherwise=0: F.when(c, n).otherwise(otherwise)
    change = points(F.col("__temp"), -3) + points(F.size("__a") > 0, -2, 1) + points(F.col("__is_visiting"), -3) + points(F.col("__shared"), 2)
    empty = F.col("__t") == ""
    told = F.struct(
        F.col(title).alias("original"),
        F.col("__n").alias("normalized"),
        F.col("__m").alias("modifiers"),
        F.col("__temp").alias("is_temporary"),
        *[F.col(f"__{k}").alias(k) for k in ("is_student", "is_emeritus", "is_visiting", "is_support_staff")],
        F.col("__shared").alias("is_shared_role"),
        (empty | F.col("__is_student") | F.col("__is_emeritus") | F.col("__is_visiting") | F.col("__is_support_staff")).alias("should_exclude"),
        F.col("__a").alias("abbreviations_expanded"),
        F.when(empty, 0).otherwise(change).cast("int").alias("confidence_modifier"),
    )
    return step.withColumn(out, told).select(*[c for c in df.columns if c != out], out)


def title_summary(n: Column) -> Column:
    """One line about a normalised title."""
    flags = F.filter(
        F.array(*[F.when(n[k], F.lit(v)) for k, v in (("is_temporary", "Temporary"), ("is_student", "Student"), ("is_emeritus", "Emeritus"), ("is_visiting", "Visiting"), ("is_shared_role", "Shared Role"))]),
        lambda x: x.isNotNull(),
    )
    listed = lambda head, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{head}: "), F.array_join(a, ", ")))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Original: "), n["original"]),
        F.concat(F.lit("Normalized: "), n["normalized"]),
        listed("Modifiers", n["modifiers"]),
        listed("Abbreviations", n["abbreviations_expanded"]),
        listed("Flags", flags),
        F.concat(F.lit("Confidence Modifier: "), F.format_string("%+d", n["confidence_modifier"])),
        F.concat(F.lit("Should Exclude: "), F.initcap(n["should_exclude"].cast("string"))),
    )

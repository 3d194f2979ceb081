"""What the fuzzy matchers give for the made-up titles: found by plain loops in ``tests/brute_roles.py``, as SQL tables."""

from __future__ import annotations

#: title, whether of a law school, role, score, points, other roles
ROLES = [
    ('Law Library Director', True, 'Library Director', 100, 20, 'Law Library Director|Director of Law Library|Associate Law Library Director|Director of the Law Library|Law Librarian|Associate Law Librarian'),
    ('Dir. of Legal Writing', True, 'Legal Writing Director', 100, 18, 'Director of Legal Writing|Director, Legal Writing|Associate Director of Legal Writing|Legal Writing Program Director|IT Director|Director of Information Services'),
    ('Assoc. Dean for Academic Affairs', True, 'Associate Dean for Academic Affairs', 100, 18, 'Associate Dean of Academic Affairs|Associate Dean, Academic Affairs|Assistant Dean for Academic Affairs|Dean of Academic Affairs|Assistant Dean of Academic Affairs|Assistant Dean, Academic Affairs|Associate Dean for Students|Associate Dean for Information Services|Associate Dean of Students'),
    ('Interim Library Director', True, 'Library Director', 100, 18, 'Law Library Director|Associate Law Library Director|Director of Law Library|Director of the Law Library|Information Services Director'),
    ('Professor of Law', True, None, 0, 0, ''),
    ('Co-Director of Clinical Programs', True, 'Clinical Programs Director', 100, 20, 'Director of Clinical Programs|Director, Clinical Programs|Clinical Director|Clinical Faculty Director|Director of Information Services'),
    ('Senior Reference Librarian', True, 'Reference Librarian', 100, 20, 'Head Librarian|Law Librarian|Associate Law Librarian|Head of Reference|Instructional Technology Librarian|Technology Librarian'),
    ('Paralegal Program Director', True, None, 0, 0, ''),
    ('Director, Paralegal Studies', True, None, 0, 0, ''),
    ('Program Coordinator', True, None, 0, 0, ''),
    ('Dean Emeritus', True, None, 0, 0, ''),
    ('Student Worker', True, None, 0, 0, ''),
    ('Visiting Professor', True, None, 0, 0, ''),
    ('Assistant to the Dean', True, None, 0, 0, ''),
    ('Head of Reference (Adjunct)', True, 'Head of Reference', 100, 20, 'Reference Librarian'),
    ('IT Director - Law School', True, 'IT Director', 100, 20, 'Information Services Director|Director of Information Services'),
    ('Acting Chair, Legal Studies', True, None, 0, 0, ''),
    ('Legal Studies Instructor', True, None, 0, 0, ''),
    ('Director of Experiential Learning, J.D.', True, 'Experiential Learning Director', 100, 20, 'Director of Experiential Learning|Director, Experiential Learning|Associate Director of Experiential Learning|Associate Director, Experiential Learning|Experiential Programs Director'),
    ('Dept. Chair', True, None, 0, 0, ''),
    ('Technology Librarian', True, 'Instructional Technology Librarian', 100, 20, 'Technology Librarian|Law Librarian|Head Librarian|Associate Law Librarian|Reference Librarian'),
    ('Prof. of Clinical Law', True, None, 0, 0, ''),
    ('Chief Information Officer', True, 'Information Services Director', 87, 18, 'Associate Dean for Information Services|Associate Dean of Information Services|Assistant Dean for Information Services|Assistant Dean of Information Services|Director of Information Services'),
    ('Workforce Development Dean', True, None, 0, 0, ''),
    ('Legal Writing Program Director', True, 'Legal Writing Program Director', 100, 20, 'Director of Legal Writing|Legal Writing Director|Director, Legal Writing|IT Director|Associate Director of Legal Writing'),
    ('Admin. Asst.', True, None, 0, 0, ''),
    ('Registrar', True, None, 0, 0, ''),
    ('Joint Head Librarian', True, 'Head Librarian', 100, 20, 'Law Librarian|Associate Law Librarian|Reference Librarian|Instructional Technology Librarian|Technology Librarian'),
    ('Academic Success Director', True, None, 0, 0, ''),
    ('Asst. Dir. Law Library', True, 'Director of Law Library', 100, 18, 'Associate Law Library Director|Director of the Law Library|Law Library Director|Law Librarian|Library Director|Associate Law Librarian'),
    ('Dean of Students', True, 'Dean of Students', 100, 20, 'Associate Dean of Students|Associate Dean for Students|Dean of Academic Affairs'),
    ('Reference Librarian', True, 'Reference Librarian', 100, 20, 'Head Librarian|Law Librarian|Associate Law Librarian|Head of Reference|Instructional Technology Librarian|Technology Librarian'),
    ('Law Library Director', False, None, 0, 0, ''),
    ('Dir. of Legal Writing', False, 'Director of Legal Studies', 94, 18, 'Director, Legal Studies|Legal Studies Program Director'),
    ('Assoc. Dean for Academic Affairs', False, 'CTE Dean', 88, 15, ''),
    ('Interim Library Director', False, 'Legal Studies Program Director', 79, 9, ''),
    ('Professor of Law', False, 'Legal Studies Professor', 77, 12, ''),
    ('Co-Director of Clinical Programs', False, 'Director of Legal Studies', 70, 11, 'Dean of Workforce Programs'),
    ('Senior Reference Librarian', False, None, 0, 0, ''),
    ('Paralegal Program Director', False, 'Paralegal Program Director', 100, 20, 'Director of Paralegal Program|Paralegal Program Coordinator|Paralegal Studies Program Director|Legal Studies Program Director|Program Chair|Program Coordinator|Paralegal Instructor|Director, Paralegal Studies|Paralegal Coordinator|Director of Paralegal Studies|Paralegal Studies Coordinator'),
    ('Director, Paralegal Studies', False, 'Director of Paralegal Studies', 100, 20, 'Director, Paralegal Studies|Director, Legal Studies|Paralegal Studies Program Director|Paralegal Studies Coordinator|Director of Legal Studies|Paralegal Studies Faculty|Chair, Legal Studies|Paralegal Studies Department Chair|Paralegal Studies Professor|Legal Studies Instructor|Legal Studies Program Director|Director of Paralegal Program|Legal Studies Faculty|Legal Studies Coordinator|Legal Studies Lecturer|Paralegal Program Director|Legal Studies Professor|Paralegal Instructor|Legal Studies Department Chair'),
    ('Program Coordinator', False, 'Program Coordinator', 100, 20, 'Program Chair|Legal Studies Program Director|Legal Studies Coordinator|Paralegal Program Coordinator'),
    ('Dean Emeritus', False, None, 0, 0, ''),
    ('Student Worker', False, None, 0, 0, ''),
    ('Visiting Professor', False, None, 0, 0, ''),
    ('Assistant to the Dean', False, None, 0, 0, ''),
    ('Head of Reference (Adjunct)', False, 'Dean of Career Education', 72, 9, 'Dean of Workforce Programs|Dean of Career and Technical Education'),
    ('IT Director - Law School', False, 'Legal Studies Program Director', 90, 20, 'Director of Legal Studies|Director, Legal Studies'),
    ('Acting Chair, Legal Studies', False, 'Chair, Legal Studies', 100, 18, 'Director, Legal Studies|Director of Legal Studies|Legal Studies Program Director|Legal Studies Coordinator|Legal Studies Department Chair|Legal Studies Faculty|Legal Studies Instructor|Legal Studies Professor|Legal Studies Lecturer'),
    ('Legal Studies Instructor', False, 'Legal Studies Instructor', 100, 20, 'Director, Legal Studies|Director of Legal Studies|Legal Studies Coordinator|Legal Studies Faculty|Legal Studies Program Director|Chair, Legal Studies|Legal Studies Lecturer|Legal Studies Professor|Legal Studies Department Chair'),
    ('Director of Experiential Learning, J.D.', False, 'Director of Legal Studies', 73, 9, ''),
    ('Dept. Chair', False, 'Department Chair', 100, 18, 'Legal Studies Department Chair|Department Head|Paralegal Studies Department Chair'),
    ('Technology Librarian', False, None, 0, 0, ''),
    ('Prof. of Clinical Law', False, None, 0, 0, ''),
    ('Chief Information Officer', False, None, 0, 0, ''),
    ('Workforce Development Dean', False, 'Workforce Development Dean', 100, 20, 'CTE Dean|Dean of Workforce Programs|Dean, Workforce Programs'),
    ('Legal Writing Program Director', False, 'Legal Studies Program Director', 93, 20, 'Program Chair|Program Coordinator|Director of Legal Studies|Director, Legal Studies'),
    ('Admin. Asst.', False, None, 0, 0, ''),
    ('Registrar', False, None, 0, 0, ''),
    ('Joint Head Librarian', False, None, 0, 0, ''),
    ('Academic Success Director', False, None, 0, 0, ''),
    ('Asst. Dir. Law Library', False, None, 0, 0, ''),
]

#: title, whether of a law school, target role, score, kind, explanation
TARGETS = [
    ('Law Library Director', True, 'Law Library Director', 100, 'Exact', "Exact match: 'Law Library Director'"),
    ('Dir. of Legal Writing', True, 'Legal Writing Director', 87, 'Fuzzy Synonym', "Fuzzy synonym match: 89% similar to 'director of legal writing'"),
    ('Assoc. Dean for Academic Affairs', True, 'Associate Dean for Academic Affairs', 94, 'Fuzzy Primary', "Strong fuzzy match: 94% similar to 'Associate Dean for Academic Affairs'"),
    ('Interim Library Director', True, 'Law Library Director', 98, 'Fuzzy Synonym', "Fuzzy synonym match: 100% similar to 'library director'"),
    ('Professor of Law', True, None, 0, None, None),
    ('Co-Director of Clinical Programs', True, 'Experiential Learning Director', 98, 'Fuzzy Synonym', "Fuzzy synonym match: 100% similar to 'clinical director'"),
    ('Senior Reference Librarian', True, 'Instructional Technology Librarian', 84, 'Fuzzy Synonym', "Fuzzy synonym match: 86% similar to 'it librarian'"),
    ('Paralegal Program Director', True, None, 0, None, None),
    ('Director, Paralegal Studies', True, None, 0, None, None),
    ('Program Coordinator', True, None, 0, None, None),
    ('Dean Emeritus', True, None, 0, None, None),
    ('Student Worker', True, None, 0, None, None),
    ('Visiting Professor', True, None, 0, None, None),
    ('Assistant to the Dean', True, 'Associate Dean for Academic Affairs', 73, 'Context', "Context match: keywords=['dean'], context=['assistant']"),
    ('Head of Reference (Adjunct)', True, None, 0, None, None),
    ('IT Director - Law School', True, None, 0, None, None),
    ('Acting Chair, Legal Studies', True, None, 0, None, None),
    ('Legal Studies Instructor', True, None, 0, None, None),
    ('Director of Experiential Learning, J.D.', True, 'Experiential Learning Director', 100, 'Fuzzy Primary', "Strong fuzzy match: 100% similar to 'Experiential Learning Director'"),
    ('Dept. Chair', True, None, 0, None, None),
    ('Technology Librarian', True, 'Instructional Technology Librarian', 95, 'Exact Synonym', "Exact synonym: 'technology librarian'"),
    ('Prof. of Clinical Law', True, None, 0, None, None),
    ('Chief Information Officer', True, None, 0, None, None),
    ('Workforce Development Dean', True, None, 0, None, None),
    ('Legal Writing Program Director', True, 'Legal Writing Director', 95, 'Exact Synonym', "Exact synonym: 'legal writing program director'"),
    ('Admin. Asst.', True, None, 0, None, None),
    ('Registrar', True, None, 0, None, None),
    ('Joint Head Librarian', True, 'Law Library Director', 98, 'Fuzzy Synonym', "Fuzzy synonym match: 100% similar to 'head librarian'"),
    ('Academic Success Director', True, None, 0, None, None),
    ('Asst. Dir. Law Library', True, None, 0, None, None),
    ('Law Library Director', False, None, 0, None, None),
    ('Dir. of Legal Writing', False, None, 0, None, None),
    ('Assoc. Dean for Academic Affairs', False, 'Academic Affairs', 100, 'Fuzzy Primary', "Strong fuzzy match: 100% similar to 'Academic Affairs'"),
    ('Interim Library Director', False, None, 0, None, None),
    ('Professor of Law', False, None, 0, None, None),
    ('Co-Director of Clinical Programs', False, None, 0, None, None),
    ('Senior Reference Librarian', False, None, 0, None, None),
    ('Paralegal Program Director', False, 'Paralegal Program Director', 100, 'Exact', "Exact match: 'Paralegal Program Director'"),
    ('Director, Paralegal Studies', False, 'Paralegal Program Director', 95, 'Exact Synonym', "Exact synonym: 'director paralegal studies'"),
    ('Program Coordinator', False, 'Paralegal Program Director', 98, 'Fuzzy Synonym', "Fuzzy synonym match: 100% similar to 'paralegal program coordinator'"),
    ('Dean Emeritus', False, None, 0, None, None),
    ('Student Worker', False, None, 0, None, None),
    ('Visiting Professor', False, None, 0, None, None),
    ('Assistant to the Dean', False, None, 0, None, None),
    ('Head of Reference (Adjunct)', False, None, 0, None, None),
    ('IT Director - Law School', False, None, 0, None, None),
    ('Acting Chair, Legal Studies', False, 'Program Chair', 98, 'Fuzzy Synonym', "Fuzzy synonym match: 100% similar to 'chair legal studies'"),
    ('Legal Studies Instructor', False, 'Legal Studies Faculty', 95, 'Exact Synonym', "Exact synonym: 'legal studies instructor'"),
    ('Director of Experiential Learning, J.D.', False, None, 0, None, None),
    ('Dept. Chair', False, None, 0, None, None),
    ('Technology Librarian', False, None, 0, None, None),
    ('Prof. of Clinical Law', False, None, 0, None, None),
    ('Chief Information Officer', False, None, 0, None, None),
    ('Workforce Development Dean', False, 'Dean of Workforce Programs', 95, 'Exact Synonym', "Exact synonym: 'workforce development dean'"),
    ('Legal Writing Program Director', False, None, 0, None, None),
    ('Admin. Asst.', False, None, 0, None, None),
    ('Registrar', False, None, 0, None, None),
    ('Joint Head Librarian', False, None, 0, None, None),
    ('Academic Success Director', False, 'Academic Affairs', 95, 'Exact Synonym', "Exact synonym: 'academic success director'"),
    ('Asst. Dir. Law Library', False, None, 0, None, None),
]

#: title, role in lower case, ratio, best window, token order, token set
RATIOS = [
    ('Law Library Director', 'law library director', 100, 100, 100, 100),
    ('Law Library Director', 'program coordinator', 41, 50, 41, 41),
    ('Dir. of Legal Writing', 'law library director', 29, 36, 40, 40),
    ('Dir. of Legal Writing', 'program coordinator', 40, 43, 36, 36),
    ('Assoc. Dean for Academic Affairs', 'law library director', 35, 35, 35, 35),
    ('Assoc. Dean for Academic Affairs', 'program coordinator', 35, 42, 32, 32),
    ('Interim Library Director', 'law library director', 77, 92, 77, 89),
    ('Interim Library Director', 'program coordinator', 42, 50, 47, 47),
    ('Professor of Law', 'law library director', 22, 36, 33, 44),
    ('Professor of Law', 'program coordinator', 40, 46, 40, 40),
    ('Co-Director of Clinical Programs', 'law library director', 31, 52, 46, 57),
    ('Co-Director of Clinical Programs', 'program coordinator', 39, 52, 59, 59),
    ('Senior Reference Librarian', 'law library director', 35, 53, 30, 30),
    ('Senior Reference Librarian', 'program coordinator', 31, 40, 31, 31),
    ('Paralegal Program Director', 'law library director', 61, 69, 61, 61),
    ('Paralegal Program Director', 'program coordinator', 58, 74, 58, 58),
    ('Director, Paralegal Studies', 'law library director', 34, 57, 57, 57),
    ('Director, Paralegal Studies', 'program coordinator', 30, 39, 44, 44),
    ('Program Coordinator', 'law library director', 41, 50, 41, 41),
    ('Program Coordinator', 'program coordinator', 100, 100, 100, 100),
    ('Dean Emeritus', 'law library director', 30, 32, 30, 30),
    ('Dean Emeritus', 'program coordinator', 31, 38, 25, 25),
    ('Student Worker', 'law library director', 29, 45, 41, 41),
    ('Student Worker', 'program coordinator', 30, 48, 36, 36),
    ('Visiting Professor', 'law library director', 32, 40, 32, 32),
    ('Visiting Professor', 'program coordinator', 27, 35, 32, 32),
    ('Assistant to the Dean', 'law library director', 29, 38, 24, 24),
    ('Assistant to the Dean', 'program coordinator', 25, 32, 30, 30),
    ('Head of Reference (Adjunct)', 'law library director', 34, 36, 36, 36),
    ('Head of Reference (Adjunct)', 'program coordinator', 30, 32, 32, 32),
    ('IT Director - Law School', 'law library director', 45, 65, 67, 75),
    ('IT Director - Law School', 'program coordinator', 37, 42, 34, 34),
    ('Acting Chair, Legal Studies', 'law library director', 38, 42, 35, 35),
    ('Acting Chair, Legal Studies', 'program coordinator', 26, 39, 36, 36),
    ('Legal Studies Instructor', 'law library director', 50, 50, 50, 50),
    ('Legal Studies Instructor', 'program coordinator', 42, 42, 37, 37),
    ('Director of Experiential Learning, J.D.', 'law library director', 27, 57, 49, 57),
    ('Director of Experiential Learning, J.D.', 'program coordinator', 34, 47, 32, 32),
    ('Dept. Chair', 'law library director', 26, 42, 27, 27),
    ('Dept. Chair', 'program coordinator', 33, 33, 34, 34),
    ('Technology Librarian', 'law library director', 45, 53, 35, 35),
    ('Technology Librarian', 'program coordinator', 36, 44, 36, 36),
    ('Prof. of Clinical Law', 'law library director', 24, 32, 40, 45),
    ('Prof. of Clinical Law', 'program coordinator', 40, 46, 46, 46),
    ('Chief Information Officer', 'law library director', 36, 40, 36, 36),
    ('Chief Information Officer', 'program coordinator', 32, 40, 41, 41),
    ('Workforce Development Dean', 'law library director', 30, 39, 30, 30),
    ('Workforce Development Dean', 'program coordinator', 31, 37, 31, 31),
    ('Legal Writing Program Director', 'law library director', 60, 69, 60, 60),
    ('Legal Writing Program Director', 'program coordinator', 53, 74, 53, 54),
    ('Admin. Asst.', 'law library director', 25, 33, 27, 27),
    ('Admin. Asst.', 'program coordinator', 39, 53, 34, 34),
    ('Registrar', 'law library director', 28, 53, 41, 41),
    ('Registrar', 'program coordinator', 36, 53, 36, 36),
    ('Joint Head Librarian', 'law library director', 45, 53, 50, 50),
    ('Joint Head Librarian', 'program coordinator', 31, 40, 41, 41),
    ('Academic Success Director', 'law library director', 49, 62, 40, 57),
    ('Academic Success Director', 'program coordinator', 41, 43, 32, 32),
    ('Asst. Dir. Law Library', 'law library director', 52, 71, 75, 75),
    ('Asst. Dir. Law Library', 'program coordinator', 29, 36, 31, 31),
]


def values(rows: list[tuple], names: str) -> str:
    """A table of constants: numbers are 32 bits wide."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return f"CAST({v} AS INT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({names}))"


ROLE_TABLE = values(ROLES, "title, law, role, score, points, others")
TARGET_TABLE = values(TARGETS, "title, law, role, score, kind, why")
RATIO_TABLE = values(RATIOS, "title, b, ratio, partial_ratio, token_sort, token_set")

"""Pages: classification by rules, links to follow, and the sections that hold contacts.

The tree of a page is looked at in Arrow batches, once for each operator; rules and scores are column expressions.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dom import Element, parse
from ..functions.emails import recover
from ..functions.rules import any_match, any_within, first_match
from ..functions.text import EMAIL, EMAIL_WHOLE, PHONE
from ..functions.urls import domain_key, normalize_url, same_site, valid_url, without_fragment

# fixed values: page types by URL, in order
PAGE_RULES = [
    (r"/directory\b", "directory_listing", 80), ("/staff-directory", "directory_listing", 90), ("/faculty-directory", "directory_listing", 90),
    ("/faculty-profiles$", "directory_listing", 85), ("/staff-profiles$", "directory_listing", 85), ("/our-faculty/[^/]+$", "directory_listing", 80),
    ("/our-staff/[^/]+$", "directory_listing", 80), ("/personnel", "directory_listing", 85), (r"/people\b", "directory_listing", 75),
    ("/our-people", "directory_listing", 80), (r"/team\b", "directory_listing", 70), ("/profile/[^/]+$", "individual_profile", 85),
    ("/bio/[^/]+$", "individual_profile", 85), ("/faculty/[^/]+$", "individual_profile", 75), ("/staff/[^/]+$", "individual_profile", 75),
    ("/people/[^/]+$", "individual_profile", 70), (r"/search\?", "search_results", 80), (r"[\?&]q=", "search_results", 75),
    (r"[\?&]search=", "search_results", 75), ("/contact-us", "contact_form", 80), (r"/contact\b", "contact_form", 70),
    ("/student-directory", "student_directory", -100), ("/student-profiles", "student_directory", -100), ("/students/directory", "student_directory", -100),
    (r"/grades\b", "portal", -100), (r"/portal\b", "portal", -100), (r"/login\b", "portal", -100), (r"apps\.", "portal", -80),
    (r"outlook\.office", "social_media", -100), (r"instagram\.com", "social_media", -100), (r"twitter\.com", "social_media", -100),
    (r"facebook\.com", "social_media", -100), (r"linkedin\.com", "social_media", -100), (r"youtube\.com", "social_media", -100), (r"bluesky\.", "social_media", -100),
]
DIRECTORY_PARTS = ["profile-card", "person-card", "staff-card", "faculty-card", "directory-item", "people-list", "staff-list", "faculty-list", "personnel-item", "team-member", "employee-item"]
PROFILE_PARTS = ["profile-detail", "bio-content", "person-detail", "faculty-bio", "contact-info", "profile-header", "biography", "cv-content"]
STUDENT_PARTS = ["student-profile", "student-card", "student-directory", "class-of-", "graduation-year", "jd-candidate", "llm-student"]
DIRECTORY_HEADINGS = ["directory", "our team", "our people", "staff", "faculty"]
PERSON_PATHS = ["/profile/", "/bio/", "/faculty/", "/staff/", "/people/"]
# fixed values: links to directory pages, by tier, and those never followed
HIGH = ["profile", "directory", "personnel", "bio", "roster", "listing"]
MEDIUM = ["faculty(?!.*scholarship)(?!.*workshop)", "staff(?!.*portal)", r"people(?!.*\babout\b)", "administration", "leadership", "team"]
LOW = ["about.*people", "about.*staff", "about.*faculty", "contact.*directory"]
EXTRA = {"law": (["library.*staff", "faculty.*profiles"], ["clinical.*faculty", "academic.*affairs"]), "paralegal": (["paralegal.*faculty", "legal.*studies.*faculty"], ["department.*staff"])}
NEVER = [
    "admissions?(?!.*staff)", "scholarship", "workshop", "apply", "contact-us", r"contact\b(?!.*directory)", "news", "events?", "calendar", "student.*portal",
    "student.*directory", "student.*profiles?", "student.*roster", r"grades?\b", r"portal\b", "alumni", "donate", "giving", r"instagram\.com", r"twitter\.com",
    r"facebook\.com", r"linkedin\.com", r"youtube\.com", r"bluesky\.", r"outlook\.office",
]
# fixed values: links to profiles
PROFILE_URLS = [
    ("/profile/[^/]+$", 90), ("/profiles/[^/]+$", 90), ("/bio/[^/]+$", 85), ("/bios/[^/]+$", 85), ("/faculty/[^/]+/[^/]+$", 80), ("/staff/[^/]+/[^/]+$", 80),
    ("/people/[^/]+/[^/]+$", 75), ("/directory/[^/]+$", 70), (r"/directory\?.*person", 65), ("/team/[^/]+$", 70), (r"\?id=\d+", 50), (r"/\d+$", -20),
]
NOT_PROFILES = [
    "/student", "/admissions", "/apply", "/events", "/news", "/blog", "/publications", "/press", "/calendar", "/courses", "/programs", r"\.pdf$", r"\.doc$",
    r"\.jpg$", r"\.png$", "mailto:", "^#", "javascript:",
]
SOCIAL = ["linkedin.com", "twitter.com", "facebook.com", "instagram.com", "youtube.com", "vimeo.com", "researchgate.net", "academia.edu"]
TITLE_WORDS = ["director", "dean", "professor", "librarian", "administrator"]
ACTIONS = ["view profile", "read bio", "learn more", "see bio"]
CARD_PARTS = ["profile", "person", "faculty", "staff", "bio", "member", "card"]
# fixed values: sections of contacts
SECTION_PARTS = ["profile", "person", "staff", "faculty", "contact", "member", "bio", "card", "directory", "employee", "team", "user", "individual", "personnel", "listing", "item", "entry", "record"]
JOB_WORDS = ["director", "dean", "professor", "librarian", "coordinator", "chair", "head", "assistant", "associate", "chief", "manager", "registrar", "administrator", "counsel", "officer"]

FEATURES = "person_blocks int, directory_heading boolean, long_bio boolean, h1_words int, student_heading boolean, person_links int, text_chars int, mailto_links int, contact_blocks int"
LINKS = "array<struct<ord:int,href:string,text:string,parent_class:string,siblings:int,prev_img:boolean,context:string>>"


def _words(s: str) -> list[str]:
    return s.replace("​", "").split()


def _tidy(s: str) -> str:
    return " ".join(_words(s))


def page_features(html: Column) -> Column:
    """What the classifier needs of a page's tree, as one struct."""

    def one(h: str | None) -> dict:
        root = parse(h)
        headings = [x.text().lower() for x in root.all("h1 h2 h3")]
        bio = [x for x in root.all("div section") if any(re.search("bio|about|profile|cv", c, re.I) for c in x.classes.split())]
        h1 = root.first("h1")
        links = [x for x in root.all("a") if "href" in x.attrs]
        person = lambda x: any(p in x.attrs["href"].lower() for p in PERSON_PATHS) or 2 <= len(x.text().split()) <= 4
        blocks = lambda names: sum(1 for x in root.all("div article section") if any(re.search(names, c, re.I) for c in x.classes.split()))
        return {
            "person_blocks": blocks("person|profile|staff|faculty|member"),
            "directory_heading": any(w in t for t in headings for w in DIRECTORY_HEADINGS),
            "long_bio": any(len(x.text()) > 200 for x in bio),
            "h1_words": len(h1.text().split()) if h1 else -1,
            "student_heading": any("student" in t and any(w in t for w in ("directory", "profiles", "roster")) for t in headings),
            "person_links": sum(1 for x in links if person(x)),
            "text_chars": len("".join(s.strip() for s in root.text("\0").split("\0"))),
            "mailto_links": sum(1 for x in links if "mailto:" in x.attrs["href"].lower()),
            "contact_blocks": blocks("profile|person|staff|faculty|contact"),
        }

    @F.pandas_udf(FEATURES)
    def run(pages):
        import pandas as pd

        return pd.DataFrame([one(h) for h in pages], columns=[x.split()[0] for x in FEATURES.split(", ")])

    return run(html)


def url_type(url: Column) -> Column:
    """struct(type, score) of the first rule that fits the URL in lower case; home pages; else null."""
    u = F.lower(F.coalesce(url, F.lit("")))
    home = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1).isin("/", "", "/index.html", "/index.php") & u.rlike("^[a-z][a-z0-9+.-]*://")
    value = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("score"))
    return first_match(u, [(p, value(t, s)) for p, t, s in PAGE_RULES], F.when(home, value("homepage", 70)))


def _parts(html: Column, parts: list[str], points: int) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    out = F.lit(0)
    for p in parts:
        out = out + F.when(F.contains(low, F.lit(p)), points).otherwise(0)
    return out


def directory_score(html: Column, f: Column) -> Column:
    return F.least(F.lit(70), _parts(html, DIRECTORY_PARTS, 15) + F.when(f["person_blocks"] >= 3, 30).otherwise(0) + F.when(f["directory_heading"], 20).otherwise(0))


def profile_score(html: Column, f: Column) -> Column:
    return F.least(F.lit(70), _parts(html, PROFILE_PARTS, 15) + F.when(f["long_bio"], 25).otherwise(0) + F.when(f["h1_words"].between(2, 4), 15).otherwise(0))


def student_score(html: Column, f: Column) -> Column:
    return _parts(html, STUDENT_PARTS, 30) + F.when(f["student_heading"], 50).otherwise(0)


def heading_type(heading: Column) -> Column:
    """struct(type, score): a directory's heading, or what looks like a name; else null."""
    w = F.filter(F.split(F.trim(F.coalesce(heading, F.lit(""))), r"(?U)\s+"), lambda x: x != "")
    name = F.size(w).between(2, 4) & F.forall(w, lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}"))
    value = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("score"))
    return F.when(any_within(F.lower(heading), DIRECTORY_HEADINGS), value("directory_listing", 25)).when(name, value("individual_profile", 20))


def classify(pages: DataFrame, url_col: str = "url", html_col: str = "html", heading: Column | None = None) -> DataFrame:
    """``pages`` with ``page_type, confidence, excluded, is_directory, is_profile``.

    Scores of the URL, the page's parts, its links and its heading add up by type; the best wins, of equals the one
    first named. A page of students is worth -100 as such, which wins only alone. Nothing at all: irrelevant, 50.
    """
    f = F.col("__f")
    u, h = url_type(F.col(url_col)), heading_type(heading) if heading is not None else F.lit(None).cast("struct<type:string,score:int>")
    html = F.col(html_col)
    d, p, s = directory_score(html, f), profile_score(html, f), student_score(html, f)
    d = d + F.when(f["person_links"] > 20, 20).otherwise(0)
    p = p + F.when(f["person_links"] < 5, 15).otherwise(0)
    votes = [F.when(u.isNotNull(), F.struct(F.lit(0).alias("o"), u["type"].alias("t"), u["score"].alias("s")))]
    votes += [F.when(x > 0, F.struct(F.lit(i + 1).alias("o"), F.lit(t).alias("t"), x.alias("s"))) for i, (t, x) in enumerate((("directory_listing", d), ("individual_profile", p)))]
    votes += [F.when(s > 0, F.struct(F.lit(3).alias("o"), F.lit("student_directory").alias("t"), F.lit(-100).alias("s")))]
    votes += [F.when(h.isNotNull(), F.struct(F.lit(4).alias("o"), h["type"].alias("t"), h["score"].alias("s")))]
    told = pages.withColumn("__f", page_features(html)).withColumn("__v", F.filter(F.array(*votes), lambda x: x.isNotNull()))
    types = F.array_distinct(F.transform("__v", lambda x: x["t"]))

    def total(t: Column) -> Column:
        own = F.filter("__v", lambda x: x["t"] == t)
        add = F.aggregate(own, F.lit(0), lambda a, x: a + x["s"])
        return F.struct(F.when(t == "student_directory", F.lit(-100)).otherwise(add).alias("s"), (-F.array_min(F.transform(own, lambda x: x["o"]))).alias("o"), t.alias("t"))

    told = told.withColumn("__b", F.array_max(F.transform(types, total)))
    kind, score = F.coalesce(F.col("__b.t"), F.lit("irrelevant")), F.coalesce(F.col("__b.s"), F.lit(50))
    out = told.withColumn("page_type", kind).withColumn("confidence", score.cast("int"))
    out = out.withColumn("excluded", F.col("page_type").isin("student_directory", "portal", "social_media") | (F.col("confidence") < 0))
    for name, t in (("is_directory", "directory_listing"), ("is_profile", "individual_profile")):
        out = out.withColumn(name, (F.col("page_type") == t) & (F.col("confidence") > 50))
    return out.drop("__f", "__v", "__b")


def has_contact_content(f: Column) -> Column:
    """struct(has, lacks) by the numbers of a page's mail links and contact blocks."""
    return F.struct(
        ((f["mailto_links"] > 5) | (f["contact_blocks"] > 5)).alias("has"),
        ((f["text_chars"] < 500) | ((f["mailto_links"] == 0) & (f["contact_blocks"] == 0))).alias("lacks"),
    )


def page_links(html: Column, base: Column) -> Column:
    """All links of a page, resolved, with what stands around each."""

    def one(h: str | None, b: str | None) -> list[dict]:
        out = []
        for i, x in enumerate(y for y in parse(h).all("a") if "href" in y.attrs):
            parent, cls = x.parent, x.parent.classes.lower() if x.parent else ""
            box = parent.up("div ul section") if parent is not None else None
            like = sum(1 for y in box.all(parent.tag) if not parent.attrs.get("class") or y.classes == parent.classes) if box is not None else 0
            try:
                href = urljoin(b or "", x.attrs["href"])
            except ValueError:
                continue
            out.append({"ord": i, "href": href, "text": _tidy(x.text()), "parent_class": cls, "siblings": like, "prev_img": any(y.tag in ("img", "picture") for y in x.before()), "context": _tidy(parent.text())[:200] if parent is not None else ""})
        return out

    @F.pandas_udf(LINKS)
    def run(pages, bases):
        import pandas as pd

        return pd.Series([one(h, b) for h, b in zip(pages, bases, strict=True)])

    return run(html, base)


def links_of(pages: DataFrame, key: str = "page_id", html_col: str = "html", base_col: str = "url") -> DataFrame:
    """A row a link: ``key``, the page's URL as ``base``, and the link's own fields."""
    rows = pages.select(key, F.col(base_col).alias("base"), F.explode(page_links(F.col(html_col), F.col(base_col))).alias("l"))
    return rows.select(key, "base", "l.*")


def directory_tier(href: Column, text: Column, program: str | None = None) -> Column:
    """100, 50 or 25 by the first tier of patterns that fits the link or its text; 0 for none or what is never followed."""
    more = EXTRA.get(program or "", ([], []))
    either = lambda ps: any_match(href, ps) | any_match(text, ps)
    return F.when(either(NEVER), 0).when(either(HIGH + more[0]), 100).when(either(MEDIUM + more[1]), 50).when(either(LOW), 25).otherwise(0)


def directory_pages(links: DataFrame, key: str = "page_id", program: str | None = None, most: int | None = None) -> DataFrame:
    """``key, url, score``: a page's links to directories, each once at its best score; the best ``most`` of them."""
    scored = links.withColumn("score", directory_tier(F.lower("href"), F.lower("text"), program)).where((F.col("score") > 0) & valid_url(F.col("href")))
    per = scored.groupBy(key, normalize_url(F.col("href")).alias("url")).agg(F.max("score").alias("score"), F.min("ord").alias("__o"))
    if most is not None:
        per = per.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "__o"))).where(F.col("__rn") <= most).drop("__rn")
    return per.drop("__o")


def directories_or_home(pages: DataFrame, links: DataFrame, key: str = "page_id", url_col: str = "url", program: str | None = None, most: int = 5) -> DataFrame:
    """``key, url, score``: a page's best directory pages; its own URL, score 0, where it has none."""
    found = directory_pages(links, key, program, most)
    rest = pages.join(found.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return found.unionByName(rest.select(key, normalize_url(F.col(url_col)).alias("url"), F.lit(0).alias("score")))


def profile_link_score(url: Column, text: Column, parent_class: Column, siblings: Column, prev_img: Column) -> Column:
    u, t = F.lower(url), F.lower(text)
    w = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda x: x != "")
    upper = lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}")
    name = F.when(F.size(w).between(2, 4), F.when(F.forall(F.filter(w, lambda x: F.length(x) > 1), upper), 40).when(F.exists(w, upper), 20).otherwise(0)).otherwise(0)
    yes = lambda c, n: F.when(c, n).otherwise(0)
    score = first_match(u, PROFILE_URLS, F.lit(0)) + name + yes(any_within(t, TITLE_WORDS), 10) + yes(any_within(t, ACTIONS), 15)
    score = score + yes(any_within(parent_class, CARD_PARTS), 25) + yes(siblings >= 3, 15) + yes(prev_img, 10)
    return F.when(any_match(u, NOT_PROFILES) | any_within(domain_key(url), SOCIAL), 0).otherwise(F.least(F.lit(100), score))


def profile_links(links: DataFrame, key: str = "page_id", least: int = 40, most: int = 30) -> DataFrame:
    """``key, url, score, text, ord``: a page's links to profiles on its own site, each URL once, the best ``most``."""
    s = profile_link_score(F.col("href"), F.col("text"), F.col("parent_class"), F.col("siblings"), F.col("prev_img"))
    good = links.where(same_site(domain_key(F.col("href")), domain_key(F.col("base")))).withColumn("score", s).where(F.col("score") >= least)
    first = good.withColumn("__rn", F.row_number().over(Window.partitionBy(key, "href").orderBy("ord"))).where("__rn = 1")
    top = first.withColumn("__rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord"))).where(F.col("__rk") <= most)
    return top.select(key, F.col("href").alias("url"), "score", "text", "ord")


def deduplicate_links(links: DataFrame) -> DataFrame:
    """``url, score, ord`` once for each URL without its fragment: the best score, the first of equals."""
    w = Window.partitionBy(without_fragment(F.col("url"))).orderBy(F.desc("score"), "ord")
    return links.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def link_summary(links: DataFrame, key: str = "page_id") -> DataFrame:
    a = links.agg(F.count("*").alias("links"), F.count_distinct(key).alias("pages"))
    return a.select("links", "pages", F.when(F.col("pages") > 0, F.round(F.col("links") / F.col("pages"), 1)).otherwise(0.0).alias("per_page"))


def _section(s: Element) -> dict | None:
    text = s.text(" ")
    named = s.first(test=lambda x: x.attrs.get("itemprop") == "name")
    name = _tidy(named.text()) if named else ""
    titles = [_tidy(x.text()) for x in s.all(test=lambda x: x.attrs.get("itemprop") == "jobTitle")]
    title = " | ".join(titles)
    if not name:
        by = None
        for x in s.all("h1 h2 h3 h4 h5 strong b span div"):
            cls, own = x.classes.lower(), _tidy(x.text())
            if any(k in cls for k in ("name", "title", "heading")) and not name and len(own) > 3 and len(own.split()) >= 2:
                name, by = own, x
            if not title and x is not by and any(k in cls for k in ("position", "role", "job", "jobtitle")) and len(own) > 5:
                title = own
    if not name:
        for line in map(_tidy, text.split("\n")[:5]):
            if len(line.split()) >= 2 and len(line) < 50 and all(w[0].isupper() for w in line.split()):
                name = line
                break
    mail = s.first("a", lambda x: x.attrs.get("itemprop") == "email") or s.first("a", lambda x: "mailto:" in x.attrs.get("href", "").lower())
    if mail:
        href = mail.attrs.get("href", "").strip()
        if href.startswith("mailto:"):
            email = href.replace("mailto:", "").strip()
            email = email if re.match(EMAIL_WHOLE, email) else ""
        else:
            m = re.search(EMAIL, mail.text())
            email = m[0] if m else ""
    else:
        m = re.search(EMAIL, text)
        email = m[0] if m else ""
    tel = s.first("a", lambda x: x.attrs.get("itemprop") == "telephone") or s.first("a", lambda x: "tel:" in x.attrs.get("href", "").lower())
    if tel:
        phone = tel.attrs.get("href", "").replace("tel:", "").strip() or _tidy(tel.text())
    else:
        m = re.search(PHONE, text)
        phone = m[0] if m else ""
    if not title:
        for x in s.all("li p div"):
            own = _tidy(x.text())
            if "@" not in own and own != name and any(k in own.lower() for k in JOB_WORDS) and 5 < len(own) < 150:
                title = own
                break
    if not title:
        for line in map(_tidy, text.split("\n")):
            if any(k in line.lower() for k in JOB_WORDS) and 5 < len(line) < 100:
                title = line
                break
    return {"full_name": name, "title": title, "email": email, "phone": phone}


def _outer(x: Element) -> str:
    """Markup enough of an element to look for hidden addresses in it."""
    attrs = "".join(f' {k}="{v}"'.replace("\n", " ") for k, v in x.attrs.items() if '"' not in v)
    return f"<{x.tag}{attrs}>" + "".join(k if isinstance(k, str) else _outer(k) for k in x.kids) + f"</{x.tag}>"


def find_sections(root: Element) -> list[Element]:
    """Elements whose class speaks of a person; else the rows of tables; else what surrounds marked-up names."""
    out = [x for x in root.all("div section article li") if any(k in x.classes.lower() for k in SECTION_PARTS)]
    if not out:
        out = [r for t in root.all("table") for r in t.all("tr")]
    if not out:
        for x in root.all(test=lambda x: re.search("name|email|jobTitle", x.attrs.get("itemprop", ""), re.I) is not None):
            box = x.up("div section article li tr")
            if box is not None and not any(box is y for y in out):
                out.append(box)
    return out


SECTIONS = "array<struct<ord:int,full_name:string,title:string,email:string,phone:string>>"


def page_sections(html: Column) -> Column:
    """The contacts of a page's sections: whatever name, title, e-mail and phone each shows; with a name or an e-mail."""

    def one(h: str | None) -> list[dict]:
        out = []
        for i, s in enumerate(find_sections(parse(h))):
            got = _section(s)
            if not got["email"]:
                got["email"] = next(iter(recover(_outer(s))["all"]), "")
            if got["full_name"] or got["email"]:
                out.append({"ord": i} | got)
        return out

    @F.pandas_udf(SECTIONS)
    def run(pages):
        import pandas as pd

        return pd.Series([one(h) for h in pages])

    return run(html)


def contacts_of(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """A row a section: the page's columns in ``keep`` and the contact's, names split."""
    from ..functions.text import parse_name

    rows = pages.select(*keep, F.explode(page_sections(F.col(html_col))).alias("c")).select(*keep, "c.*")
    n = parse_name(F.col("full_name"))
    return rows.withColumn("first_name", n["first"]).withColumn("last_name", n["last"]).withColumn("extraction_method", F.lit("website_scrape"))


def heading_lists(pages: DataFrame, html_col: str = "html", base_col: str = "url") -> DataFrame:
    """``heading, text, url``: the links of the first list after each second-level heading."""

    def one(h: str | None, base: str | None) -> list[dict]:
        out = []
        for head in parse(h).all("h2"):
            ul = next((x for x in head.after() if x.tag == "ul"), None)
            for a in ul.all("a") if ul is not None else ():
                href = a.attrs.get("href", "").strip()
                if href.startswith("//"):
                    href = "https:" + href
                elif href.startswith("/"):
                    href = urljoin(base or "", href)
                elif href and not href.startswith("http"):
                    href = "https://" + href
                out.append({"heading": head.text().strip(), "text": _tidy(a.text()), "url": href})
        return out

    @F.pandas_udf("array<struct<heading:string,text:string,url:string>>")
    def run(p, b):
        import pandas as pd

        return pd.Series([one(h, u) for h, u in zip(p, b, strict=True)])

    return pages.select(F.explode(run(F.col(html_col), F.col(base_col))).alias("x")).select("x.*")


def follow(pages: DataFrame, targets: DataFrame, per_page: int = 20) -> DataFrame:
    """The contacts of all pages that are not excluded, and of the profiles that directory pages link to.

    ``targets`` (``url``) says which pages to start from; profile pages are joined by URL.
    """
    known = classify(pages).where(~F.col("excluded"))
    start = known.join(targets.select(F.col("url").alias("__u")).distinct(), normalize_url(F.col("url")) == normalize_url(F.col("__u")), "left_semi")
    links = profile_links(links_of(start.where("is_directory")), least=35, most=per_page)
    linked = known.join(links.select(normalize_url(F.col("url")).alias("__u")).distinct(), normalize_url(F.col("url")) == F.col("__u"), "left_semi")
    both = contacts_of(start, ["page_id", "url"]).unionByName(contacts_of(linked, ["page_id", "url"]))
    return both.dropDuplicates(["page_id", "ord"])

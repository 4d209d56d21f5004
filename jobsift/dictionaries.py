"""Fixed values shared by every module.

Everything under the "FIXED VALUES" banners must stay equal to the values the
original application uses, or results differ: category names, level names,
title patterns, header patterns, weights and thresholds.  They are written
out plainly and in their natural order.

Large vocabularies (the skill dictionary, stop words, the keyword taxonomy)
are *parameters*, not constants: callers pass their own list or DataFrame
(see ``load_term_list``).  Small fixture dictionaries used by tests and the
registered queries live in ``jobsift.sources.fixtures``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: job taxonomy, main category -> sub categories (12 mains,
# 40 subs), in the original order.  The order is the tie-break order of the
# keyword classifier and the row order of the fixture tables.
# ---------------------------------------------------------------------------
TAXONOMY: list[tuple[str, list[str]]] = [
    ("Data & BI", ["Data Analyst", "Data Engineer", "Data Science", "AI Engineer", "Data Operations"]),
    ("Software Engineering", ["Backend Dev", "Frontend Dev", "Fullstack Dev", "Mobile Dev", "Embedded Software Engineer"]),
    ("Cyber & IT", ["Security Analyst", "DevOps", "IT & System Admin"]),
    ("Product & Design", ["Product Manager", "UX/UI Designer", "Graphic Designer"]),
    ("QA", ["QA Manual", "QA Automation"]),
    ("Hardware & Mechanical", ["Hardware Engineer", "Mechanical Engineer", "Electrical Engineer", "Maintenance Technician", "VLSI/Chip Design", "Process/Industrial Engineer"]),
    ("Business & Sales", ["Sales / Account", "SDR / BDR", "Customer Success", "Marketing"]),
    ("Operations & Logistics", ["Supply Chain", "Operations Manager"]),
    ("Retail & Customer Service", ["Store Manager", "Sales Associate", "Customer Service"]),
    ("HR & Administration", ["HR Specialist", "Administrator", "Legal"]),
    ("Finance & Accounting", ["Accountant", "Finance Manager"]),
    ("General", ["Blue Collar", "Other"]),
]

# Flattened (main, sub) rows, index = position in the list above.
TAXONOMY_ROWS: list[tuple[str, str]] = [(m, s) for m, subs in TAXONOMY for s in subs]

# ---------------------------------------------------------------------------
# FIXED VALUES: seniority scale, defaults and score constants
# ---------------------------------------------------------------------------
LEVEL_ORDER = ["intern", "junior", "senior", "lead"]
UNKNOWN_LEVEL_INDEX = 1  # unknown or NULL level ranks as junior

# Defaults when a job has no classification / when a CV classification fails
JOB_DEFAULT = {"main_category": "General", "sub_category": "Other", "level": "junior"}
CV_DEFAULT = {"level": "junior", "main_category": "General", "sub_category": "Blue Collar"}
BYPASS_CATEGORY = "Other"  # a CV in this main category is scored against all jobs

# Category score: main differs / sub differs / both equal
CATEGORY_SCORE_MAIN_DIFF = 0
CATEGORY_SCORE_SUB_DIFF = 75
CATEGORY_SCORE_EQUAL = 100

# Seniority score by diff = cv_index - job_index
SENIORITY_SCORE_EQUAL = 100      # diff 0
SENIORITY_SCORE_OVER_1 = 80      # diff 1
SENIORITY_SCORE_OVER_MORE = 60   # diff > 1
SENIORITY_SCORE_UNDER_1 = 50     # diff -1
SENIORITY_SCORE_UNDER_MORE = 0   # diff < -1

# Match score weights: category, skills, seniority, semantic
W_CATEGORY = 0.25
W_SKILLS = 0.30
W_SENIORITY = 0.25
W_SEMANTIC = 0.20

TOP_K = 50                 # results kept per CV
BAND_GREEN_ABOVE = 70      # strict ">" thresholds of the colour band
BAND_ORANGE_ABOVE = 40
MISSING_SHOWN = 5          # missing skills shown on a card
PREVIEW_CHARS = 800        # description preview on a card

CHUNK_SIZE = 50            # jobs per classification batch
REQ_CAP = 800              # requirements section cap
REQ_FALLBACK = 500         # first chars kept when no header is found
CHARS_PER_TOKEN = 4        # size estimate of a rendered batch

LISTING_PAGE_SIZE = 10     # listing pages start at 0, 10, ... 390
URN_ID_PART = 3            # job id = 4th ':' part of the card's entity urn

# ---------------------------------------------------------------------------
# FIXED VALUES: title rules applied after classification (on lower(title))
# ---------------------------------------------------------------------------
LEAD_PATTERNS = [r"head of|director|\bvp\b|vice president|\bchief\b|c-level", r"\blead "]
SENIOR_PATTERN = r"\bsenior\b|\bsr\b\.|principal|\bstaff engineer\b| ii$| ii | iii | iv "
MANAGER_PATTERN = r"\bmanager\b"
MANAGER_EXCLUDE_PATTERN = r"junior|assistant"
INTERN_PATTERN = r"intern|internship|student|graduate 202"
PROFESSIONAL_PATTERN = (
    r"engineer|developer|analyst|designer|scientist|architect|consultant|"
    r"specialist|officer|lawyer|controller|researcher|programmer|administrator|"
    r"coordinator|strategist|economist|broker|planner"
)
BLUE_COLLAR_SUB = "Blue Collar"

# ---------------------------------------------------------------------------
# FIXED VALUES: requirements section headers (English, then Hebrew) and the
# section body rule: after the header, optional ':'/whitespace, a newline,
# then the shortest text up to a newline followed by a short line starting
# with a letter and another newline, or the end.
# ---------------------------------------------------------------------------
REQ_HEADERS = (
    r"requirements?|qualifications?|what we(?:'re| are) looking for|"
    r"who you are|what you(?:'ll| will) need|skills? (?:&|and) experience|"
    r"must.have|experience (?:&|and) skills?|job requirements?|"
    r"מה אנחנו מחפשים|דרישות|כישורים|ניסיון נדרש|תנאי קבלה"
)
REQ_BODY = r"[:\s]*\n(.*?)(?=\n(?:[A-Z][^\n]{0,60}\n)|$)"

# ---------------------------------------------------------------------------
# FIXED VALUES: ordered seniority rules of the classification prompt,
# first match wins, default junior.  (scope, literal phrases, level);
# scope "title" = title only, "any" = title or description,
# "desc" = description only.  The second intern rule also carries the two
# Hebrew words of the reclassification prompt.
# ---------------------------------------------------------------------------
SENIORITY_RULES: list[tuple[str, list[str], str]] = [
    ("any", ["head of", "director", "vp ", "vice president", "chief", "c-level"], "lead"),
    ("title", ["lead "], "lead"),
    ("any", ["senior", "sr.", "principal", "staff engineer"], "senior"),
    ("title_suffix", [" ii", " iii", " iv"], "senior"),
    ("title_manager", ["manager"], "senior"),
    ("desc", ["5+ years", "7+ years", "8+ years"], "senior"),
    ("any", ["intern", "internship"], "intern"),
    ("any", ["student", "graduate 2025", "graduate 2026", "סטודנט", "בוגר טרי"], "intern"),
    ("any", ["junior", "jr.", "entry level", "0-2 years"], "junior"),
]
SENIORITY_DEFAULT = "junior"

# ---------------------------------------------------------------------------
# FIXED VALUES: phrase -> category quick reference of the classification
# prompt (one line each, phrases separated by " / "), in the original order.
# The line number is the priority: the first line with a hit wins.
# ---------------------------------------------------------------------------
CATEGORY_PHRASES: list[tuple[str, str, str]] = [
    ("מלקט / מחסנאי / עובד מחסן", "General", "Blue Collar"),
    ("נהג / שליח / מחלק / בלדר", "General", "Blue Collar"),
    ("מנקה / עובד ניקיון", "General", "Blue Collar"),
    ("שומר / אבטחה / סייר", "General", "Blue Collar"),
    ("עובד ייצור / עובד הרכבה / פועל", "General", "Blue Collar"),
    ("קופאי/ת", "Retail & Customer Service", "Sales Associate"),
    ("מנהל חנות / מנהל סניף", "Retail & Customer Service", "Store Manager"),
    ("מנהל מחסן / מנהל לוגיסטיקה", "Operations & Logistics", "Operations Manager"),
    ("מגייס/ת / איש גיוס", "HR & Administration", "HR Specialist"),
    ("מנהל/ת משרד / עוזר/ת אדמין", "HR & Administration", "Administrator"),
    ('רו"ח / חשבונאי / בוקיפר', "Finance & Accounting", "Accountant"),
    ("מנהל כספים / CFO", "Finance & Accounting", "Finance Manager"),
    ("מפתח תוכנה / מהנדס תוכנה", "Software Engineering", "Backend Dev"),
    ("מפתח Full Stack / פולסטאק", "Software Engineering", "Fullstack Dev"),
    ("מפתח frontend / ממשק", "Software Engineering", "Frontend Dev"),
    ("מנהל מוצר / Product Manager", "Product & Design", "Product Manager"),
    ("מעצב UX/UI", "Product & Design", "UX/UI Designer"),
    ("מנתח נתונים / Data Analyst", "Data & BI", "Data Analyst"),
    ("מדען נתונים / Data Scientist", "Data & BI", "Data Science"),
    ("מהנדס נתונים / Data Engineer", "Data & BI", "Data Engineer"),
    ("מהנדס AI / בינה מלאכותית", "Data & BI", "AI Engineer"),
    ("מהנדס חומרה / Hardware Engineer", "Hardware & Mechanical", "Hardware Engineer"),
    ("מהנדס חשמל / Electrical Engineer", "Hardware & Mechanical", "Electrical Engineer"),
    ("מהנדס מכונות / Mechanical Engineer", "Hardware & Mechanical", "Mechanical Engineer"),
    ("מהנדס תהליך / Process Engineer", "Hardware & Mechanical", "Process/Industrial Engineer"),
    ("מהנדס ייצור / Manufacturing Engineer", "Hardware & Mechanical", "Process/Industrial Engineer"),
    ("טכנאי תחזוקה / Maintenance Tech", "Hardware & Mechanical", "Maintenance Technician"),
    ("DevOps / ענן / Cloud Engineer", "Cyber & IT", "DevOps"),
    ("אנליסט סייבר / Security Analyst", "Cyber & IT", "Security Analyst"),
    ("מנהל מערכות / IT Manager", "Cyber & IT", "IT & System Admin"),
    ("QA אוטומציה / Automation Tester", "QA", "QA Automation"),
    ("QA ידני / Manual Tester", "QA", "QA Manual"),
    ("מנהל מכירות / Sales Manager", "Business & Sales", "Sales / Account"),
    ("SDR / BDR / נציג פיתוח עסקי", "Business & Sales", "SDR / BDR"),
    ("Customer Success / הצלחת לקוח", "Business & Sales", "Customer Success"),
    ("שיווק / מנהל שיווק / Marketing", "Business & Sales", "Marketing"),
    ("עורך דין / יועץ משפטי", "HR & Administration", "Legal"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: detail-page field locators (tag + class attribute) of the
# captured posting pages, and the listing card entity attribute.
# ---------------------------------------------------------------------------
POSTING_FIELDS = {
    "job_title": ("h2", "top-card-layout__title font-sans text-lg papabear:text-xl font-bold leading-open text-color-text mb-0 topcard__title"),
    "company_name": ("a", "topcard__org-name-link topcard__flavor--black-link"),
    "location": ("span", "topcard__flavor topcard__flavor--bullet"),
    "time_posted": ("span", "posted-time-ago__text topcard__flavor--metadata"),
    "num_applicants": ("span", "num-applicants__caption topcard__flavor--metadata topcard__flavor--bullet"),
}
POSTING_DESCRIPTION_CLASS = "description__text--rich"
LISTING_CARD_CLASS = "base-card"
LISTING_URN_ATTR = "data-entity-urn"
# The posting URL is prefix + job id; the prefix is a parameter of the
# collector (``sources.html.posting_url``), default below is neutral.
POSTING_URL_PREFIX = "https://jobs.example.org/posting/"


def taxonomy_keyword_rows() -> list[tuple[str, str | None, str]]:
    """Default keyword table for the keyword classifier, built by rule from
    the taxonomy: each sub category name (lower case) is a sub-scope keyword,
    each main category name (lower case, ' & ' split into parts) is a
    main-scope keyword.  Callers with a curated keyword table pass it
    instead (same columns: main, sub or NULL, keyword)."""
    rows: list[tuple[str, str | None, str]] = []
    for main, subs in TAXONOMY:
        for part in main.lower().split(" & "):
            rows.append((main, None, part.strip()))
        for sub in subs:
            rows.append((main, sub, sub.lower()))
    return rows


def load_term_list(spark, path: str, column: str = "term"):
    """Read a one-term-per-line text file (e.g. a skill dictionary or a stop
    word list) as a one-column DataFrame, which every skill operator takes in
    place of a list; blank lines are dropped."""
    from pyspark.sql import functions as F
    return (spark.read.text(path)
            .select(F.col("value").alias(column))
            .where(F.length(F.trim(F.col(column))) > 0))

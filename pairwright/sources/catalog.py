"""The template catalog: a small fixed dimension of nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CATALOG_SCHEMA = _struct(
    slug=_S,
    name=_S,
    title=_S,
    subtitle=_S,
    keywords=T.ArrayType(_S),
    pro_tips=T.ArrayType(_struct(icon=_S, title=_S, description=_S)),
    template=_struct(
        name=_S,
        title=_S,
        contact=_S,
        summary=_S,
        experience=T.ArrayType(
            _struct(role=_S, company=_S, period=_S, achievements=T.ArrayType(_S))
        ),
        education=_S,
        skills=T.ArrayType(_S),
    ),
)

# Slug, name, title and keywords of each industry.
INDUSTRIES = (
    ("it-phan-mem", "IT Phần mềm", "Mẫu CV chuẩn ATS ngành IT Phần mềm",
     ["Lập trình viên", "Frontend", "Backend", "Fullstack", "DevOps", "React", "NodeJS"]),
    ("marketing", "Marketing", "Mẫu CV chuẩn ATS ngành Marketing / Truyền thông",
     ["Digital Marketing", "Content Writer", "SEO", "Performance Marketing", "Brand Manager"]),
    ("nhan-su-hr", "Nhân sự", "Mẫu CV chuẩn ATS ngành Hành chính Nhân sự (HR)",
     ["Tuyển dụng", "C&B", "Đào tạo", "L&D", "Nhân sự", "Talent Acquisition"]),
)
FALLBACK_KEYWORDS = ["CV", "Cách viết CV", "Tuyển dụng", "Cơ hội việc làm"]
FALLBACK_TITLE = "Mẫu CV ngành "
PAGE_TITLE = "{title} chuẩn ATS 2026 | {brand}"
PAGE_DESCRIPTION = (
    "Tải xuống {title} và xem hướng dẫn chi tiết cách viết CV chuyên nghiệp để vượt qua "
    "vòng lọc hồ sơ ATS. Công cụ AI sửa CV hoàn toàn tự động."
)
FALLBACK_PAGE_TITLE = "Cách viết CV ngành {slug} chuẩn ATS | {brand}"
FALLBACK_PAGE_DESCRIPTION = (
    "Hướng dẫn cách viết CV ngành {slug} chuyên nghiệp để vượt qua vòng lọc hồ sơ ATS. "
    "AI của {brand} giúp bạn tối ưu CV chuẩn nhất."
)

# Sample content of the records (ours; pass other rows to replace it).
_SAMPLES = {
    "it-phan-mem": (
        "One column, stack first, a number in every line.",
        [("Target", "Measure", "State what changed and by how much."),
         ("Zap", "Stack first", "List languages and tools right after the summary."),
         ("TrendingUp", "Show side work", "Link a repository next to the contact line."),
         ("Sparkles", "Stay plain", "Standard headings, no tables, no icons.")],
        ("Full-stack engineer", "Five years of web services.",
         [("Senior engineer", "Example Software", "2022 - now",
           ["Cut response time from 800 ms to 320 ms", "Led a team of 6"]),
          ("Engineer", "Example Agency", "2020 - 2022", ["Served 50 000 users"])],
         "BSc Computer Science", ["Python", "SQL", "Spark"]),
    ),
    "marketing": (
        "Lead with return on spend.",
        [("Target", "Return first", "Name budget and result together."),
         ("TrendingUp", "Portfolio", "Link the work itself."),
         ("Sparkles", "Active verbs", "Start each line with what you did.")],
        ("Performance marketer", "Three years of paid campaigns.",
         [("Marketing executive", "Example Media", "2021 - now",
           ["Lowered cost per lead by 40 %", "Raised open rate from 15 % to 32 %"])],
         "BA Marketing", ["SEO", "Analytics"]),
    ),
    "nhan-su-hr": (
        "Show hires, time and retention.",
        [("Target", "Hiring figures", "Count hires and days to fill."),
         ("TrendingUp", "Use the terms", "Name the processes you ran."),
         ("Zap", "Culture", "Describe one programme you built.")],
        ("Recruiter", "Four years of technical hiring.",
         [("Talent specialist", "Example Labs", "2021 - now",
           ["Filled 40 senior positions in 6 months"])],
         "BA Human Resources", ["Onboarding", "Sourcing"]),
    ),
    None: (
        "A plain layout that any parser reads.",
        [("Target", "Read the posting", "Note what it asks for twice."),
         ("Zap", "Use its words", "Repeat the terms you can support."),
         ("TrendingUp", "Count", "Give a number for each result.")],
        ("Experienced specialist", "Five years of project work.",
         [("Senior specialist", "Example Company", "2022 - now",
           ["Exceeded the yearly target by 20 %", "Saved 30 % of processing time"])],
         "BA, with honours", ["Communication", "Planning"]),
    ),
}


def _record(slug: str | None, name: str | None, title: str | None, keywords: list[str]) -> tuple:
    subtitle, tips, (role, summary, experience, education, skills) = _SAMPLES[slug]
    template = ("NGUYỄN VĂN A", role, "name@example.com", summary, experience, education, skills)
    return (slug, name, title, subtitle, keywords, tips, template)


SMALL = 10_000  #: records of a catalog that is broadcast


def template_catalog(spark: SparkSession, rows: Sequence[tuple] | None = None) -> DataFrame:
    """One nested record per industry.

    The planner cannot see the size of such a table.  Up to ``SMALL`` records it is marked
    for broadcast, so that requests for a few favourite slugs are not shuffled to them.
    """
    records = list(rows) if rows is not None else [_record(*r) for r in INDUSTRIES]
    catalog = spark.createDataFrame(records, CATALOG_SCHEMA)
    return F.broadcast(catalog) if len(records) <= SMALL else catalog


def fallback_record() -> tuple:
    """The generic record; its name and title come from the requested slug."""
    return _record(None, None, None, FALLBACK_KEYWORDS)


def literal(value: object, dtype: T.DataType) -> Column:
    """A nested Python value as a constant column."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.StructType):
        return F.struct(
            *[literal(v, f.dataType).alias(f.name) for v, f in zip(value, dtype.fields, strict=True)]
        )
    if isinstance(dtype, T.ArrayType):
        return F.array(*[literal(v, dtype.elementType) for v in value])
    return F.lit(value)

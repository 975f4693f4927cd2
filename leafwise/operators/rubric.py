"""Rule-based rubric scoring of extracted documents.

A rubric is a list of components ``(name, points, Column)``; each component is
built from the primitives below over typed (struct / array) document columns
and per-document expected parameters, so the whole rubric is one projection
(no UDF, no shuffle).  Totals add the components, ``max`` is the points sum,
``pct`` = total / max · 100 rounded to one digit; a document without data
scores 0 of max.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.session import computed


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: an expression that a lambda names is computed again for
    every element."""
    return F.transform(F.array(value), use)[0]


def count_band_col(n: Column, exact: Column, exact_pts: int, ladder: list[tuple[int, int]]) -> Column:
    """R1 with a per-document exact target, then a >= ladder."""
    out = F.lit(0)
    for thr, pts in reversed(ladder):
        out = F.when(n >= thr, F.lit(pts)).otherwise(out)
    return F.when(n == exact, F.lit(exact_pts)).otherwise(out)


def contains_any(text: Column, keywords: Column, case_insensitive: bool = False) -> Column:
    """M8: any keyword is a substring of ``text``."""
    return once(F.lower(text) if case_insensitive else text, lambda t: _any_in(t, keywords, case_insensitive))


def _any_in(t: Column, keywords: Column, lower: bool) -> Column:
    return F.exists(keywords, lambda k: F.instr(t, F.lower(k) if lower else k) > 0)


def keyword_coverage(text: Column, groups: Column, points: int, case_insensitive: bool = False) -> Column:
    """R2: int(matched groups / groups · points) — truncation, as in the rubric scripts."""
    matched = once(F.lower(text) if case_insensitive else text, lambda t: F.size(F.filter(groups, lambda g: _any_in(t, g, case_insensitive))))
    n = F.size(groups)
    return F.when(n > 0, (matched.cast("double") / n.cast("double") * float(points)).cast("int")).otherwise(F.lit(0))


def field_concat(arr: Column, field: str) -> Column:
    """M10: ' '.join(x.field or '') over an array of structs."""
    return F.array_join(F.transform(arr, lambda x: F.coalesce(x[field], F.lit(""))), " ")


def date_shape_ok(s: Column) -> Column:
    """M9: len >= 7 and '-' within the first 8 characters."""
    return (F.length(s) >= 7) & (F.instr(F.substring(s, 1, 8), "-") > 0)


def date_ratio(arr: Column, field: str, points: int) -> Column:
    """R4-style: full points when every non-empty date is well-formed, else int(ok / total · points)."""
    def points_of(dates):
        total = F.size(dates)
        ok = F.size(F.filter(dates, date_shape_ok))
        return (F.when((total > 0) & (ok == total), F.lit(points))
                .otherwise((ok.cast("double") / F.greatest(total, F.lit(1)).cast("double") * float(points)).cast("int")))
    return once(F.filter(F.transform(arr, lambda x: F.coalesce(x[field], F.lit(""))), lambda d: d != ""), points_of)


def nontrivial_count(arr: Column, field: str, min_len: int = 10) -> Column:
    """R5: number of elements whose text field is longer than ``min_len``."""
    return F.size(F.filter(arr, lambda x: F.length(F.coalesce(x[field], F.lit(""))) > min_len))


def capped_ratio(n: Column, full_at: int, points: int) -> Column:
    """R5 capped: full points from ``full_at`` on, else int(n / full_at · points)."""
    return F.when(n >= full_at, F.lit(points)).otherwise((n.cast("double") / float(full_at) * points).cast("int"))


def flag_any(arr: Column, field: str) -> Column:
    """R3: any element with the flag set to true."""
    return F.exists(arr, lambda x: F.coalesce(x[field], F.lit(False)))


def score(df: DataFrame, components: list[tuple[str, int, Column]], has_data: Column,
          keys: list[str], max_without_data: int | None = None) -> DataFrame:
    """R6/R9: per-document component map, total, max, pct; a document without data has 0 of ``max_without_data``."""
    max_pts = sum(p for _, p, _ in components)
    # The documents and the struct of points are computed once; each field of either is read several times.
    got = F.struct(*[F.when(has_data, c.cast("int")).otherwise(F.lit(0)).alias(name) for name, _, c in components])
    df = computed(computed(df).select(*keys, got.alias("_got"), has_data.alias("_has")))
    has_data = F.col("_has")
    comp = F.create_map(*[x for name, _, _ in components for x in (F.lit(name), F.col("_got")[name])])
    total = F.lit(0)
    for name, _, _ in components:
        total = total + F.col("_got")[name]
    empty = max_pts if max_without_data is None else max_without_data
    return df.select(*keys, comp.alias("components"), total.alias("total"), F.when(has_data, F.lit(max_pts)).otherwise(F.lit(empty)).alias("max"),
                     F.round(total.cast("double") / float(max_pts) * 100.0, 1).alias("pct"))


def resume_rubric(doc: str = "doc", exp: str = "exp") -> list[tuple[str, int, Column]]:
    """The 12-component resume rubric (100 points).

    ``doc``: struct<name, email, phone, summary, skills array<string>,
    work_experience array<struct<company, title, start_date, description>>,
    education array<struct<institution, degree>>>.
    ``exp``: struct<name_keywords array<string>, email, phone_keyword, min_skills,
    work_count, company_groups array<array<string>>, edu_count,
    institution_groups array<array<string>>, degree_groups array<array<string>>>.
    """
    d, e = F.col(doc), F.col(exp)
    work = F.coalesce(d["work_experience"], F.array())
    edu = F.coalesce(d["education"], F.array())
    skills = F.size(F.coalesce(d["skills"], F.array()))
    return [
        ("name", 10, F.when(contains_any(F.coalesce(d["name"], F.lit("")), e["name_keywords"]), 10).otherwise(0)),
        ("email", 10, F.when(d["email"] == e["email"], 10).otherwise(0)),
        ("phone", 5, F.when(F.instr(F.coalesce(d["phone"], F.lit("")), e["phone_keyword"]) > 0, 5).otherwise(0)),
        ("summary", 5, F.when(F.length(F.coalesce(d["summary"], F.lit(""))) > 20, 5).otherwise(0)),
        ("skills", 10, F.when(skills >= 15, 10).when(skills >= e["min_skills"], 7).when(skills >= 3, 3).otherwise(0)),
        ("work_count", 10, count_band_col(F.size(work), e["work_count"], 10, [(3, 7), (2, 4)])),
        ("companies", 15, keyword_coverage(field_concat(work, "company"), e["company_groups"], 15, True)),
        ("work_desc", 5, capped_ratio(nontrivial_count(work, "description", 10), 3, 5)),
        ("dates", 10, date_ratio(work, "start_date", 10)),
        ("edu_count", 5, count_band_col(F.size(edu), e["edu_count"], 5, [(1, 3)])),
        ("institutions", 10, keyword_coverage(field_concat(edu, "institution"), e["institution_groups"], 10)),
        ("degrees", 5, keyword_coverage(field_concat(edu, "degree"), e["degree_groups"], 5, True)),
    ]


def component_breakdown(scored: DataFrame, by: list[str]) -> DataFrame:
    """A15: mean of each rubric component per group (missing component = 0)."""
    ex = scored.select(*by, F.explode("components").alias("component", "points"))
    return ex.groupBy(*by, "component").agg(F.avg(F.coalesce(F.col("points"), F.lit(0))).alias("avg_points"))


# --- career rubrics ------------------------------------------------------------------
def text_of(arr: Column, fields: list[str]) -> Column:
    """All the named text fields of all elements, joined by blanks."""
    return F.array_join(F.transform(arr, lambda x: F.array_join(F.array(*[F.coalesce(x[f], F.lit("")) for f in fields]), " ")), " ")


def has(text: Column, keyword: Column) -> Column:
    return F.contains(text, keyword)


def _both_cases(text: Column) -> Column:
    return once(text, lambda t: F.struct(t.alias("text"), F.lower(t).alias("lower")))


def each_held(text: Column, keywords: Column, points: float, any_case: bool = False) -> Column:
    """``points`` for every keyword that the text holds."""
    return once(F.lower(text) if any_case else text,
                lambda t: each(keywords, lambda k: points_if(has(t, F.lower(k) if any_case else k), points)))


def points_if(cond: Column, points: float) -> Column:
    return F.when(cond, F.lit(float(points))).otherwise(F.lit(0.0))


def share(part: Column, whole: Column, points: int) -> Column:
    """int(part / whole · points), a whole of 0 counting as 1; not capped."""
    return (part.cast("double") / F.greatest(whole, F.lit(1)).cast("double") * float(points)).cast("int")


def additive(parts: list[Column], cap: int) -> Column:
    """R6: half points add up, then truncate, then the cap holds."""
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return F.least(total.cast("int"), F.lit(cap))


def each(arr: Column, points) -> Column:
    """Sum of ``points(element)`` over an array."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + points(x))


def company_hits(careers: Column, companies: Column, names: Column, by_name: str | None = None) -> Column:
    """R2 with hidden employers: an expected company that is private is met by any private career (or by one whose
    name says ``by_name``), another by one of its name keywords in the careers' names."""
    hidden = F.exists(careers, lambda c: F.coalesce(c["is_company_private"], F.lit(False))
                      | (F.contains(F.coalesce(c["company_name"], F.lit("")), F.lit(by_name)) if by_name else F.lit(False)))
    return once(F.struct(hidden.alias("hidden"), F.lower(names).alias("names")), lambda s: F.size(F.filter(
        companies, lambda g: F.when(g["is_private"], s["hidden"]).otherwise(
            F.exists(g["name_keywords"], lambda k: has(s["names"], F.lower(k)))))))


def start_hits(companies: Column, dates: Column) -> tuple[Column, Column]:
    """R4: (expected starts found in the text of all dates, expected starts)."""
    known = F.filter(companies, lambda g: g["start"].isNotNull())
    return once(dates, lambda t: F.size(F.filter(known, lambda g: has(t, g["start"])))), F.size(known)


def long_texts(arr: Column, field: str, over: int = 20) -> Column:
    return nontrivial_count(arr, field, over)


def links_score(sns: Column, keywords: Column, expected: Column, cap: int) -> Column:
    """R8: a point per keyword in the links and one for having as many links as expected."""
    links = F.coalesce(sns["sns_links"], F.array().cast("array<string>"))
    hits = once(F.lower(F.array_join(links, " ")), lambda text: F.size(F.filter(keywords, lambda k: has(text, k))))
    return F.when(sns.isNull(), F.lit(0)).otherwise(F.least(hits + F.when(F.size(links) >= expected, 1).otherwise(0), F.lit(cap)))


def _lists(d: Column) -> dict[str, Column]:
    names = ["careers", "activity_experiences", "overseas_experiences", "language_skills", "certificates", "award_experiences"]
    return {n: F.coalesce(d[n], F.array()) for n in names}


DATES = ["start_date", "end_date"]


def career_rubric(doc: str = "doc", exp: str = "exp") -> list[tuple[str, int, Column]]:
    """The 13-component career rubric (90 points).  ``exp`` holds the expected counts, keyword lists and fields."""
    d, e = F.col(doc), F.col(exp)
    at = _lists(d)
    careers, companies, mil, want = at["careers"], e["companies"], d["employment_military_info"], e["military"]
    found, dated = start_hits(companies, text_of(careers, DATES))
    activity = text_of(at["activity_experiences"], ["activity_type", "activity_name", "organization", "details"])
    abroad = text_of(at["overseas_experiences"], ["experience_type", "country", "details"])
    language = text_of(at["language_skills"], ["assessment_type", "language", "test_name", "test_score", "proficiency_level"])
    cert = text_of(at["certificates"], ["certificate_name", "issuing_authority", "acquisition_date"])
    award = text_of(at["award_experiences"], ["award_name", "organizer", "award_date", "details"])
    meta = [points_if(contains_any(text_of(careers, [f]), e[k]), p) for f, k, p in (
        ("employment_type", "employment_keywords", 2), ("work_location", "location_keywords", 1),
        ("annual_salary", "salary_keywords", 2), ("reason_for_leaving", "reason_keywords", 1),
        ("reason_for_leaving", "contract_keywords", 1))]
    army = [points_if(mil[f] == want[k], 2) for f, k in (("military_status", "status"), ("military_branch", "branch"), ("rank", "rank"))]
    army += [points_if(has(F.coalesce(mil[f], F.lit("")), want[k]) & (F.coalesce(mil[f], F.lit("")) != ""), 1)
             for f, k in (("service_start_date", "start"), ("service_end_date", "end"))]
    army += [points_if(~mil[f], 1) for f in ("is_veteran_target", "is_disabled")]

    def counted(name, expected, full, ladder):
        return count_band_col(F.size(at[name]), e[expected], full, ladder).cast("double")
    return [
        ("career_count", 5, count_band_col(F.size(careers), e["career_count"], 5, [(2, 3)])),
        ("companies", 5, share(company_hits(careers, companies, text_of(careers, ["company_name"])), F.size(companies), 5)),
        ("currently_employed", 3, F.when(flag_any(careers, "is_currently_employed"), 3).otherwise(0)),
        ("career_dates", 5, share(found, F.size(companies), 5)),
        ("work_details", 5, capped_ratio(long_texts(careers, "work_details"), 3, 5)),
        ("career_meta", 7, additive(meta, 7)),
        ("activities", 10, additive([counted("activity_experiences", "activity_count", 3, [(2, 1)]), once(F.lower(activity), lambda t: each(
            e["activities"], lambda g: F.when(has(t, F.lower(g["name_keyword"])), 2.0).when(
                has(t, F.lower(g["org_keyword"])), 1.0).otherwise(0.0)))], 10)),
        ("overseas", 8, additive([counted("overseas_experiences", "overseas_count", 2, [(1, 1)]), once(abroad, lambda t: each(
            e["overseas"], lambda g: points_if(has(t, g["type"]), 1) + points_if(_any_in(t, g["country_keywords"], False), 1)
            + points_if(has(t, g["detail_keyword"]), 1)))], 8)),
        ("languages", 10, additive([
            points_if(F.size(at["language_skills"]) >= e["language_count"], 2) + points_if(
                (F.size(at["language_skills"]) < e["language_count"]) & (F.size(at["language_skills"]) >= 3), 1),
            once(language, lambda t: each(e["conversation_keywords"], lambda k: points_if(has(t, k), 1))),
            once(_both_cases(language), lambda t: each(e["tests"], lambda g: F.when(has(t["lower"], F.lower(g["test"])), F.lit(1.0) + points_if(
                (g["score"] != "") & has(t["text"], g["score"]), 0.5)).otherwise(0.0)))], 10)),
        ("certificates", 10, additive([counted("certificates", "certificate_count", 3, [(3, 2), (1, 1)]), once(_both_cases(cert), lambda t: each(
            e["certificates"], lambda g: F.when(has(t["lower"], F.lower(g["name"])), F.lit(1.0) + points_if(
                has(t["text"], g["date"]), 0.5)).otherwise(0.0)))], 10)),
        ("awards", 8, additive([counted("award_experiences", "award_count", 2, [(2, 1)]), once(_both_cases(award), lambda t: each(
            e["awards"], lambda g: F.when(_any_in(t["lower"], g["name_keywords"], True), F.lit(1.0) + points_if(
                has(t["text"], g["date"]), 0.5)).otherwise(0.0)))], 8)),
        ("military", 10, F.when(mil.isNull(), 0).otherwise(additive(army, 10))),
        ("sns", 4, links_score(d["sns"], e["sns_keywords"], e["sns_count"], 4)),
    ]


def multi_career_rubric(doc: str = "doc", exp: str = "exp", not_applicable: str = "none", exempt: str = "exempt",
                        hidden: str = "undisclosed") -> list[tuple[str, int, Column]]:
    """The 12-component rubric for many persons' careers (100 points), every expectation a parameter of the person.
    ``not_applicable`` and ``exempt`` are military statuses, ``hidden`` marks an undisclosed employer's name."""
    d, e = F.col(doc), F.col(exp)
    at = _lists(d)
    careers, companies, mil, want = at["careers"], e["companies"], d["employment_military_info"], e["military"]
    found, dated = start_hits(companies, text_of(careers, DATES))
    words = {"activity_experiences": ["activity_type", "activity_name", "organization", "details"],
             "overseas_experiences": ["experience_type", "country", "details"],
             "language_skills": ["assessment_type", "language", "test_name", "test_score", "proficiency_level"],
             "certificates": ["certificate_name", "issuing_authority", "acquisition_date"],
             "award_experiences": ["award_name", "organizer", "award_date", "details"]}

    def listed(name, expected, full, near, keywords, points, cap, any_case, at_least=False):
        n, want_n = F.size(at[name]), e[expected]
        exact = (n >= want_n) if at_least else (n == want_n)
        close = n >= (want_n - 1 if at_least else F.greatest(want_n - 1, F.lit(1)))
        return additive([F.when(exact, float(full)).when(close, float(near)).otherwise(0.0),
                         each_held(text_of(at[name], words[name]), e[keywords], points, any_case)], cap)
    status = mil["military_status"]
    spared = status.isNull() | status.isin(not_applicable, "", exempt)
    army = [points_if(mil[f].eqNullSafe(want[k]), p) for f, k, p in (
        ("military_status", "status", 3), ("military_branch", "branch", 3), ("rank", "rank", 2))]
    army += [points_if(~mil[f], 1) for f in ("is_veteran_target", "is_disabled")]
    exempted = want["status"] == not_applicable
    visible = F.size(F.filter(companies, lambda g: ~F.coalesce(g["is_private"], F.lit(False))))
    n = F.size(careers)
    return [
        ("career_count", 10, F.when(n == e["career_count"], 10).when(n >= e["career_count"] - 1, 6).when(n >= 1, 3).otherwise(0)),
        ("companies", 10, share(company_hits(careers, companies, text_of(careers, ["company_name"]), hidden), F.size(companies), 10)),
        ("currently_employed", 5, F.when(flag_any(careers, "is_currently_employed") == flag_any(companies, "currently_employed"), 5).otherwise(0)),
        ("dates", 10, share(found, dated, 10)),
        ("work_details", 10, share(long_texts(careers, "work_details"), visible, 10)),
        ("activities", 10, listed("activity_experiences", "activity_count", 4, 2, "activities_keywords", 3, 10, True)),
        ("overseas", 5, additive([points_if(F.size(at["overseas_experiences"]) == e["overseas_count"], 2), each_held(
            text_of(at["overseas_experiences"], words["overseas_experiences"]), e["overseas_keywords"], 1)], 5)),
        ("languages", 10, listed("language_skills", "language_count", 3, 1, "lang_keywords", 2, 10, True, at_least=True)),
        ("certificates", 10, listed("certificates", "certificate_count", 3, 1, "cert_keywords", 2, 10, True)),
        ("awards", 5, additive([points_if(F.size(at["award_experiences"]) == e["award_count"], 2), each_held(
            text_of(at["award_experiences"], words["award_experiences"]), e["award_keywords"], 1, True)], 5)),
        ("military", 10, F.when(mil.isNull(), F.when(exempted, 5).otherwise(0)).when(exempted, F.when(spared, 10).otherwise(0))
         .otherwise(additive(army, 10))),
        ("sns", 5, links_score(d["sns"], e["sns_keywords"], e["sns_count"], 5)),
    ]

"""Rubric queries: the 12-component resume rubric applied to resume-shaped
documents derived from orders (customer = person, line items = work history,
nation / segment = education), with expected parameters from the unperturbed
source rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.operators import rubric
from leafwise.session import spread
from leafwise.sources.tables import table

Q: dict = {}
SQL: dict = {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def resume_docs(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                             "l_returnflag", "l_shipdate")
    items = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"))).alias("all_items"))
    d = (o.join(items, o.o_orderkey == items.l_orderkey, "left")
         .join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left"))
    k = F.col("o_orderkey")
    all_items = F.coalesce(F.col("all_items"), F.array())
    kept = F.filter(all_items, lambda x: x["l_linenumber"] % 5 != 0)
    sup = lambda s: F.concat(F.lit("Supplier#"), F.lpad(s.cast("string"), 9, "0"))
    email = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@mail.test"))
    phone_kw = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    work = F.transform(kept, lambda x: F.struct(
        sup(x["l_suppkey"]).alias("company"), x["l_returnflag"].alias("title"),
        F.when(k % 9 == 0, F.date_format(x["l_shipdate"], "MM/yyyy"))
        .otherwise(F.date_format(x["l_shipdate"], "yyyy-MM")).alias("start_date"),
        F.when(x["l_partkey"] % 4 == 0, F.lit("n/a"))
        .otherwise(F.concat(F.lit("Shipped "), x["l_quantity"].cast("long").cast("string"), F.lit(" units")))
        .alias("description")))
    edu1 = F.struct(F.col("n_name").alias("institution"), F.col("c_mktsegment").alias("degree"))
    edu2 = F.struct(F.lit("Open University").alias("institution"), F.lit("Bachelor").alias("degree"))
    doc = F.struct(
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 6 == 0, F.upper(email)).otherwise(email).alias("email"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("555-"), phone_kw)).alias("phone"),
        F.when(k % 8 == 0, F.lit("short")).otherwise(F.concat(F.lit("Order "), k.cast("string"),
                                                              F.lit(" with priority "), F.col("o_orderpriority")))
        .alias("summary"),
        F.transform(kept, lambda x: F.concat(F.lit("part-"), x["l_partkey"].cast("string"))).alias("skills"),
        work.alias("work_experience"),
        F.when(k % 3 == 0, F.array(edu1, edu2)).otherwise(F.array(edu1)).alias("education"))
    exp = F.struct(
        F.array(F.col("c_name")).alias("name_keywords"), email.alias("email"), phone_kw.alias("phone_keyword"),
        F.greatest(F.size(all_items) - 1, F.lit(1)).alias("min_skills"), F.size(all_items).alias("work_count"),
        F.transform(F.array_distinct(F.transform(all_items, lambda x: x["l_suppkey"])),
                    lambda s: F.array(sup(s))).alias("company_groups"),
        F.lit(1).alias("edu_count"), F.array(F.array(F.col("n_name"))).alias("institution_groups"),
        F.array(F.array(F.col("c_mktsegment"))).alias("degree_groups"))
    return d.select(F.concat(F.lit("ord_"), k.cast("string")).alias("doc_key"), doc.alias("doc"), exp.alias("exp"),
                    (k % 11 != 0).alias("has_data"))


def _scored(spark, sf):
    d = spread(resume_docs(spark, sf))
    return rubric.score(d, rubric.resume_rubric(), F.col("has_data"), ["doc_key"])


@q("rubric_score")
def rubric_score(spark, sf):
    return _scored(spark, sf).select("doc_key", "total", "max", "pct")


@q("rubric_breakdown")
def rubric_breakdown(spark, sf):
    return rubric.component_breakdown(_scored(spark, sf), [])


_COMP = """
WITH it AS (SELECT l_orderkey AS k, count(*) AS n_all, count(DISTINCT l_suppkey) AS g FROM lineitem GROUP BY l_orderkey),
kp AS (SELECT l_orderkey AS k, count(*) AS n_kept, count(DISTINCT l_suppkey) AS m,
              sum(CASE WHEN l_partkey % 4 <> 0 THEN 1 ELSE 0 END) AS nd
       FROM lineitem WHERE l_linenumber % 5 <> 0 GROUP BY l_orderkey),
b AS (SELECT o.o_orderkey AS k, COALESCE(it.n_all, 0) AS n_all, COALESCE(it.g, 0) AS g,
             COALESCE(kp.n_kept, 0) AS n_kept, COALESCE(kp.m, 0) AS m, COALESCE(kp.nd, 0) AS nd
      FROM orders o LEFT JOIN it ON it.k = o.o_orderkey LEFT JOIN kp ON kp.k = o.o_orderkey),
c AS (SELECT k, k % 11 <> 0 AS hd,
  CASE WHEN k % 5 = 0 THEN 0 ELSE 10 END AS name,
  CASE WHEN k % 6 = 0 THEN 0 ELSE 10 END AS email,
  CASE WHEN k % 7 = 0 THEN 0 ELSE 5 END AS phone,
  CASE WHEN k % 8 = 0 THEN 0 ELSE 5 END AS summary,
  CASE WHEN n_kept >= 15 THEN 10 WHEN n_kept >= greatest(n_all - 1, 1) THEN 7 WHEN n_kept >= 3 THEN 3 ELSE 0 END AS skills,
  CASE WHEN n_kept = n_all THEN 10 WHEN n_kept >= 3 THEN 7 WHEN n_kept >= 2 THEN 4 ELSE 0 END AS work_count,
  CASE WHEN g > 0 THEN CAST(trunc(CAST(m AS DOUBLE) / CAST(g AS DOUBLE) * 15.0) AS INTEGER) ELSE 0 END AS companies,
  CASE WHEN nd >= 3 THEN 5 ELSE CAST(trunc(CAST(nd AS DOUBLE) / 3.0 * 5) AS INTEGER) END AS work_desc,
  CASE WHEN n_kept > 0 AND k % 9 <> 0 THEN 10 ELSE 0 END AS dates,
  CASE WHEN k % 3 = 0 THEN 3 ELSE 5 END AS edu_count,
  10 AS institutions, 5 AS degrees FROM b),
z AS (SELECT k, CASE WHEN hd THEN name ELSE 0 END AS name, CASE WHEN hd THEN email ELSE 0 END AS email,
  CASE WHEN hd THEN phone ELSE 0 END AS phone, CASE WHEN hd THEN summary ELSE 0 END AS summary,
  CASE WHEN hd THEN skills ELSE 0 END AS skills, CASE WHEN hd THEN work_count ELSE 0 END AS work_count,
  CASE WHEN hd THEN companies ELSE 0 END AS companies, CASE WHEN hd THEN work_desc ELSE 0 END AS work_desc,
  CASE WHEN hd THEN dates ELSE 0 END AS dates, CASE WHEN hd THEN edu_count ELSE 0 END AS edu_count,
  CASE WHEN hd THEN institutions ELSE 0 END AS institutions, CASE WHEN hd THEN degrees ELSE 0 END AS degrees FROM c)
"""
_NAMES = ["name", "email", "phone", "summary", "skills", "work_count", "companies", "work_desc", "dates",
          "edu_count", "institutions", "degrees"]
SQL["rubric_score"] = _COMP + f"""
SELECT 'ord_' || CAST(k AS VARCHAR) AS doc_key, CAST({' + '.join(_NAMES)} AS INTEGER) AS total, 100 AS max,
       round(CAST({' + '.join(_NAMES)} AS DOUBLE) / 100.0 * 100.0, 1) AS pct FROM z"""
SQL["rubric_breakdown"] = _COMP + " UNION ALL ".join(
    f"SELECT '{c}' AS component, avg({c}) AS avg_points FROM z" for c in _NAMES).join(["", ""]) if False else (
    _COMP + " " + " UNION ALL ".join(f"SELECT '{c}' AS component, avg({c}) AS avg_points FROM z" for c in _NAMES))


# --- career rubrics ------------------------------------------------------------------
def career_docs(spark, sf):
    """Career-shaped documents and expectations per order: kept line items are the careers found, all line items the
    careers expected; hidden employers, missing dates, half-filled lists and absent sections by key arithmetic."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), "l_returnflag",
        (F.col("l_linestatus") == "O").alias("open"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    items = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "qty", "l_returnflag", "open", "month"))).alias("a"))
    d = (o.join(items, o.o_orderkey == items.l_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left")
         .join(n, c.c_nationkey == n.n_nationkey, "left"))
    k, seg, nation, pr = F.col("o_orderkey"), F.col("c_mktsegment"), F.col("n_name"), F.col("o_orderpriority")
    none = F.lit(None).cast("string")
    a = F.coalesce(F.col("a"), F.array())
    kept = F.filter(a, lambda x: x["l_linenumber"] % 5 != 0)

    def sup(x):
        return F.concat(F.lit("Supplier#"), F.lpad(x["l_suppkey"].cast("string"), 9, "0"))

    def part(x, prefix):
        return F.concat(F.lit(prefix), x["l_partkey"].cast("string"))

    def rec(**fields):
        return F.struct(*[v.alias(f) for f, v in fields.items()])
    careers = F.transform(kept, lambda x: rec(
        company_name=F.when(x["l_partkey"] % 5 != 0, sup(x)), is_company_private=x["l_partkey"] % 5 == 0, is_currently_employed=x["open"],
        start_date=F.when(k % 9 != 0, x["month"]), end_date=none,
        work_details=F.when(x["l_partkey"] % 4 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("Shipped "), x["qty"].cast("string"), F.lit(" units of a part"))),
        employment_type=x["l_returnflag"], work_location=nation, annual_salary=x["qty"].cast("string"), reason_for_leaving=seg))
    lang = F.array(rec(assessment_type=F.lit("talk"), language=F.lit("English"), test_name=none, test_score=none, proficiency_level=F.lit("high")),
                   rec(assessment_type=F.lit("test"), language=none, test_name=F.lit("TOEIC"), test_score=(k % 990).cast("string"), proficiency_level=none),
                   rec(assessment_type=F.lit("talk"), language=F.lit("German"), test_name=none, test_score=none, proficiency_level=none))
    doc = rec(
        careers=careers,
        activity_experiences=F.transform(F.slice(kept, 1, 2), lambda x: rec(
            activity_type=F.lit("order"), activity_name=part(x, "part-"), organization=sup(x), details=none)),
        overseas_experiences=F.slice(F.array(rec(experience_type=F.lit("trade"), country=nation, details=seg)), F.lit(1),
                                     F.when(k % 4 != 0, 1).otherwise(0)),
        language_skills=F.slice(lang, F.lit(1), (k % 4).cast("int")),
        certificates=F.transform(F.slice(kept, 1, 3), lambda x: rec(
            certificate_name=part(x, "cert-"), issuing_authority=seg, acquisition_date=x["month"])),
        award_experiences=F.transform(F.slice(kept, 1, 2), lambda x: rec(
            award_name=F.concat(F.lit("award "), x["l_returnflag"]), organizer=seg, award_date=x["month"], details=none)),
        employment_military_info=F.when(k % 6 != 0, rec(
            military_status=F.when(k % 2 == 0, F.lit("done")).when(k % 7 == 0, F.lit("exempt")).otherwise(F.lit("none")), military_branch=nation,
            rank=pr, service_start_date=F.when(k % 5 != 0, F.lit("2011-03-02")), service_end_date=F.lit("2013-02"),
            is_veteran_target=k % 4 == 1, is_disabled=F.lit(False))),
        sns=F.when(k % 8 != 0, rec(sns_links=F.slice(F.array(F.concat(F.lit("https://GitHub.com/"), k.cast("string")), F.lit("https://linkedin.com/x")),
                                                     F.lit(1), (k % 3).cast("int")))))
    words = lambda *x: F.array(*map(F.lit, x))
    first = lambda m: F.slice(a, 1, m)
    exp = rec(
        career_count=F.size(a),
        companies=F.transform(a, lambda x: rec(is_private=x["l_partkey"] % 5 == 0, name_keywords=F.array(F.upper(sup(x))),
                                               start=F.when(x["l_partkey"] % 7 != 0, x["month"]), currently_employed=x["open"])),
        employment_keywords=words("R"), location_keywords=F.array(nation), salary_keywords=words("8"), reason_keywords=words("AUTO", "HOUSE"),
        contract_keywords=words("BUILD"), activity_count=F.lit(2),
        activities=F.transform(first(2), lambda x: rec(name_keyword=part(x, "PART-"), org_keyword=sup(x))), overseas_count=F.lit(1),
        overseas=F.array(rec(type=F.lit("trade"), country_keywords=F.array(nation), detail_keyword=seg),
                         rec(type=F.lit("study"), country_keywords=words("Nowhere"), detail_keyword=F.lit("none"))),
        language_count=F.lit(2), conversation_keywords=words("English", "German"), tests=F.array(rec(test=F.lit("toeic"), score=F.lit("9"))),
        certificate_count=F.least(F.size(a), F.lit(3)), certificates=F.transform(first(3), lambda x: rec(name=part(x, "CERT-"), date=x["month"])),
        award_count=F.lit(2), awards=F.transform(first(2), lambda x: rec(
            name_keywords=F.array(F.concat(F.lit("Award "), x["l_returnflag"]), F.lit("prize")), date=x["month"])),
        military=rec(status=F.when(k % 3 == 0, F.lit("none")).otherwise(F.lit("done")), branch=nation, rank=pr, start=F.lit("2011-03"), end=F.lit("2013-01")),
        sns_count=F.lit(2), sns_keywords=words("github", "linkedin", "tistory"),
        activities_keywords=F.transform(first(2), lambda x: part(x, "PART-")), overseas_keywords=F.array(F.lit("trade"), nation),
        lang_keywords=words("english", "toeic"), cert_keywords=F.transform(first(3), lambda x: part(x, "CERT-")),
        award_keywords=F.transform(first(2), lambda x: F.concat(F.lit("AWARD "), x["l_returnflag"])))
    return d.select(F.concat(F.lit("ord_"), k.cast("string")).alias("doc_key"), doc.alias("doc"), exp.alias("exp"), (k % 11 != 0).alias("has_data"),
                    F.element_at(F.array(F.lit("A_desc"), F.lit("B_nodesc"), F.lit("C_rich")), (k % 3 + 1).cast("int")).alias("combination"))


def _career(spark, sf, rules):
    d = spread(career_docs(spark, sf))
    return rubric.score(d, rules(), F.col("has_data"), ["doc_key", "combination", "has_data"], max_without_data=100)


def _listed(df):
    """Component points as text, so that every component is compared."""
    return df.select("doc_key", "total", "max", "pct", F.array_join(F.transform(F.array_sort(F.map_entries("components")),
                     lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("components"))


@q("career_rubric")
def career_rubric(spark, sf):
    return _listed(_career(spark, sf, rubric.career_rubric))


@q("multi_career_rubric")
def multi_career_rubric(spark, sf):
    return _listed(_career(spark, sf, rubric.multi_career_rubric))


@q("component_matrix")
def component_matrix(spark, sf):
    """Mean of every component per combination, over the documents that have data."""
    return rubric.component_breakdown(_career(spark, sf, rubric.career_rubric).where("has_data"), ["combination"])


_CAREER = """
WITH li AS (SELECT l_orderkey AS k, list(struct_pack(ln := l_linenumber, pk := l_partkey, sup := 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0'),
       qty := CAST(l_quantity AS BIGINT), rf := l_returnflag, op := l_linestatus = 'O', mo := strftime(l_shipdate, '%Y-%m'))
       ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), l_returnflag, l_linestatus = 'O', strftime(l_shipdate, '%Y-%m')) AS a
     FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o.o_orderkey AS k, o.o_orderpriority AS pr, c.c_mktsegment AS seg, n.n_name AS nation, coalesce(li.a, []) AS a,
        list_filter(coalesce(li.a, []), lambda x: x.ln % 5 <> 0) AS p
      FROM orders o LEFT JOIN li ON li.k = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
t AS (SELECT *, len(a) AS na, len(p) AS np,
   lower(array_to_string(list_transform(p, lambda x: CASE WHEN x.pk % 5 = 0 THEN '' ELSE x.sup END), ' ')) AS names,
   CASE WHEN k % 9 = 0 THEN '' ELSE array_to_string(list_transform(p, lambda x: x.mo), ' ') END AS dates,
   len(list_filter(p, lambda x: x.pk % 5 = 0)) > 0 AS any_private, len(list_filter(p, lambda x: x.op)) > 0 AS any_open,
   len(list_filter(a, lambda x: x.op)) > 0 AS want_open,
   len(list_filter(p, lambda x: x.pk % 4 <> 0)) AS long_details,
   lower(array_to_string(list_transform(p[1:2], lambda x: 'order part-' || CAST(x.pk AS VARCHAR) || ' ' || x.sup), '  ')) AS act,
   CASE WHEN k % 4 = 0 THEN '' ELSE 'trade ' || nation || ' ' || seg END AS abroad,
   array_to_string(list_transform(p[1:3], lambda x: 'cert-' || CAST(x.pk AS VARCHAR) || ' ' || seg || ' ' || x.mo), ' ') AS cert,
   array_to_string(list_transform(p[1:2], lambda x: 'award ' || x.rf || ' ' || seg || ' ' || x.mo || ' '), ' ') AS award,
   k % 4 AS nl, CASE WHEN k % 8 = 0 THEN -1 ELSE k % 3 END AS nlinks FROM b),
h AS (SELECT *,
   len(list_filter(a, lambda x: CASE WHEN x.pk % 5 = 0 THEN any_private ELSE strpos(names, lower(x.sup)) > 0 END)) AS hits,
   len(list_filter(a, lambda x: x.pk % 7 <> 0 AND strpos(dates, x.mo) > 0)) AS starts, len(list_filter(a, lambda x: x.pk % 7 <> 0)) AS dated,
   CAST(coalesce(list_sum(list_transform(a[1:2], lambda x: CASE WHEN strpos(act, 'part-' || CAST(x.pk AS VARCHAR)) > 0 THEN 2
       WHEN strpos(act, lower(x.sup)) > 0 THEN 1 ELSE 0 END)), 0) AS DOUBLE) AS act_pts,
   CAST(coalesce(list_sum(list_transform(a[1:3], lambda x: CASE WHEN strpos(cert, 'cert-' || CAST(x.pk AS VARCHAR)) > 0
       THEN 1.0 + (CASE WHEN strpos(cert, x.mo) > 0 THEN 0.5 ELSE 0.0 END) ELSE 0.0 END)), 0) AS DOUBLE) AS cert_pts,
   CAST(coalesce(list_sum(list_transform(a[1:2], lambda x: CASE WHEN strpos(lower(award), 'award ' || lower(x.rf)) > 0
       THEN 1.0 + (CASE WHEN strpos(award, x.mo) > 0 THEN 0.5 ELSE 0.0 END) ELSE 0.0 END)), 0) AS DOUBLE) AS award_pts,
   len(list_filter(a[1:2], lambda x: strpos(act, 'part-' || CAST(x.pk AS VARCHAR)) > 0)) AS act_kw,
   len(list_filter(a[1:3], lambda x: strpos(lower(cert), 'cert-' || CAST(x.pk AS VARCHAR)) > 0)) AS cert_kw,
   len(list_filter(a[1:2], lambda x: strpos(lower(award), 'award ' || lower(x.rf)) > 0)) AS award_kw,
   CASE WHEN k % 6 = 0 THEN NULL WHEN k % 2 = 0 THEN 'done' WHEN k % 7 = 0 THEN 'exempt' ELSE 'none' END AS mstat,
   CASE WHEN k % 3 = 0 THEN 'none' ELSE 'done' END AS wstat FROM t),
"""
_CAREER_PARTS = {
    "career_count": "CASE WHEN np = na THEN 5 WHEN np >= 2 THEN 3 ELSE 0 END",
    "companies": "trunc(CAST(hits AS DOUBLE) / CAST(greatest(na, 1) AS DOUBLE) * 5.0)",
    "currently_employed": "CASE WHEN any_open THEN 3 ELSE 0 END",
    "career_dates": "trunc(CAST(starts AS DOUBLE) / CAST(greatest(na, 1) AS DOUBLE) * 5.0)",
    "work_details": "CASE WHEN long_details >= 3 THEN 5 ELSE trunc(CAST(long_details AS DOUBLE) / 3.0 * 5.0) END",
    "career_meta": "(CASE WHEN len(list_filter(p, lambda x: x.rf = 'R')) > 0 THEN 2 ELSE 0 END) + (CASE WHEN np > 0 THEN 1 ELSE 0 END)"
                   " + (CASE WHEN len(list_filter(p, lambda x: strpos(CAST(x.qty AS VARCHAR), '8') > 0)) > 0 THEN 2 ELSE 0 END)"
                   " + (CASE WHEN np > 0 AND (strpos(seg, 'AUTO') > 0 OR strpos(seg, 'HOUSE') > 0) THEN 1 ELSE 0 END)"
                   " + (CASE WHEN np > 0 AND strpos(seg, 'BUILD') > 0 THEN 1 ELSE 0 END)",
    "activities": "least(trunc((CASE WHEN least(np, 2) = 2 THEN 3 ELSE 0 END) + act_pts), 10)",
    "overseas": "CASE WHEN k % 4 = 0 THEN 0 ELSE 5 END",
    "languages": "trunc((CASE WHEN nl >= 2 THEN 2 ELSE 0 END) + (CASE WHEN nl >= 1 THEN 1 ELSE 0 END) + (CASE WHEN nl >= 3 THEN 1 ELSE 0 END)"
                 " + (CASE WHEN nl >= 2 THEN 1.0 + (CASE WHEN strpos(CAST(k % 990 AS VARCHAR), '9') > 0 THEN 0.5 ELSE 0.0 END) ELSE 0.0 END))",
    "certificates": "least(trunc((CASE WHEN least(np, 3) = least(na, 3) THEN 3 WHEN least(np, 3) >= 3 THEN 2 WHEN np >= 1 THEN 1 ELSE 0 END) + cert_pts), 10)",
    "awards": "least(trunc((CASE WHEN least(np, 2) = 2 THEN 2 ELSE 0 END) + award_pts), 8)",
    "military": "CASE WHEN mstat IS NULL THEN 0 ELSE (CASE WHEN mstat = wstat THEN 2 ELSE 0 END) + 4 + (CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END)"
                " + (CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END) + 1 END",
    "sns": "CASE WHEN nlinks < 0 THEN 0 ELSE nlinks + (CASE WHEN nlinks >= 2 THEN 1 ELSE 0 END) END",
}
_MULTI_PARTS = {
    "career_count": "CASE WHEN np = na THEN 10 WHEN np >= na - 1 THEN 6 WHEN np >= 1 THEN 3 ELSE 0 END",
    "companies": "trunc(CAST(hits AS DOUBLE) / CAST(greatest(na, 1) AS DOUBLE) * 10.0)",
    "currently_employed": "CASE WHEN any_open = want_open THEN 5 ELSE 0 END",
    "dates": "trunc(CAST(starts AS DOUBLE) / CAST(greatest(dated, 1) AS DOUBLE) * 10.0)",
    "work_details": "trunc(CAST(long_details AS DOUBLE) / CAST(greatest(len(list_filter(a, lambda x: x.pk % 5 <> 0)), 1) AS DOUBLE) * 10.0)",
    "activities": "least((CASE WHEN least(np, 2) = 2 THEN 4 WHEN np >= 1 THEN 2 ELSE 0 END) + 3 * act_kw, 10)",
    "overseas": "CASE WHEN k % 4 = 0 THEN 0 ELSE 4 END",
    "languages": "(CASE WHEN nl >= 2 THEN 3 WHEN nl >= 1 THEN 1 ELSE 0 END) + (CASE WHEN nl >= 1 THEN 2 ELSE 0 END) + (CASE WHEN nl >= 2 THEN 2 ELSE 0 END)",
    "certificates": "least((CASE WHEN least(np, 3) = least(na, 3) THEN 3 WHEN least(np, 3) >= greatest(least(na, 3) - 1, 1) THEN 1 ELSE 0 END) + 2 * cert_kw, 10)",
    "awards": "least((CASE WHEN least(np, 2) = 2 THEN 2 ELSE 0 END) + award_kw, 5)",
    "military": "CASE WHEN mstat IS NULL THEN (CASE WHEN wstat = 'none' THEN 5 ELSE 0 END) WHEN wstat = 'none' THEN (CASE WHEN mstat IN ('none', 'exempt') THEN 10 ELSE 0 END)"
                " ELSE (CASE WHEN mstat = wstat THEN 3 ELSE 0 END) + 5 + (CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END) + 1 END",
    "sns": "CASE WHEN nlinks < 0 THEN 0 ELSE nlinks + (CASE WHEN nlinks >= 2 THEN 1 ELSE 0 END) END",
}


def _career_sql(parts: dict, top: int) -> str:
    cols = ", ".join(f"CAST(CASE WHEN k % 11 = 0 THEN 0 ELSE {v} END AS INTEGER) AS {n}" for n, v in parts.items())
    listed = " || ',' || ".join(f"'{n}=' || CAST({n} AS VARCHAR)" for n in sorted(parts))
    total = " + ".join(parts)
    return f"""{_CAREER} z AS (SELECT k, {cols} FROM h)
SELECT 'ord_' || CAST(k AS VARCHAR) AS doc_key, CAST({total} AS INTEGER) AS total, CAST(CASE WHEN k % 11 = 0 THEN 100 ELSE {top} END AS INTEGER) AS max,
       round(CAST({total} AS DOUBLE) / {float(top)} * 100.0, 1) AS pct, {listed} AS components FROM z"""


SQL["career_rubric"] = _career_sql(_CAREER_PARTS, 90)
SQL["multi_career_rubric"] = _career_sql(_MULTI_PARTS, 100)
SQL["component_matrix"] = _CAREER + " z AS (SELECT k, " + ", ".join(f"CAST({v} AS INTEGER) AS {n}" for n, v in _CAREER_PARTS.items()) + """
  FROM h WHERE k % 11 <> 0), c AS (SELECT *, CASE k % 3 WHEN 0 THEN 'A_desc' WHEN 1 THEN 'B_nodesc' ELSE 'C_rich' END AS combination FROM z)
""" + " UNION ALL ".join(f"SELECT combination, '{n}' AS component, avg({n}) AS avg_points FROM c GROUP BY combination" for n in _CAREER_PARTS)

"""Article XML into documents with Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# English month names by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_DATE = "struct<Year:string,Month:string,Day:string,MedlineDate:string>"
_AUTHOR = "struct<_ValidYN:string,LastName:string,ForeName:string,Initials:string,AffiliationInfo:array<struct<Affiliation:string>>>"
_TEXTS = "array<struct<_VALUE:string>>"
SCHEMA = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,"
    f"Article:struct<ArticleTitle:string,Abstract:string,AuthorList:struct<Author:array<{_AUTHOR}>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:{_DATE}>>,ArticleDate:array<{_DATE}>,PublicationTypeList:struct<PublicationType:{_TEXTS}>>,"
    f"MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>,KeywordList:array<struct<Keyword:{_TEXTS}>>>, "
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)


def _plain(c: Column) -> Column:
    """Inner XML as text: no tags, basic entities resolved."""
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def date_of(d: Column) -> Column:
    """A date element: month a number or an English name (unknown: January), missing parts 1, an impossible day or
    month the year's first day; without a year the four digits that a free-form date starts with."""
    month = F.lower(F.substring(d["Month"], 1, 3))
    number = F.when(d["Month"].rlike(r"^\d+$"), d["Month"].try_cast("int")).otherwise(F.coalesce(F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))[month], F.lit(1)))
    year = F.nullif(d["Year"], F.lit("")).try_cast("int")
    parts = F.format_string("%04d-%02d-%02d", year, F.coalesce(number, F.lit(1)), F.coalesce(F.nullif(d["Day"], F.lit("")).try_cast("int"), F.lit(1)))
    dated = F.coalesce(F.try_to_date(parts, "yyyy-MM-dd"), F.make_date(year, F.lit(1), F.lit(1)))
    loose = F.regexp_extract(d["MedlineDate"], r"^(\d{4})", 1).try_cast("int")
    return F.when(year.isNotNull(), dated).otherwise(F.make_date(loose, F.lit(1), F.lit(1)))


def publication_date(electronic: Column, journal: Column) -> Column:
    """The first electronic date, else the journal's."""
    return F.coalesce(date_of(F.get(electronic, 0)), date_of(journal))


def _abstract(c: Column) -> Column:
    sections = F.regexp_extract_all(c, F.lit(r"(?s)(<AbstractText[^>]*?(?<!/)>.*?</AbstractText>)"), 1)

    def one(s):
        label, text = F.regexp_extract(s, r'^<AbstractText[^>]*\bLabel="([^"]*)"', 1), _plain(s)
        return F.when((text != "") & (label != ""), F.concat(label, F.lit(": "), text)).otherwise(text)

    return F.when(F.size(sections) > 0, F.array_join(F.filter(F.transform(sections, one), lambda x: x != ""), "\n\n"))


def _values(c: Column) -> Column:
    return F.filter(F.transform(c, lambda x: x["_VALUE"]), lambda x: x.isNotNull() & (x != ""))


def read_articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """documents from PubmedArticle elements. Elements without PMID or that don't parse are skipped; titles and
    abstracts keep the text of nested elements, abstract sections are joined by a blank line with their labels."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "DROPMALFORMED").schema(SCHEMA).load(path)
    m, a = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    valid = F.filter(a["AuthorList"]["Author"], lambda x: (F.coalesce(x["_ValidYN"], F.lit("Y")) != "N") & (F.coalesce(x["LastName"], F.lit("")) != ""))

    def author(x):
        given = F.coalesce(F.nullif(x["ForeName"], F.lit("")), F.nullif(x["Initials"], F.lit("")))
        blank = lambda c: F.coalesce(c, F.lit(""))
        return F.struct(F.concat_ws(" ", given, x["LastName"]).alias("name"), x["LastName"].alias("last_name"), blank(x["ForeName"]).alias("first_name"), blank(x["Initials"]).alias("initials"), blank(F.get(x["AffiliationInfo"], 0)["Affiliation"]).alias("affiliation"))

    doi = F.get(F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: (x["_IdType"] == "doi") & (x["_VALUE"] != "")), 0)["_VALUE"]
    return rows.filter(m["PMID"]["_VALUE"].isNotNull()).select(
        F.sha2(m["PMID"]["_VALUE"], 256).alias("id"), m["PMID"]["_VALUE"].alias("pmid"), F.coalesce(_plain(a["ArticleTitle"]), F.lit("")).alias("title"), _abstract(a["Abstract"]).alias("abstract"),
        F.coalesce(F.transform(valid, author), F.array()).alias("authors"), a["Journal"]["Title"].alias("journal"), publication_date(a["ArticleDate"], a["Journal"]["JournalIssue"]["PubDate"]).alias("publication_date"), F.coalesce(doi, F.lit("")).alias("doi"),
        F.coalesce(F.filter(F.transform(m["MeshHeadingList"]["MeshHeading"], lambda x: x["DescriptorName"]["_VALUE"]), lambda x: x.isNotNull()), F.array()).alias("mesh_terms"),
        F.struct(F.coalesce(F.flatten(F.transform(m["KeywordList"], lambda k: _values(k["Keyword"]))), F.array()).alias("keywords"), F.coalesce(_values(a["PublicationTypeList"]["PublicationType"]), F.array()).alias("publication_types")).alias("extra_data"),
    )

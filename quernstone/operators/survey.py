"""Survey tables: results, categories, category documents and facility profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.ids import stable_id
from quernstone.functions.text import clean_value, escape_cell

#: Prefixes of measures by category, in order, and the categories' labels.
CATEGORY_PREFIXES = {
    "nurse_communication": ("H_COMP_1", "H_NURSE"),
    "doctor_communication": ("H_COMP_2", "H_DOCTOR"),
    "medication_communication": ("H_COMP_5", "H_MED", "H_SIDE_EFFECTS"),
    "discharge_information": ("H_COMP_6", "H_DISCH", "H_SYMPTOMS"),
    "hospital_environment": ("H_CLEAN", "H_QUIET"),
    "overall_rating_and_recommendation": ("H_HSP", "H_RECMND", "H_STAR_RATING"),
}
CATEGORY_LABELS = {
    "nurse_communication": "Nurse communication",
    "doctor_communication": "Doctor communication",
    "medication_communication": "Medication communication",
    "discharge_information": "Discharge information",
    "hospital_environment": "Hospital environment",
    "overall_rating_and_recommendation": "Overall rating and recommendation",
}
#: Column names of the survey file and of the table.
COLUMNS = {
    "Facility ID": "facility_id", "Facility Name": "facility_name", "Address": "address", "City/Town": "city", "State": "state",
    "ZIP Code": "zip_code", "County/Parish": "county", "Telephone Number": "telephone", "HCAHPS Measure ID": "measure_id",
    "HCAHPS Question": "question", "HCAHPS Answer Description": "answer_description", "Patient Survey Star Rating": "star_rating",
    "Patient Survey Star Rating Footnote": "star_rating_footnote", "HCAHPS Answer Percent": "answer_percent",
    "HCAHPS Answer Percent Footnote": "answer_percent_footnote", "HCAHPS Linear Mean Value": "linear_mean_value",
    "Number of Completed Surveys": "completed_surveys", "Number of Completed Surveys Footnote": "completed_surveys_footnote",
    "Survey Response Rate Percent": "response_rate_percent", "Survey Response Rate Percent Footnote": "response_rate_footnote",
    "Start Date": "survey_start_date", "End Date": "survey_end_date",
}
NO_RESULT = ("not applicable", "not available", "n/a")


def measure_category(measure: Column, prefixes: dict[str, tuple[str, ...]] = CATEGORY_PREFIXES, strict: bool = True) -> Column:
    """Category of a measure by the first prefix that fits; others raise, or are null if not strict."""
    out = None
    for category, starts in prefixes.items():
        hit = F.lit(False)
        for s in starts:
            hit = hit | measure.startswith(s)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(F.raise_error(F.concat(F.lit("Unmapped measure: "), measure)).cast("string")) if strict else out


def row_result(star: Column, percent: Column, mean: Column) -> Column:
    """STRUCT<result_type, result>: the first of star rating, percent and mean that says something."""

    def of(label: str, x: Column, suffix: str = "") -> Column:
        value = clean_value(x)
        shown = F.struct(F.lit(label).alias("result_type"), F.concat(value, F.lit(suffix)).alias("result"))
        return F.when(value.isNotNull() & ~F.lower(value).isin(*NO_RESULT), shown)

    none = F.struct(F.lit("result").alias("result_type"), F.lit("Not available").alias("result"))
    return F.coalesce(of("star rating", star), of("answer percent", percent, "%"), of("linear mean", mean), none)


def category_docs(records: DataFrame, document_id: str) -> DataFrame:
    """One row per facility and category: markdown table, retrieval lines, measure ids and row numbers in file order.

    records: the survey's columns, source_row_number. The group is one facility's answers.
    """
    shown = records.withColumns({"category": measure_category(F.col("measure_id")), "r": row_result(F.col("star_rating"), F.col("answer_percent"), F.col("linear_mean_value"))})
    question = F.coalesce(clean_value(F.col("question")), clean_value(F.col("measure_id")))
    row = F.struct(F.col("source_row_number").alias("n"), clean_value(F.col("measure_id")).alias("id"), question.alias("q"), F.col("r.result_type").alias("t"), F.col("r.result").alias("v"))
    groups = shown.groupBy("facility_id", "category").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    cells = lambda s: F.concat(F.lit("| "), F.array_join(F.transform(F.array(s["id"], s["q"], s["t"], s["v"]), escape_cell), " | "), F.lit(" |"))
    table = F.concat(F.lit("| Measure ID | Measure | Result type | Result |\n|---|---|---|---:|\n"), F.array_join(F.transform("rows", cells), "\n"))
    return groups.select(
        stable_id(F.lit(document_id), F.col("facility_id"), F.col("category")).alias("category_doc_id"), "facility_id", "category", table.alias("table_markdown"),
        F.array_join(F.transform("rows", lambda s: F.concat(F.lit("- "), s["q"], F.lit(": "), s["v"])), "\n").alias("lines"),
        F.transform("rows", lambda s: s["id"]).alias("measure_ids"), F.transform("rows", lambda s: s["n"]).alias("source_row_numbers"),
    )


def category_text(docs: DataFrame, facilities: DataFrame) -> DataFrame:
    """Adds retrieval_text to category docs. facilities: facility_id and its first row's columns."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv]), F.col("category"))
    value = lambda c: F.coalesce(clean_value(F.col(c)), F.lit("Not available"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Hospital: "), "facility_name"), F.concat(F.lit("Facility ID: "), "facility_id"),
        F.concat(F.lit("Location: "), F.concat_ws(", ", clean_value(F.col("city")), clean_value(F.col("state")))), F.concat(F.lit("Category: "), label),
        F.concat(F.lit("Survey period: "), "survey_start_date", F.lit(" to "), "survey_end_date"), F.concat(F.lit("Completed surveys: "), value("completed_surveys")),
        F.concat(F.lit("Survey response rate: "), value("response_rate_percent"), F.lit("%")), F.lit(""), "lines",
    )
    return docs.join(facilities, "facility_id").withColumn("retrieval_text", text)


def profiles(records: DataFrame, document_id: str) -> DataFrame:
    """One row per facility: profile_id, first row's values, measures by category as a nested map, counts."""
    shown = records.withColumns({"category": measure_category(F.col("measure_id")), "r": row_result(F.col("star_rating"), F.col("answer_percent"), F.col("linear_mean_value"))})
    first_row = F.struct("facility_name", "address", "city", "state", "zip_code", "completed_surveys", "response_rate_percent", "survey_start_date", "survey_end_date")
    # of a measure's rows the last counts; one row a measure reaches the facility, so that no map is given a key twice
    measures = shown.groupBy("facility_id", "category", "measure_id").agg(
        F.max_by(F.struct("question", "r.result_type", "r.result"), "source_row_number").alias("v"), F.collect_list("source_row_number").alias("ns"),
        F.min("source_row_number").alias("n"), F.min_by(first_row, "source_row_number").alias("first"),
    )
    entry = F.struct(F.col("category").alias("c"), F.col("measure_id").alias("id"), "v")
    grouped = measures.groupBy("facility_id").agg(
        F.array_sort(F.collect_list(entry)).alias("rows"), F.min_by("first", "n").alias("first"), F.array_sort(F.flatten(F.collect_list("ns"))).alias("source_row_numbers")
    ).select("facility_id", "rows", "source_row_numbers", "first.*")
    of = lambda c: F.map_from_entries(F.transform(F.filter("rows", lambda s: s["c"] == c), lambda s: F.struct(s["id"], s["v"])))
    summary = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(c), of(c)) for c in CATEGORY_PREFIXES])), lambda k, v: F.cardinality(v) > 0)
    return grouped.select(
        stable_id(F.lit(document_id), F.col("facility_id"), F.lit("profile")).alias("profile_id"), "facility_id",
        *[c for c in ("facility_name", "address", "city", "state", "zip_code", "completed_surveys", "response_rate_percent")],
        F.try_to_date("survey_start_date", "M/d/yyyy").alias("survey_start_date"), F.try_to_date("survey_end_date", "M/d/yyyy").alias("survey_end_date"),
        summary.alias("category_summaries"), F.size("source_row_numbers").alias("measure_count"), "source_row_numbers",
    )


def contiguity(rows: DataFrame, key: str, order: str, by: list[str]) -> DataFrame:
    """(by, key, runs): into how many runs the rows of a key fall; 1 means that they are contiguous."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("starts", ~F.col(key).eqNullSafe(before) | before.isNull()).groupBy(*by, key).agg(F.count_if("starts").alias("runs"))

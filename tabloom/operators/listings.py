"""Headers of listings: which field a column holds, and what is wrong with a mapping.

A header holds a field's phrase if the phrase stands in it as whole words in a row: `Dosage` says nothing of an age. Of several phrases
the one that is the whole header wins, then the one of most words, so `Local case ID` is no worldwide one. A field goes to one column of a
source, that with the best claim (ties: the first), and a column whose field is gone gets the next it has a claim to.

Null and edge cases: a null or blank header has no field; headers are compared without case and punctuation; repeated headers are
columns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.resolution import assign
from tabloom.sources.cases import LISTED

#: What exports call the fields of cases.LISTED.
PHRASES = {
    "worldwide_case_id": ("worldwide case id", "worldwide case number", "case id", "caseid", "case number", "case no", "case reference", "icsr number", "aer number", "safety report id", "report id"),
    "local_case_id": ("local case id", "local case number", "local case", "local id", "local number", "local no"),
    "case_version": ("case version", "version number", "follow up number"),
    "initial_receipt_date": ("initial receipt date", "initial receipt", "initial received", "first received", "date received", "received date", "receipt date"),
    "latest_receipt_date": ("latest receipt date", "latest receipt", "latest received", "last received", "most recent receipt", "follow up receipt"),
    "country": ("country of occurrence", "occurrence country", "country"),
    "report_source": ("source of report", "report source", "report type", "case type"),
    "study_id": ("study id", "study number", "study name", "trial id", "protocol number"),
    "qualification": ("reporter qualification", "reporter type", "qualification", "reporter"),
    "is_serious": ("seriousness flag", "serious case", "seriousness", "serious"),
    "seriousness_criteria": ("seriousness criteria", "seriousness criterion", "serious criteria", "criteria for seriousness"),
    "case_outcome": ("case outcome", "patient outcome"),
    "patient_age": ("patient age", "age at onset", "age"),
    "patient_sex": ("patient sex", "sex", "gender"),
    "narrative": ("case narrative", "narrative", "clinical course"),
    "verbatim_term": ("verbatim term", "verbatim", "reported term", "reporter term", "event as reported"),
    "pt": ("preferred term", "meddra pt", "pt name", "pt"),
    "llt": ("lowest level term", "meddra llt", "llt"),
    "soc": ("system organ class", "meddra soc", "soc"),
    "version": ("meddra version", "dictionary version"),
    "onset_date": ("event onset date", "onset date", "date of onset", "event onset", "reaction start"),
    "event_outcome": ("event outcome", "reaction outcome", "outcome of event"),
    "drug_name": ("suspect drug", "suspect product", "medicinal product", "drug name", "product name"),
    "drug_role": ("drug role", "drug characterisation", "drug characterization", "role"),
    "drug_indication": ("drug indication", "indication"),
}


def suggest_fields(headers: DataFrame) -> DataFrame:
    """source, place, header, field, confidence: 1.0 where the phrase is the whole header, 0.7 where the header holds it, 0.0 for none."""
    spark = headers.sparkSession
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    known = spark.createDataFrame([(f, p.split()) for f, ps in PHRASES.items() for p in ps], "field string, phrase array<string>")
    known = F.broadcast(known.withColumn("word", F.get("phrase", F.lit(0))))
    at = headers.select("source", "place", words(F.col("header")).alias("words")).select("source", "place", "words", F.posexplode("words").alias("i", "word"))
    met = at.join(known, "word").where(F.slice("words", F.col("i") + 1, F.size("phrase")) == F.col("phrase"))
    whole = F.size("words") == F.size("phrase")
    claim = F.when(whole, 1000).otherwise(0) + F.size("phrase")
    claims = met.select("source", F.format_string("%09d", F.col("place").cast("long")).alias("target"), F.col("field").alias("column"), claim.cast("double").alias("score"), F.when(whole, "whole").otherwise("part").alias("band"))
    given = assign(claims, "source").select("source", F.col("target").cast("long").alias("_place"), F.col("column").alias("field"), F.when(F.col("band") == "whole", 1.0).otherwise(0.7).alias("confidence"))
    out = headers.select("source", "place", "header").join(given.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("place") == F.col("_place")), "left")
    return out.select("source", "place", "header", "field", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def mapping_faults(mappings: DataFrame, required: tuple[str, ...] = ("worldwide_case_id",), known: tuple[str, ...] = LISTED) -> DataFrame:
    """source, fault, field of mappings (source, column, field): required fields that no column has, fields that nothing holds, and
    fields that two columns have."""
    m = mappings.select("source", "column", "field").distinct()
    missing = None
    for f in required:
        one = m.groupBy("source").agg(F.coalesce(F.max((F.col("field") == f).cast("int")), F.lit(0)).alias("has")).where("has = 0").select("source", F.lit("missing").alias("fault"), F.lit(f).alias("field"))
        missing = one if missing is None else missing.unionByName(one)
    unknown = m.where(F.col("field").isNotNull() & ~F.col("field").isin(*known)).select("source", F.lit("unknown").alias("fault"), "field").distinct()
    twice = m.where("field is not null").groupBy("source", "field").count().where("count > 1").select("source", F.lit("duplicate").alias("fault"), "field")
    out = unknown.unionByName(twice)
    return out if missing is None else out.unionByName(missing)

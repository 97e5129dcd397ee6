"""Safety cases with their events and drugs, from XML reports of two generations and from listings: both give one schema.

XML is walked without regard to namespaces: a report is an outermost element of a known name, its leaves are the elements that
hold a text or, as the newer generation writes it, an attribute. A leaf belongs to the reaction or drug around it, else to the
report. Leaves that no field takes are kept by their path. A listing is folded: rows of one case identifier are one case, whose own
fields come from its first row, and whose events and drugs come from all rows.

Null and edge cases: what a source does not say is null and never false; codes without a meaning stay as written; a partial date is its
first day and has its precision beside it; a report without identifier, reaction and drug is left out; a file with entity
declarations is refused. Listing rows without an identifier, or with a date that reads two ways, are skipped with a reason.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.dates import parse_flag, parse_ordered, parse_partial
from tabloom.sources.records import SourceUnreadable

#: Element names and code lists of the exchange format.
REPORTS = ("safetyreport", "investigationevent", "icsr")
HOLDERS = {"reaction": "reaction", "reactionmeddra": "reaction", "drug": "drug"}
VALUE_ATTRIBUTES = ("value", "extension", "displayName", "code")
SEX = {"0": "unknown", "1": "male", "2": "female", "9": "unknown"}
SOURCE = {"1": "spontaneous", "2": "clinical_trial", "3": "other", "4": "literature"}
QUALIFICATION = {"1": "physician", "2": "pharmacist", "3": "other_health_professional", "4": "lawyer", "5": "consumer"}
OUTCOME = {"1": "recovered", "2": "recovering", "3": "not_recovered", "4": "recovered_with_sequelae", "5": "fatal", "6": "unknown"}
ROLE = {"1": "suspect", "2": "concomitant", "3": "interacting"}
ACTION = {"1": "drug_withdrawn", "2": "dose_reduced", "3": "dose_increased", "4": "dose_not_changed", "5": "unknown", "6": "not_applicable"}
CHALLENGE = {"1": "positive", "2": "negative", "3": "not_applicable", "4": "unknown"}
CRITERIA = {
    "seriousnessdeath": "death", "seriousnesslifethreatening": "life_threatening", "seriousnesshospitalization": "hospitalisation", "seriousnessdisabling": "disability",
    "seriousnesscongenitalanomali": "congenital_anomaly", "seriousnesscongenitalanomaly": "congenital_anomaly", "seriousnessother": "other_medically_important",
}
#: Years of a unit of age.
AGE_UNITS = {"801": 1.0, "802": 1 / 12, "803": 1 / 52.18, "804": 1 / 365.25, "805": 1 / 8766}

EVENT = "struct<verbatim_term: string, pt: string, llt: string, soc: string, version: string, onset_date: date, outcome: string>"
DRUG = "struct<drug_name: string, role: string, is_company_product: boolean, dose: string, dose_unit: string, frequency: string, route: string, indication: string, start_date: date, end_date: date, action_taken: string, dechallenge: string, rechallenge: string>"
#: Columns of a case, whatever it came from.
CASE = {
    "worldwide_case_id": "string", "local_case_ids": "array<string>", "case_version": "int", "report_source": "string", "study_id": "string", "country": "string",
    "qualification": "string", "is_medically_confirmed": "boolean", "initial_receipt_date": "date", "latest_receipt_date": "date", "is_serious": "boolean",
    "seriousness_criteria": "array<string>", "case_outcome": "string", "patient_age": "double", "patient_age_group": "string", "patient_sex": "string", "narrative": "string",
    "events": f"array<{EVENT}>", "drugs": f"array<{DRUG}>", "date_precision": "map<string, string>", "missing": "map<string, string>", "unmapped": "map<string, string>",
}

LEAF = "struct<holder: string, no: int, name: string, path: string, value: string>"
#: A reaction or drug of a report with its own leaves, in order.
HELD = "struct<kind: string, no: int, leaves: array<struct<name: string, value: string>>>"


def report_leaves(data: bytes) -> Iterator[list[tuple[str, int, str, str, str]]]:
    """(holder, number of the holder, name, path, value) of the leaves of each outermost report, one report in memory at a time."""
    if b"<!ENTITY" in data:
        raise SourceUnreadable("the file declares entities, which are not expanded")
    names: list[str] = []
    holders: list[tuple[str, int]] = []
    leaves: list[tuple[str, int, str, str, str]] = []
    start, counted, seen = None, {}, {}
    for event, node in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
        name = node.tag.rpartition("}")[2].lower()
        if event == "start":
            if start is None and name in REPORTS:
                start, leaves, counted, seen = len(names), [], {}, {}
            names.append(name)
            kind = HOLDERS.get(name)
            if start is not None and kind and not any(k == kind for k, _ in holders):
                counted[kind] = counted.get(kind, 0) + 1
                holders.append((kind, counted[kind]))
            else:
                holders.append(("", 0))
            continue
        if start is not None:
            value = (node.text or "").strip() or next((v for a in VALUE_ATTRIBUTES if (v := (node.get(a) or "").strip())), "")
            if value:
                holder, no = next((h for h in reversed(holders) if h[0]), ("report", 0))
                path = "/".join(names[start + 1 :])
                seen[path] = seen.get(path, 0) + 1
                leaves.append((holder, no, name, path if seen[path] == 1 else f"{path}[{seen[path]}]", value))
        names.pop()
        holders.pop()
        if start is not None and len(names) == start:
            yield leaves
            start = None
        if start is None:
            node.clear()


#: Leaves of the reports that leave a Python worker together, unless one report has more.
BATCH_LEAVES = 20_000


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = lambda rows: pd.DataFrame(rows, columns=["path", "report", "leaves", "held"])
    for b in batches:
        for path, data in zip(b["path"], b["content"], strict=True):
            found, held = [], 0
            for i, leaves in enumerate(report_leaves(bytes(data))):
                if found and held + len(leaves) > BATCH_LEAVES:
                    yield table(found)
                    found, held = [], 0
                own: dict[tuple[str, int], list[tuple[str, str]]] = {}
                for holder, no, name, _, value in leaves:
                    if no:
                        own.setdefault((holder, no), []).append((name, value))
                found.append((path, i, leaves, [(*k, own[k]) for k in sorted(own)]))
                held += len(leaves)
            yield table(found)


def decode(c: Column, codes: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def _flag(c: Column) -> Column:
    """The format's own flags: 2 is no."""
    return F.when(c == "2", False).otherwise(parse_flag(c))


class _Holder:
    """Values of a report, or of one reaction or drug, by the names of their elements."""

    def __init__(self, leaves: Column):
        self.leaves, self.known = leaves, set()

    def text(self, *names: str) -> Column:
        """Value of the first leaf of any of these names."""
        self.known.update(names)
        return F.get(F.filter(self.leaves, lambda x: x["name"].isin(*names)), F.lit(0))["value"]

    def date(self, *names: str) -> Column:
        return parse_partial(self.text(*names))


def _missing(**fields: Column) -> Column:
    """Map of reasons, without those that are null."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values())), lambda k, v: v.isNotNull())


def _as_case(columns: dict[str, Column]) -> list[Column]:
    return [columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in CASE.items()]


def xml_cases(files: DataFrame, products: Sequence[str] = ()) -> DataFrame:
    """Cases of the reports in files (path, content), with path and report, the report's number in its file."""
    raw = files.select("path", "content").mapInPandas(_leaves, f"path string, report int, leaves array<{LEAF}>, held array<{HELD}>")
    part = lambda kind: F.filter("leaves", lambda x: x["holder"] == kind)
    ours = [p.strip().lower() for p in products if p and p.strip()]
    known: set[str] = set()

    def each(kind: str, build) -> Column:
        def one(x: Column) -> Column:
            h = _Holder(x["leaves"])
            out = build(h)
            known.update(h.known)
            return out

        return F.transform(F.filter("held", lambda x: x["kind"] == kind), one)

    def event(h: _Holder) -> Column:
        return F.struct(
            h.text("primarysourcereaction", "reactionmeddrallt").alias("verbatim_term"), h.text("reactionmeddrapt").alias("pt"), h.text("reactionmeddrallt").alias("llt"), F.lit(None).cast("string").alias("soc"),
            h.text("reactionmeddraversionpt", "reactionmeddraversionllt").alias("version"), h.date("reactionstartdate")["value"].alias("onset_date"), decode(h.text("reactionoutcome"), OUTCOME).alias("outcome"),
        )

    def drug(h: _Holder) -> Column:
        name = h.text("medicinalproduct", "activesubstancename")
        own = F.lit(False)
        for p in ours:
            own = own | F.lower(name).contains(p)
        return F.struct(
            name.alias("drug_name"), decode(h.text("drugcharacterization"), ROLE).alias("role"), F.coalesce(own, F.lit(False)).alias("is_company_product"), h.text("drugdosagetext", "drugstructuredosagenumb").alias("dose"),
            h.text("drugstructuredosageunit").alias("dose_unit"), h.text("drugintervaldosagedefinition").alias("frequency"), h.text("drugadministrationroute").alias("route"), h.text("drugindication", "drugindicationmeddrapt").alias("indication"),
            h.date("drugstartdate")["value"].alias("start_date"), h.date("drugenddate")["value"].alias("end_date"), decode(h.text("actiondrug"), ACTION).alias("action_taken"),
            decode(h.text("drugrecurreadministration"), CHALLENGE).alias("dechallenge"), decode(h.text("drugrechallenge"), CHALLENGE).alias("rechallenge"),
        )

    r = _Holder(part("report"))
    events = F.filter(each("reaction", event), lambda e: e["verbatim_term"].isNotNull() | e["pt"].isNotNull())
    drugs = F.filter(each("drug", drug), lambda x: x["drug_name"].isNotNull())
    ident, local, study = r.text("safetyreportid", "companynumb"), r.text("companynumb"), r.text("studyname", "studyregistrationnumber")
    first, latest = r.date("receivedate"), r.date("receiptdate")
    source = F.coalesce(decode(r.text("reporttype"), SOURCE), F.when(study.isNotNull(), "clinical_trial"))
    criteria = F.array_distinct(F.array_compact(F.array(*[F.when(_flag(r.text(n)), label) for n, label in CRITERIA.items()])))
    serious = F.coalesce(_flag(r.text("serious")), F.when(F.size(criteria) > 0, True))
    years = F.element_at(F.create_map(*[F.lit(x) for kv in AGE_UNITS.items() for x in kv]), F.coalesce(r.text("patientonsetageunit"), F.lit("801")))
    country = r.text("occurcountry", "primarysourcecountry")
    not_there = lambda c: F.when(c.isNull(), "not present in the file")
    columns = {
        "worldwide_case_id": ident, "local_case_ids": F.when(local != ident, F.array(local)).otherwise(F.array().cast("array<string>")), "case_version": r.text("safetyreportversion").try_cast("int"), "report_source": source, "study_id": study,
        "country": country, "qualification": decode(r.text("qualification"), QUALIFICATION), "is_medically_confirmed": _flag(r.text("medicalconfirm")), "initial_receipt_date": first["value"],
        "latest_receipt_date": F.coalesce(latest["value"], first["value"]), "is_serious": serious, "seriousness_criteria": criteria, "case_outcome": decode(r.text("patientdeath"), OUTCOME),
        "patient_age": F.bround(r.text("patientonsetage").try_cast("double") * years, 4), "patient_age_group": r.text("patientagegroup"), "patient_sex": decode(r.text("patientsex"), SEX), "narrative": r.text("narrativeincludeclinical"),
        "events": events, "drugs": drugs,
        "date_precision": _missing(initial_receipt_date=F.when(first["precision"] != "day", first["precision"]), latest_receipt_date=F.when(latest["precision"] != "day", latest["precision"])),
        "missing": _missing(worldwide_case_id=not_there(ident), latest_receipt_date=not_there(F.coalesce(latest["value"], first["value"])), country=not_there(country), report_source=not_there(source), events=F.when(F.size(events) == 0, "no reaction carried a term"), is_serious=F.when(serious.isNull(), "the file states no seriousness")),
    }
    known |= r.known
    left = F.filter("leaves", lambda x: ~x["name"].isin(*sorted(known)))
    columns["unmapped"] = F.map_from_arrays(F.transform(left, lambda x: x["path"]), F.transform(left, lambda x: x["value"]))
    out = raw.select("path", "report", *_as_case(columns))
    return out.where(F.col("worldwide_case_id").isNotNull() | (F.size("events") > 0) | (F.size("drugs") > 0))


def read_xml_cases(spark: SparkSession, path: str, products: Sequence[str] = ()) -> DataFrame:
    return xml_cases(spark.read.format("binaryFile").load(path), products)


#: Fields of a listing.
LISTED = (
    "worldwide_case_id", "local_case_id", "case_version", "initial_receipt_date", "latest_receipt_date", "country", "report_source", "study_id", "qualification", "is_serious", "seriousness_criteria",
    "case_outcome", "patient_age", "patient_sex", "narrative", "verbatim_term", "pt", "llt", "soc", "version", "onset_date", "event_outcome", "drug_name", "drug_role", "drug_indication",
)


def listing_cases(rows: DataFrame, mapping: dict[str, str], row_no: str = "_row_index", order: str | None = None, products: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Cases of a listing, and its skipped rows (row_no, reason). mapping: column -> field of LISTED; order: day_first or
    month_first, how the source writes numeric dates."""
    if unknown := sorted(set(mapping.values()) - set(LISTED)):
        raise ValueError(f"no fields of a listing: {', '.join(unknown)}")
    column = {}
    for c, f in mapping.items():
        column.setdefault(f, c)
    cell = lambda f: F.nullif(F.trim(F.col(f"`{column[f]}`").cast("string")), F.lit("")) if f in column else F.lit(None).cast("string")
    fold = lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]+", " ")), F.lit(""))
    r = rows.select(F.col(row_no).cast("long").alias("no"), *[cell(f).alias(f) for f in LISTED])
    dates = ("initial_receipt_date", "latest_receipt_date", "onset_date")
    for f in dates:
        r = r.withColumn(f"{f}_read", parse_ordered(F.col(f), order))
    unclear = F.coalesce(*[F.when(F.col(f"{f}_read.reason") == "ambiguous", F.concat(F.lit(f"{f} "), F.col(f), F.lit(" reads two ways and no date order is given"))) for f in dates])
    r = r.withColumn("reason", F.when(F.col("worldwide_case_id").isNull(), "no case identifier").otherwise(unclear))
    used = r.where("reason is null")
    for f in dates:
        used = used.withColumn(f, F.col(f"{f}_read.value"))
    own = F.lit(False)
    for p in [p.strip().lower() for p in products if p and p.strip()]:
        own = own | F.lower("drug_name").contains(p)
    event = F.struct("verbatim_term", "pt", "llt", "soc", "version", "onset_date", F.col("event_outcome").alias("outcome")).cast(EVENT)
    none = lambda *names: [F.lit(None).cast("date" if n.endswith("date") else "string").alias(n) for n in names]
    drug = F.struct(
        "drug_name", F.when(F.col("drug_role").isNull(), "suspect").otherwise(fold(F.col("drug_role"))).alias("role"), own.alias("is_company_product"), *none("dose", "dose_unit", "frequency", "route"),
        F.col("drug_indication").alias("indication"), *none("start_date", "end_date", "action_taken", "dechallenge", "rechallenge"),
    ).cast(DRUG)
    key = "worldwide_case_id"
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda v: v["x"])
    of_case = ["no", *[f for f in LISTED if f not in (key, "verbatim_term", "pt", "llt", "soc", "version", "onset_date", "event_outcome", "drug_name", "drug_role", "drug_indication")]]
    told = F.when(F.col("verbatim_term").isNotNull() | F.col("pt").isNotNull(), F.struct("no", event.alias("x")))
    cases = used.groupBy(key).agg(F.min_by(F.struct(*of_case), "no").alias("c"), in_order(told).alias("events"))
    # A drug counts once in a case, by its first row.
    drugs = used.where("drug_name is not null").groupBy(key, "drug_name").agg(F.min(F.struct("no", drug.alias("x"))).alias("d")).groupBy(key).agg(in_order(F.col("d")).alias("drugs"))
    cases = cases.join(drugs, key, "left").select(key, "c.*", "events", F.coalesce("drugs", F.array().cast(f"array<{DRUG}>")).alias("drugs"))
    criteria = F.array_compact(F.transform(F.filter(F.split(F.coalesce("seriousness_criteria", F.lit("")), r"[;,|/]"), lambda x: F.trim(x) != ""), lambda x: F.replace(fold(x), F.lit(" "), F.lit("_"))))
    flag = parse_flag(F.col("is_serious"))
    latest = F.coalesce("latest_receipt_date", "initial_receipt_date")
    columns = {f: F.col(f) for f in of_case if f in CASE} | {
        key: F.col(key), "local_case_ids": F.array_compact(F.array("local_case_id")), "case_version": F.col("case_version").try_cast("int"), "report_source": F.replace(fold(F.col("report_source")), F.lit(" "), F.lit("_")),
        "is_serious": F.coalesce(flag, F.when(F.size(criteria) > 0, True)), "seriousness_criteria": criteria, "latest_receipt_date": latest, "patient_age": F.col("patient_age").try_cast("double"), "patient_sex": fold(F.col("patient_sex")),
        "events": F.col("events"), "drugs": F.col("drugs"), "date_precision": F.create_map().cast("map<string, string>"), "unmapped": F.create_map().cast("map<string, string>"),
        "missing": _missing(latest_receipt_date=F.when(latest.isNull(), "no receipt date, so this case falls in no reporting interval"), events=F.when(F.size("events") == 0, "no row for this case carried a term")),
    }
    return cases.select(*_as_case(columns)), r.where("reason is not null").select("no", "reason")

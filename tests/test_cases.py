"""Cases from two generations of XML and from listings."""

from datetime import date

import pandas as pd
import pytest

from tabloom.sources import cases
from tabloom.sources.records import SourceUnreadable

OLD = """<ichicsr><safetyreport><safetyreportid>W-1</safetyreportid><safetyreportversion>2</safetyreportversion><companynumb>L-1</companynumb><occurcountry>FR</occurcountry><reporttype>2</reporttype>
<receivedate>202403</receivedate><serious>2</serious><seriousnessdeath>2</seriousnessdeath><primarysource><qualification>1</qualification><medicalconfirm>1</medicalconfirm></primarysource>
<patient><patientonsetage>18</patientonsetage><patientonsetageunit>802</patientonsetageunit><patientsex>2</patientsex><patientweight>70</patientweight>
<reaction><primarysourcereaction>bad head</primarysourcereaction><reactionmeddrapt>Headache</reactionmeddrapt><reactionstartdate>20240302</reactionstartdate><reactionoutcome>1</reactionoutcome></reaction>
<reaction><reactionmeddrallt>Sick</reactionmeddrallt><reactionoutcome>77</reactionoutcome></reaction><reaction><reactionoutcome>1</reactionoutcome></reaction>
<drug><medicinalproduct>Alpha 5 mg</medicinalproduct><drugcharacterization>1</drugcharacterization><drugstartdate>2024</drugstartdate></drug><drug><drugcharacterization>2</drugcharacterization></drug>
<summary><narrativeincludeclinical>told</narrativeincludeclinical></summary></patient></safetyreport>
<safetyreport><note>nothing here</note></safetyreport><safetyreport><reporttype>9</reporttype><seriousnessother>1</seriousnessother><patient><drug><medicinalproduct>Beta</medicinalproduct></drug></patient></safetyreport></ichicsr>"""
NEW = """<x:MCCI xmlns:x="urn:v3"><x:InvestigationEvent><x:SafetyReportId extension="W-2"/><x:studyname value="S-9"/><x:receiptdate value="20240506"/><x:serious code="1"/>
<x:patient><x:reaction><x:reactionmeddra><x:reactionmeddrapt displayName="Nausea"/></x:reactionmeddra></x:reaction></x:patient></x:InvestigationEvent></x:MCCI>"""


def test_xml_of_two_generations(spark):
    files = spark.createDataFrame([("a", bytearray(OLD.encode())), ("b", bytearray(NEW.encode()))], "path string, content binary")
    got = {(r["path"], r["report"]): r for r in cases.xml_cases(files, ["alpha"]).collect()}
    assert set(got) == {("a", 0), ("a", 2), ("b", 0)}
    a, c, b = got["a", 0], got["a", 2], got["b", 0]
    assert (a["worldwide_case_id"], a["local_case_ids"], a["case_version"], a["report_source"], a["country"], a["qualification"], a["is_medically_confirmed"]) == ("W-1", ["L-1"], 2, "clinical_trial", "FR", "physician", True)
    assert a["initial_receipt_date"] == a["latest_receipt_date"] == date(2024, 3, 1) and a["date_precision"] == {"initial_receipt_date": "month"}
    assert a["is_serious"] is False and a["seriousness_criteria"] == [] and a["patient_age"] == 1.5 and a["patient_sex"] == "female" and a["narrative"] == "told"
    assert [(e["verbatim_term"], e["pt"], e["onset_date"], e["outcome"]) for e in a["events"]] == [("bad head", "Headache", date(2024, 3, 2), "recovered"), ("Sick", None, None, "77")]
    assert [(d["drug_name"], d["role"], d["is_company_product"], d["start_date"]) for d in a["drugs"]] == [("Alpha 5 mg", "suspect", True, date(2024, 1, 1))]
    assert a["unmapped"] == {"patient/patientweight": "70"} and a["missing"] == {}
    assert c["is_serious"] is True and c["seriousness_criteria"] == ["other_medically_important"] and c["report_source"] == "9" and set(c["missing"]) == {"worldwide_case_id", "latest_receipt_date", "country", "events"}
    assert (b["worldwide_case_id"], b["report_source"], b["study_id"], b["is_serious"], [e["pt"] for e in b["events"]]) == ("W-2", "clinical_trial", "S-9", True, ["Nausea"])
    assert cases.xml_cases(files.where("false")).count() == 0
    with pytest.raises(SourceUnreadable):
        list(cases.report_leaves(b'<!DOCTYPE a [<!ENTITY x "y">]><a/>'))


def test_reports_of_a_file_leave_in_parts():
    """A large file's reports do not wait for each other: a part has BATCH_LEAVES leaves at most, and none is lost."""
    report = "<safetyreport><safetyreportid>W-{}</safetyreportid><patient>" + "<reaction><reactionmeddrapt>x</reactionmeddrapt></reaction>" * 99 + "</patient></safetyreport>"
    data = "<ichicsr>" + "".join(map(report.format, range(1000))) + "</ichicsr>"
    parts = list(cases._leaves(iter([pd.DataFrame({"path": ["a"], "content": [data.encode()]})])))
    assert [n for p in parts for n in p["report"]] == list(range(1000)) and max(sum(map(len, p["leaves"])) for p in parts) == 20_000


def test_listing(spark):
    head = ["Case", "Local", "Got", "Serious", "Why", "Term", "Onset", "Drug", "Role", "Age", "Source"]
    rows = [
        ("C1", "L1", "2024-01-05", "", "Death; Life threatening", "head", "13/02/2024", "Alpha", "", "41", "Clinical trial"), ("C1", "L2", "2023-01-01", "no", "", "nausea", "5-Mar-24", "Alpha", "Interacting!", "9", ""),
        ("", "", "", "", "", "lost", "", "", "", "", ""), ("C2", "", "", "no", "", "", "", "Beta", "", "old", ""), ("C2", "", "", "", "", "", "03/04/2024", "", "", "", ""), (" C1 ", None, None, None, None, " third ", None, "Gamma", None, None, None),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 2)], ", ".join(f"{h} string" for h in head) + ", _row_index int")
    mapping = dict(zip(head, ["worldwide_case_id", "local_case_id", "initial_receipt_date", "is_serious", "seriousness_criteria", "verbatim_term", "onset_date", "drug_name", "drug_role", "patient_age", "report_source"], strict=True))
    found, skipped = cases.listing_cases(df, mapping, products=["ALPHA"])
    assert found.columns == list(cases.CASE)
    a, b = found.orderBy("worldwide_case_id").collect()
    assert (a["worldwide_case_id"], a["local_case_ids"], a["initial_receipt_date"], a["is_serious"], a["seriousness_criteria"], a["patient_age"], a["report_source"]) == ("C1", ["L1"], date(2024, 1, 5), True, ["death", "life_threatening"], 41.0, "clinical_trial")
    assert [(e["verbatim_term"], e["onset_date"]) for e in a["events"]] == [("head", date(2024, 2, 13)), ("nausea", date(2024, 3, 5)), ("third", None)]
    assert [(d["drug_name"], d["role"], d["is_company_product"]) for d in a["drugs"]] == [("Alpha", "suspect", True), ("Gamma", "suspect", False)]
    assert b["is_serious"] is False and b["patient_age"] is None and b["events"] == [] and set(b["missing"]) == {"latest_receipt_date", "events"}
    assert [(r["no"], r["reason"].split()[0]) for r in skipped.orderBy("no").collect()] == [(4, "no"), (6, "onset_date")]
    assert [r["no"] for r in cases.listing_cases(df, mapping, order="day_first")[1].collect()] == [4]
    assert cases.listing_cases(df, mapping)[0].dtypes == cases.xml_cases(spark.createDataFrame([], "path string, content binary")).drop("path", "report").dtypes
    with pytest.raises(ValueError, match="shoe"):
        cases.listing_cases(df, {"Case": "shoe"})

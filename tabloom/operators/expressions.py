"""Rules, formulas and manifests that come as texts of a column: what the language says about each, in Arrow batches.

A text outside the language gives the name of its fault and nulls; a null text gives nulls. Texts that repeat are read once a batch."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators import conditions, formulas, lifecycle, resolution

READING = "inputs string, tree string, unparsed string, english string, sentence string, hash string, fault string"


def _each(texts: pd.Series, read) -> list:
    known = {t: read(t) for t in texts.dropna().unique()}
    return [known.get(t) for t in texts]


def rule_reading(rule: Column, types: dict[str, str] | None = None) -> Column:
    """struct of a condition: inputs, tree (kind of its root), unparsed, english, sentence, hash, fault: of the parser, or of the types."""

    def read(text: str) -> tuple:
        try:
            tree = type(conditions.parse(text)).__name__
            faults = ",".join(f"{a}:{b}" for a, b in conditions.typecheck(text, types)) if types is not None else ""
            return ",".join(conditions.inputs(text)), tree, conditions.unparse(text), conditions.plain_english(text), conditions.approval_sentence(text), conditions.expression_hash(text), faults or None
        except conditions.ConditionError:
            return None, None, None, None, None, None, "outside the language"

    @F.pandas_udf(READING)
    def readings(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x or (None,) * 7 for x in _each(texts, read)], columns=[c.split()[0] for c in READING.split(", ")])

    return readings(rule)


def formula_inputs(formula: Column) -> Column:
    """Names that a formula needs, sorted."""

    @F.pandas_udf("string")
    def names(texts: pd.Series) -> pd.Series:
        return pd.Series(_each(texts, lambda t: ",".join(sorted(formulas.identifiers(t)))), dtype=object)

    return names(formula)


def canonical_hash_of(value: Column) -> Column:
    """canonical_hash of a JSON text's value, whatever the spelling."""

    @F.pandas_udf("string")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series(_each(texts, lambda t: lifecycle.canonical_hash(json.loads(t))), dtype=object)

    return hashes(value)


def bindable_of(manifest: Column) -> Column:
    """array<struct<name, origin>> of a manifest's JSON text."""

    @F.pandas_udf("array<struct<name: string, origin: string>>")
    def targets(texts: pd.Series) -> pd.Series:
        return pd.Series(_each(texts, lambda t: [{"name": n, "origin": o} for n, o in resolution.bindable_targets(json.loads(t))]), dtype=object)

    return targets(manifest)


def dependency_places(units: DataFrame) -> DataFrame:
    """manifest, place, unit of units (manifest, unit, kind, expression): each after those that it needs. A manifest is one document's
    list of fields and is ordered in one task; manifests run apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = resolution.order([resolution.Unit(u, k, e) for u, k, e in zip(pdf["unit"], pdf["kind"], pdf["expression"], strict=True)])
        return pd.DataFrame({"manifest": pdf["manifest"].iloc[0], "place": range(len(found)), "unit": [u.id for u in found]})

    kind = units.schema["manifest"].dataType.simpleString()
    return units.select("manifest", "unit", "kind", "expression").groupBy("manifest").applyInPandas(run, f"manifest {kind}, place int, unit string")

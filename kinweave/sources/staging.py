"""Staging files: typed tab-separated tables with a manifest, written and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.text import scrub_tsv

_KINDS = {"uuid": T.StringType(), "text": T.StringType(), "integer": T.IntegerType(), "short": T.ShortType(), "boolean": T.BooleanType(), "date": T.DateType(), "decimal": T.DecimalType(5, 4)}

#: The staged relations in load order, with their columns and types.
RELATIONS = {
    "person": {
        "ImportBatchId": "uuid", "TreePersonId": "uuid", "ExternalId": "text", "Sex": "text", "IsLiving": "boolean", "PrimaryDisplayName": "text",
        "SurnameNormalized": "text",
    },
    "person_name": {
        "ImportBatchId": "uuid", "RowNumber": "integer", "TreePersonId": "uuid", "ScriptCode": "text", "NameType": "text", "Given": "text",
        "Surname": "text", "FullName": "text", "FullNameNormalized": "text", "IsPrimary": "boolean",
    },
    "person_name_parsed": {
        "ImportBatchId": "uuid", "RowNumber": "integer", "SourceNameRowNumber": "integer", "TreePersonId": "uuid", "RawName": "text",
        "NameType": "text", "ScriptCode": "text", "GivenName": "text", "Patronymic": "text", "Surname": "text", "MaidenSurname": "text",
        "MarriedSurname": "text", "TitlePrefix": "text", "Suffix": "text", "LanguageHint": "text", "GivenNameNormalized": "text",
        "PatronymicNormalized": "text", "SurnameNormalized": "text", "FullNameNormalized": "text", "NameTokens": "text",
        "VariantExplanation": "text", "NormalizationConfidence": "decimal", "ParserStatus": "text",
    },
    "place": {
        "ImportBatchId": "uuid", "RowNumber": "integer", "PlaceRaw": "text", "PlaceNormalized": "text",
    },
    "family": {
        "ImportBatchId": "uuid", "FamilyId": "uuid", "ExternalId": "text", "Spouse1TreePersonId": "uuid", "Spouse2TreePersonId": "uuid",
        "MarriageDateRaw": "text", "MarriageYear": "short", "MarriagePlaceRaw": "text", "Notes": "text",
    },
    "family_child": {
        "ImportBatchId": "uuid", "FamilyId": "uuid", "ChildTreePersonId": "uuid",
    },
    "parent_of": {
        "ImportBatchId": "uuid", "ParentTreePersonId": "uuid", "ChildTreePersonId": "uuid", "RelationType": "text",
    },
    "spouse_of": {
        "ImportBatchId": "uuid", "RowNumber": "integer", "FromTreePersonId": "uuid", "ToTreePersonId": "uuid", "RelationType": "text",
        "FamilyId": "uuid", "MarriageYear": "short", "MarriagePlaceRaw": "text",
    },
    "event": {
        "ImportBatchId": "uuid", "RowNumber": "integer", "ExternalEventKey": "text", "TreePersonId": "uuid", "EventType": "text",
        "EventValue": "text", "DateRaw": "text", "DateFrom": "date", "DateTo": "date", "YearFrom": "short", "YearTo": "short", "PlaceRaw": "text",
        "PlaceNormalized": "text", "FamilyId": "uuid", "RelatedTreePersonId": "uuid", "IsDerived": "boolean", "Notes": "text",
    },
    "date_warning": {
        "ImportBatchId": "uuid", "EventRowNumber": "integer", "TreePersonId": "uuid", "PersonXref": "text", "PersonName": "text",
        "EventType": "text", "DateRaw": "text", "DateFrom": "date", "DateTo": "date", "DatePrecision": "text", "DateModifier": "text",
        "DateStatus": "text", "WarningKind": "text", "WarningMessage": "text",
    },
    "event_citation": {
        "ImportBatchId": "uuid", "RowNumber": "integer", "EventRowNumber": "integer", "SourceRef": "text", "SourceTitle": "text", "Page": "text",
        "Quality": "text", "CitationDateRaw": "text", "CitationText": "text", "Note": "text",
    },
}


def columns(relation: str) -> list[tuple[str, T.DataType]]:
    return [(name, _KINDS[kind]) for name, kind in RELATIONS[relation].items()]


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; line breaks become blanks, null is empty, booleans 1 and 0."""
    def cell(name: str, kind: T.DataType):
        return scrub_tsv(F.when(F.col(name), 1).when(~F.col(name), 0) if isinstance(kind, T.BooleanType) else F.col(name)).alias(name)

    out = df.select(*[cell(f.name, f.dataType) for f in df.schema])
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("encoding", "UTF-16").option("quote", "\"").option("escape", "\"").option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """One staged relation with its types; empty is null; a header other than the declared one is an error."""
    declared = columns(relation)
    raw = spark.read.option("sep", "\t").option("header", True).option("encoding", "UTF-16").option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    raw = raw.schema(T.StructType([T.StructField(n, T.StringType()) for n, _ in declared])).csv(path)
    typed = []
    for name, kind in declared:
        text = F.nullif(F.col(name), F.lit(""))
        typed.append((F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False) if isinstance(kind, T.BooleanType) else text.cast(kind)).alias(name))
    return raw.select(*typed)


#: Fixed value: the file of date warnings is not named after its relation.
_FILES = {"date_warning": "date_parse_warnings.tsv"}


def file_name(relation: str) -> str:
    return _FILES.get(relation, f"gedcom_import_{relation}.tsv")


def manifest(relations: dict[str, DataFrame], **batch: str | None) -> dict:
    """What a staged batch consists of: ``batch`` (batchId, sourceFilePath, sourceFileHash, treeId...), counts per file, and the load order."""
    counts = {file_name(n): relations[n].count() for n in RELATIONS if n in relations}
    return batch | {"counts": counts, "encoding": "utf-16", "artifacts": {"dateParseWarnings": file_name("date_warning")}, "loadOrder": list(counts)}


def read_manifest(text: str) -> dict[str, int]:
    """Counts by lower-case relation name, from file counts or from a list of relations; a missing count is 0."""
    document = json.loads(text)
    listed = {r["name"].lower(): int(r.get("rows") or 0) for r in document.get("relations", [])}
    named = {file_name(n): n for n in RELATIONS}
    return listed | {named[f]: int(rows or 0) for f, rows in document.get("counts", {}).items() if f in named}


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, source_hash) of source files, as manifests name them."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("source_hash"))


def export_batch(relations: dict[str, DataFrame], folder: str, **batch: str | None) -> dict:
    """Writes each relation as a file of the declared columns (missing ones null) below ``folder``; returns the manifest."""
    for name, df in relations.items():
        typed = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns(name)]
        write_tsv(df.select(*typed), f"{folder}/{file_name(name)}")
    return manifest(relations, **batch)


def load_batch(spark: SparkSession, folder: str, described: dict) -> dict[str, DataFrame]:
    """All relations of a batch in load order; a number of rows other than the manifest's is an error."""
    expected = read_manifest(json.dumps(described))
    out = {name: read_tsv(spark, f"{folder}/{file_name(name)}", name) for name in RELATIONS if name in expected}
    for name, df in out.items():
        rows = df.count()
        if rows != expected[name]:
            raise ValueError(f"{file_name(name)} has {rows} rows, not {expected[name]}")
    return out


def json_documents(df: DataFrame) -> DataFrame:
    """Each row as an indented-free JSON document with camel-case names, nulls kept."""
    camel = lambda n: (p := n.split("_"))[0] + "".join(x.title() for x in p[1:])
    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))

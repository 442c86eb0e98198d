"""Item metadata: one row per scanned item."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# Headers of the metadata export, in file order, with our column names.
# ---------------------------------------------------------------------------------------
ITEM_HEADERS = {
    "Title": "title",
    "Creator": "creator",
    "Contributors": "contributors",
    "Date": "date",
    "Approximate Date": "approximate_date",
    "Source": "source",
    "Subject": "subject",
    "Local Subject": "local_subject",
    "S.C. County": "county",
    "Description": "description",
    "Extent": "extent",
    "Digital Collection": "digital_collection",
    "Website": "website",
    "Contributing Institution": "contributing_institution",
    "Rights": "rights",
    "Time Period": "time_period",
    "Geographic Location": "geographic_location",
    "Language": "language",
    "Digitization Specifications": "digitization_specifications",
    "Date Digital": "date_digital",
    "Type": "type",
    "Format": "format",
    "Media Type": "media_type",
    "Identifier": "identifier",
    "Note": "note",
    "Digital Assistant": "digital_assistant",
    "Transcript": "transcript",
    "OCLC number": "oclc_number",
    "Date created": "date_created",
    "Date modified": "date_modified",
    "Reference URL": "reference_url",
    "CONTENTdm number": "item_number",
    "CONTENTdm file name": "file_name",
    "CONTENTdm file path": "file_path",
}
# ---------------------------------------------------------------------------------------

NUMBERS = {"oclc_number", "item_number"}

ITEM_SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if name in NUMBERS else T.StringType())
        for name in ITEM_HEADERS.values()
    ]
)

QA_SCHEMA = T.StructType(
    [T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]
)

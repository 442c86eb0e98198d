"""Structured values out of text cells and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import strip

OCR_SCHEMA = "source string, ocr_transcript string, notes string, fixed_transcript string"
SPELL_SCHEMA = "spell_corrected_text string, correction_dict map<string,string>"

# Markers that models put around their replies.
ASSISTANT_MARK = "<|start_header_id|>assistant<|end_header_id|>"
RESPONSE_MARK = "### RESPONSE:"

_QUOTED = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""


def _item_to_json(item: Column) -> Column:
    """A quoted list item as a JSON string; ``\\u0001`` stands in for an escaped backslash."""
    body = F.substring(item, F.lit(2), F.length(item) - 2)
    body = F.replace(body, F.lit("\\\\"), F.lit("\u0001"))
    body = F.replace(body, F.lit("\\'"), F.lit("'"))
    body = F.replace(body, F.lit('\\"'), F.lit('"'))
    body = F.replace(body, F.lit('"'), F.lit('\\"'))
    body = F.regexp_replace(body, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    body = F.replace(body, F.lit("\u0001"), F.lit("\\\\"))
    return F.concat(F.lit('"'), body, F.lit('"'))


def parse_list_literal(c: Column) -> Column:
    """Array from the printed form of a list of strings, such as ``['a', "b'c"]``."""
    items = F.regexp_extract_all(c, F.lit(_QUOTED), F.lit(0))
    json = F.concat(F.lit("["), F.array_join(F.transform(items, _item_to_json), ","), F.lit("]"))
    return F.from_json(json, "array<string>")


def format_list_literal(c: Column) -> Column:
    """The printed form of a list of strings; ``parse_list_literal`` reads it back."""

    def quoted(x: Column) -> Column:
        for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            x = F.replace(x, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit("'"), x, F.lit("'"))

    return F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]"))


def parse_ocr_json(c: Column) -> Column:
    """``struct<source, ocr_transcript, notes, fixed_transcript, error>``.

    ``error`` holds the raw text when it is not the expected JSON object.
    """
    parsed = F.from_json(
        c,
        OCR_SCHEMA + ", error string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"},
    )
    return parsed


def parse_spell_output(c: Column) -> Column:
    """``struct<spell_corrected_text, correction_dict>``; ``''`` and an empty map on failure."""
    parsed = F.from_json(c, SPELL_SCHEMA)
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        F.coalesce(parsed["spell_corrected_text"], F.lit("")).alias("spell_corrected_text"),
        F.coalesce(parsed["correction_dict"], empty).alias("correction_dict"),
    )


def clean_reply(c: Column, mode: str, prompt: Column | None = None) -> Column:
    """Take the answer out of a raw model reply.

    ``prefix``    drop as many leading characters as the prompt has, then strip
    ``assistant`` text after the last assistant marker, stripped
    ``quotes``    strip blanks, wrapping double quotes, blanks
    ``response``  text after the first response marker (whole text if absent), stripped
    """
    if mode == "prefix":
        if prompt is None:
            raise ValueError("mode 'prefix' needs the prompt column")
        return strip(F.substring(c, F.length(prompt) + 1, F.length(c)))
    if mode == "assistant":
        return strip(F.substring_index(c, ASSISTANT_MARK, -1))
    if mode == "quotes":
        return strip(F.regexp_replace(strip(c), r'^"++|(?<!")"++\z', ""))
    if mode == "response":
        at = F.locate(RESPONSE_MARK, c)
        return strip(
            F.when(at > 0, F.substring(c, at + len(RESPONSE_MARK), F.length(c))).otherwise(c)
        )
    raise ValueError(f"unknown reply mode: {mode}")

"""Prompts for a text generator, built as plain string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.tasks import fill

# ---------------------------------------------------------------------------------------
# Prompt wording.
# ---------------------------------------------------------------------------------------
DEFAULT_SYSTEM = "You are a helpful assistant. Answer clearly and concisely."
TEMPLATES = {
    "qa": "{system}\n\nQuestion: {text}\nAnswer:",
    "examples": """Here are some Q/A examples. Follow the same format:

Question: What is the capital of Spain?
Answer: Madrid

Question: What year was the Declaration of Independence signed?
Answer: 1776

Question: {text}
Answer:""",
    "chat": (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n{text}<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n"
    ),
    "restore": '''<|system|>
You are a meticulous text restorer. Your job is to correct OCR artifacts in legal or historical documents.

RULES:
1. Do NOT rewrite or modernize wording — preserve original grammar, style, and vocabulary, even if unusual.
2. Only fix:
   - Obvious misspellings caused by OCR (e.g., "oi" → "of", "xkxi" → remove or replace with intended text if 100% clear from context).
   - Broken words due to incorrect character recognition.
   - Spacing issues.
3. If a word is unclear or ambiguous, do NOT guess. Keep it as-is but flag it in [square brackets].
4. Preserve punctuation, capitalization, and formatting exactly as in the original unless it is clearly an OCR error.
5. Never add or remove whole sentences or change meaning.
6. Output only the corrected text — no explanations.
<|user|>
TEXT TO CORRECT:
"""
{text}
"""
<|assistant|>
''',
    "proofread": '''
You are a meticulous text proofreader. 
Correct ONLY spelling, punctuation, and grammatical errors. 
Do NOT change wording, sentence structure, or style unless absolutely necessary. 
Preserve all original text, tone, and sentence order.
Even if a sentence is incomplete, it is importance that we keep the original document intact.
Output only the text without any additional statement

Text:
"""{text}"""

Corrected Text:
''',
}
# ---------------------------------------------------------------------------------------


def prompt(text: Column, template: str, system: str = DEFAULT_SYSTEM) -> Column:
    if template not in TEMPLATES:
        raise ValueError(f"unknown template: {template}; one of {sorted(TEMPLATES)}")
    return fill(TEMPLATES[template], text=text, system=F.lit(system))


def messages(text: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """Chat messages: ``array<struct<role, content>>`` with a system and a user turn."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), text.alias("content")),
    )


def build_prompts(
    df: DataFrame, col: str, template: str, system: str = DEFAULT_SYSTEM, out: str = "prompt"
) -> DataFrame:
    """``template`` is a name in ``TEMPLATES`` or ``messages``."""
    text = F.col(col)
    made = messages(text, system) if template == "messages" else prompt(text, template, system)
    return df.withColumn(out, made)

"""Regular expressions for scanned-text artifacts, written for Java's regex engine.

Spark evaluates patterns with ``java.util.regex``.  Its shorthand classes are ASCII-only
unless a flag widens them, and even then they differ from the Unicode notion of "word"
and "blank" used by the data (``½`` and ``²`` are word characters here).  So every class
is spelled out, and ``(?d)`` keeps ``$`` and ``.`` tied to ``\\n`` alone.

Two habits keep them fast.  Inside a class, single Latin-1 characters become one table
lookup while every range adds a nested test, so ASCII members are listed one by one and
the rest sits behind one range.  And loops that can never give characters back are
possessive, so a failed attempt costs one pass.
"""

from __future__ import annotations

import string

# One blank character: every code point that Unicode text handling treats as white space.
BLANKS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WS = f"[{BLANKS}]"
NON_WS = f"[^{BLANKS}]"

# One word character: letters, numbers of any kind, underscore.  The range ends in a real
# character beyond the basic plane: only then does look-behind step over whole characters.
ALNUM = string.ascii_letters + string.digits
WORD_CHARS = ALNUM + "_[\\x{80}-\U0010ffff&&[\\p{L}\\p{N}]]"
W = f"[{WORD_CHARS}]"

# ---------------------------------------------------------------------------------------
# The characters, exceptions and limits below define what counts as an
# artifact and must stay as they are for results to agree.
# ---------------------------------------------------------------------------------------
STANDARD_CHARS = ALNUM + r""".,!?;:'"()\-_/"""
SYMBOL_CHARS = r"@#$%^&*+=<>\|`~\[\]{}"
GENERAL_EXCEPTIONS = [
    r"^[a-zA-Z]{1,2}&[a-zA-Z]{1,2}$",
    r"^[a-zA-Z]+=+[a-zA-Z]+$",
    r"^[0-9]+\*[0-9]+$",
]
SUBSTITUTIONS = [(r"_{2,}", " "), ("—", "-"), (r"\*{2,}", " ")]
SUSPICIOUS = r"[\^&<>]"
MIXED_CASE = r"[a-z][A-Z]|[A-Z]{3,}[a-z]"
FLAGGED_WORDS = r"(?d)\[.*?\]"
# ---------------------------------------------------------------------------------------

# A run of blanks, or a token of fifteen characters or more.
ODD_SPACING = f"{WS}{{2,}}+|(?<!{NON_WS}){NON_WS}{{15,}}+"

# Two or more characters in a row that are neither letters, digits, blanks nor ordinary
# punctuation.
SPECIAL = f"[^{STANDARD_CHARS}{BLANKS}]{{2,}}+"

# A word holding the same ASCII letter three times in a row; group 1 is that letter.
REPEAT = rf"(?<!{W}){W}*([a-zA-Z])\1{{2,}}{W}*+"
REPEAT_HINT = r"([a-zA-Z])\1\1"
REPEAT_RUN = r"([a-zA-Z])\1{2,}"

# A token's span from its first to its last word character, when a symbol lies between.
# A closing token that looks like "A&B", "a=b" or "3*4" keeps its first word: only the
# rest, from the symbol on, is a match.
SYMBOL = f"[{SYMBOL_CHARS}]"
TO_SYMBOL = f"{W}[^{SYMBOL_CHARS}{BLANKS}]*+{SYMBOL}"
CLOSING = rf"(?:{W}{{1,2}}&{W}{{1,2}}|{W}++={W}++|\p{{Nd}}++\*\p{{Nd}}++)$"
CLOSING_REST = rf"(?:&(?<={W}&){W}{{1,2}}|=(?<={W}=){W}++|\*(?<={W}\*)\p{{Nd}}++)$"
GENERAL = (
    f"(?d)(?<!{W})(?={TO_SYMBOL})(?!{CLOSING}){TO_SYMBOL}{NON_WS}*{W}|{CLOSING_REST}"
)

# "^" with up to four word characters, or a punctuation mark touching no word character.
# The mark is tested before its neighbours, so letters fail at once.
MARK = f"[^{WORD_CHARS}{BLANKS}]"
CARET = rf"(?={MARK})(?:\^{W}{{0,4}}+|(?<!{W}){MARK}(?!{W}))"

# Written so that a long run of blanks inside a text is scanned once.
EDGE_BLANKS = f"^{WS}++|(?<!{WS}){WS}++\\z"
BLANK_RUN = f"{WS}++"
TOKEN = f"{NON_WS}++"
WORD_RUN = f"{W}++"
ALPHA_WORD = f"(?<!{W})[{string.ascii_letters}]++(?!{W})"

# A sentence keeps the blanks that follow its end mark.
SENTENCE = rf"[^.!?]*+(?:[.!?]++(?!{WS})[^.!?]*+)*+[.!?]++{WS}++|[\s\S]++"
OPEN_SENTENCE_END = rf"[.!?]{WS}+\z"

# A word for spelling repair; apostrophes belong to it.
SPELL_WORD = f"[{WORD_CHARS}']++"
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+\z"

"""Scalar functions on messages, paths and rule ids. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


#: What patterns know as white space.
BLANKS = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def normalize_message(message: Column) -> Column:
    """A message without what varies from run to run: numbers of lines, addresses, paths, spacing. Patterns
    begin with a letter and look back for the word's bound, as a bound takes longer to try everywhere."""
    text = F.replace(F.replace(F.lower(strip(message)), F.lit('"'), F.lit("'")), F.lit("\\"), F.lit("/"))
    text = _chain(
        text,
        (r"line(?<=\bline)\s+\d+\b", "line <n>"),
        (r"0x(?<=\b0x)[0-9a-fA-F]+\b", "0x<hex>"),
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "<uuid>"),
        (r"/(?<=\b/)[\w./-]+\b", "<path>"),  # backslashes are gone by now
        (r"([!?.,:;])\1+", "$1"),
        (r" \s+|[\t\n\x0b\f\r]\s*", " "),
    )
    return strip(text)


def snippet_hash(raw_payload: Column) -> Column:
    """sha256 of the payload's trimmed snippet; null if it has none."""
    snippet = strip(F.get_json_object(raw_payload, "$.snippet"))
    return F.when(snippet != "", F.sha2(snippet, 256))


def identity(symbol: Column, normal_message: Column, raw_payload: Column) -> Column:
    """What tells findings of a rule in a file apart, whatever their line: the symbol if there is one,
    else the normal message and the hash of the snippet."""
    named = strip(F.coalesce(symbol, F.lit("")))
    return F.when(named != "", named).otherwise(F.concat_ws("|", normal_message, snippet_hash(raw_payload)))


def fingerprint(tool: Column, rule_id: Column, file: Column, identity: Column) -> Column:
    return F.sha2(F.concat_ws("|", tool, rule_id, file, identity), 256)


def ownership(file: Column) -> Column:
    """struct(ownership, ownership_confidence) of a path."""
    path = F.lower(file)
    third = path.rlike("/vendor/|/node_modules/|/third_party/|/[.]venv/")
    made = path.rlike("/dist/|/build/|/generated/|_generated")
    return F.struct(
        F.when(third, "third_party").when(made, "generated").otherwise("first_party").alias("ownership"),
        F.when(third, 0.98).when(made, 0.9).otherwise(0.95).alias("ownership_confidence"),
    )


def rule_family(rule_id: Column) -> Column:
    """The leading letters of a rule id's first part, else that part's first twelve characters."""
    cleaned = F.lower(strip(F.coalesce(rule_id, F.lit("unknown"))))
    token = F.element_at(F.split(cleaned, r"[.:/_\-]"), 1)
    letters = F.regexp_extract(token, "^[a-z]+", 0)
    return F.when(cleaned == "", "unknown").when(letters != "", letters).otherwise(F.substring(token, 1, 12))


def message_family(message: Column) -> Column:
    """A message's first two words, numbers and quoted parts masked."""
    text = _chain(F.lower(strip(F.coalesce(message, F.lit("")))), (r"\d+", "#"), (r"['\"`].*?['\"`]", "<x>"), (r"\s+", " "))
    return F.when(text == "", "generic").otherwise(F.substring_index(text, " ", 2))


def file_pattern(file: Column) -> Column:
    """The first part of a path."""
    first = F.substring_index(file, "/", 1)
    return F.when(F.coalesce(file, F.lit("")) == "", "project").when(first == "", "/").otherwise(first)


def high_entropy(value: Column) -> Column:
    """Whether a text of 24 characters or more consists mostly of different ones."""
    characters = F.split(value, "")
    return (F.length(value) >= 24) & (F.size(F.array_distinct(F.filter(characters, lambda c: c != ""))) / F.length(value) > 0.65)


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))


def glob_to_regex(glob: str) -> str:
    """A file name pattern in which * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not (c.isalnum() or c in "_/ ") else c
        i += 1
    return f"(?s)^(?:{out})$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs)) if globs else F.lit(False)


def lenient_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.cast("string").try_cast("double").try_cast("int"), F.lit(default))

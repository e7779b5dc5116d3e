"""Repair of almost-JSON, as chains of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, or_empty, strip

CONDITION = "array<struct<type: string, value: string>>"
REACTION_SUMMARY = (
    "struct<reaction_type: string, reactants: array<struct<name: string, role: string>>, "
    "products: array<struct<name: string, yield_optimal: double, unit: string>>, "
    f"conditions: {CONDITION}, reactor: struct<type: string, inner_diameter: string>, "
    "metrics: struct<conversion: double, yield: double, selectivity: double, unit: string>>"
)

# The rewriting rules, in order, as (pattern, replacement).
MARKDOWN_RULES = (
    (r"```json\s*", ""),
    (r"```\s*", ""),
    (r"###\s+Step\s+\d+:[^\n]*", ""),
    (r"###[^\n]*", ""),
)
SANITIZER_RULES = (
    (r"//[^\n]*", ""),
    (r"/\*[\s\S]*?\*/", ""),
    (r"([\{,]\s*)([A-Za-z_][A-Za-z0-9_\-]*)\s*:\s*", '$1"$2": '),
    (r",\s*(\}|\])", "$1"),
    (r':\s*"\.\.\."\s*([,\}])', ": null$1"),
    (r":\s*\.\.\.(\s*[,\}])", ": null$1"),
    (r':\s*"(\d+\.?\d*)"\s*([,\}])', ": $1$2"),
)


def rewritten(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in rules:
        x = F.regexp_replace(x, pattern, by)
    return x


def outer_braces(x: Column) -> Column:
    """From the first ``{`` to the last ``}``, or the text itself if they are not in this order."""
    found = F.regexp_extract(x, r"\{[\s\S]*\}", 0)
    return F.when(found != "", found).otherwise(x)


def strip_markdown(x: Column) -> Column:
    return strip(rewritten(or_empty(x), MARKDOWN_RULES))


def sanitize(x: Column) -> Column:
    return strip(rewritten(outer_braces(or_empty(x)), SANITIZER_RULES))


def longest_block(x: Column) -> Column:
    """The first longest ``{...}`` whose braces balance, counted from depth 0; a stray ``}`` lowers
    the depth. Without any, the outermost braces.

    Only the braces take part in the fold (their places and signs), so its length is the number of
    braces and not of characters.
    """
    # each piece ends with a brace
    pieces = F.regexp_extract_all(or_empty(x), F.lit(r"[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("begin"), F.lit(-1).alias("from"), F.lit(0).alias("size"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece)
        opens = F.endswith(piece, F.lit("{"))
        depth = acc["depth"] + F.when(opens, 1).otherwise(-1)
        begin = F.when(opens & (acc["depth"] == 0), end - 1).otherwise(acc["begin"])
        closes = ~opens & (depth == 0) & (acc["begin"] >= 0)
        longer = closes & (end - acc["begin"] > acc["size"])
        return F.struct(
            end.alias("at"), depth.alias("depth"), F.when(closes, -1).otherwise(begin).alias("begin"),
            F.when(longer, acc["begin"]).otherwise(acc["from"]).alias("from"), F.when(longer, end - acc["begin"]).otherwise(acc["size"]).alias("size"),
        )

    def cut(best: Column) -> Column:
        return F.when(best["size"] > 0, F.substring(or_empty(x), best["from"] + 1, best["size"])).otherwise(outer_braces(or_empty(x)))

    return bound(F.aggregate(pieces, start, step), cut)


def valid(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()


def repaired(x: Column) -> Column:
    """The sanitized text if it parses, else the text as it was given."""
    return bound(x, lambda text: bound(sanitize(text), lambda clean: F.when(valid(clean), clean).otherwise(text)))


def parsed_summary(x: Column) -> Column:
    """The reaction summary as a typed struct, null where the text is not JSON."""
    return F.when(valid(x), F.from_json(x, f"reaction_summary {REACTION_SUMMARY}")["reaction_summary"])

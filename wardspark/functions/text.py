"""Text expressions (G9-G16, H5): drug-string parsing, digit splitting, number spelling
and digit-place ids. All are built-in array/regex expressions evaluated inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): Python str.split() whitespace set; digit tokens
# '0'..'9' are ids 121..130 and the decimal point is id 119; integer places count down to
# 7 at the units digit (start 6); the infusion units that are blanked.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CHARS}]+"
DIGIT_TOKENS = list(range(121, 131))
DOT_TOKEN = 119
NUMBER_TOKENS = DIGIT_TOKENS + [DOT_TOKEN]
INTEGER_START = 6
UNIT_REMOVE = ["()", "", "(Unknown)", "(Scale B)", "(Scale A)", "(Human)", "(ARTERIAL LINE)"]

PD_NUMBER = (r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
             r"|^[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$")


def words(text: Column) -> Column:
    """``str.split()``: split on any whitespace run, no empty pieces."""
    return F.filter(F.split(text, WS), lambda w: w != "")


# ----------------------------------------------------------------------------- drugs
def dosage_parts(dosage: Column) -> tuple[Column, Column]:
    """(value, unit) from a free-text dosage.

    Commas removed; when every token is numeric and there are two or more, the first is
    dropped; unit = text without digits, '.', '-' ('' -> ' '); value = last number after
    the first hyphen, spelled as a float ('' -> ' ').
    """
    s = F.regexp_replace(F.coalesce(dosage, F.lit("nan")), ",", "")
    toks = words(s)
    all_num = (F.size(toks) >= 2) & F.forall(toks, lambda t: t.rlike(PD_NUMBER))
    toks = F.when(all_num, F.slice(toks, 2, F.size(toks) - 1)).otherwise(toks)
    joined = F.array_join(toks, " ")
    unit = F.trim(F.regexp_replace(joined, r"[0-9.\-]", ""))
    unit = F.when(unit == "", F.lit(" ")).otherwise(unit)
    pos = F.instr(joined, "-")
    src = F.when(pos > 0, F.substring(joined, pos + 1, 1 << 30)).otherwise(joined)
    nums = F.regexp_extract_all(src, F.lit(r"(-?\d+\.?\d*)"), 1)
    last = F.try_element_at(nums, F.lit(-1))
    value = F.coalesce(last.cast("double").cast("string"), F.lit(" "))
    return value, unit


def infusion_parts(drugname: Column) -> tuple[Column, Column]:
    """(name, unit): split at the last '(', unit = '(...)' up to the first ')', blank-listed
    units -> ' '; a name ending in a digit gets ' [UNK]' (the space before '(' stays)."""
    s = F.coalesce(drugname, F.lit("nan"))
    has = F.instr(s, "(") > 0
    after = F.substring_index(s, "(", -1)
    name = F.when(has, F.substring(s, F.lit(1), F.length(s) - F.length(after) - 1)).otherwise(s)
    rest = F.when(has, F.concat(F.lit("("), after)).otherwise(F.lit(" "))
    close = F.instr(rest, ")")
    unit = F.when(has & (close > 0), F.substring(rest, F.lit(1), close)).otherwise(F.lit(""))
    unit = F.when(unit.isin(*UNIT_REMOVE), F.lit(" ")).otherwise(unit)
    name = F.when(name.rlike("[0-9]$"), F.concat(name, F.lit(" [UNK]"))).otherwise(name)
    return name, unit


# ----------------------------------------------------------------------------- digits
def _collapse_dots(d: Column) -> Column:
    """Keep the first '.', delete every later one."""
    p = F.instr(d, ".")
    return F.when(p > 0, F.concat(F.substring(d, F.lit(1), p),
                                  F.replace(F.substring(d, p + 1, 1 << 30), F.lit("."), F.lit(""))))\
        .otherwise(d)


def _chars(d: Column) -> Column:
    return F.filter(F.split(d, ""), lambda c: c != "")


def _word_pieces(w: Column) -> Column:
    has_digit = w.rlike("[0-9]")
    all_num = w.rlike(r"^[0-9.]*$")
    rest = F.regexp_extract(w, r"^.*[0-9.](.*)$", 1)
    first = F.substring(w, F.lit(1), F.length(w) - F.length(rest))
    mixed = F.concat(_chars(_collapse_dots(first)),
                     F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest)))
    # most words have neither digit nor point: one test decides them
    return (F.when(~w.rlike("[0-9.]"), F.array(w))
             .when(has_digit & ~all_num, mixed)
             .when(all_num, _chars(_collapse_dots(w)))
             .otherwise(F.array(w)))


def digit_split_text(text: Column) -> Column:
    """Digits inside text become single characters: '12.5mg' -> '1 2 . 5 mg'; a number
    keeps only its first decimal point; words without digits are kept whole."""
    return F.array_join(F.flatten(F.transform(words(text), _word_pieces)), " ")


def float_text(x: Column, places: int = 4) -> Column:
    """``str(round(x, places))`` for ordinary magnitudes: fixed digits, trailing zeros
    trimmed, at least one decimal ('3.0'). Avoids Spark's '1.0E-5' spelling."""
    s = F.format_string(f"%.{places}f", x)
    s = F.regexp_replace(s, "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def spell_chars(s: Column) -> Column:
    return F.array_join(_chars(s), " ")


def round_digits_double(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(" ")).otherwise(spell_chars(float_text(x)))


def round_digits_long(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(" ")).otherwise(spell_chars(x.cast("string")))


def round_digits_text(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(" ")).otherwise(digit_split_text(x))


def cap_decimals(chars: Column, keep: int = 4) -> Column:
    """Character list cut ``keep`` places after the first '.' (if it is longer)."""
    p = F.array_position(chars, ".")
    return F.when((p > 0) & (F.size(chars) - p + 1 > keep + 1), F.slice(chars, 1, (p + keep).cast("int"))) \
        .otherwise(chars)


def is_numeric_word(w: Column) -> Column:
    """All characters in '0123456789.' or any digit."""
    return w.rlike(r"^[0-9.]*$") | w.rlike("[0-9]")


# ----------------------------------------------------------------------------- digit places
def _isnum(x: str) -> str:
    return f"array_contains(array({','.join(str(t) for t in NUMBER_TOKENS)}), {x})"


def digit_runs_expr(t: str) -> str:
    """SQL for array<struct<s2,e,d>>: every maximal run of digit/point tokens in ``t``
    (1-based start after the leading-point rule, end, first decimal point or NULL)."""
    ends = (f"CAST(CASE WHEN array_position(transform(slice({t}, s, size({t}) - s + 1), x -> {_isnum('x')}), false) = 0 "
            f"THEN size({t}) ELSE s + array_position(transform(slice({t}, s, size({t}) - s + 1), "
            f"x -> {_isnum('x')}), false) - 2 END AS INT)")
    starts = (f"filter(sequence(1, size({t})), j -> {_isnum(f'{t}[j - 1]')} AND "
              f"CASE WHEN j = 1 THEN true ELSE NOT {_isnum(f'{t}[j - 2]')} END)")
    dots = f"filter(sequence(r.s, r.e), j -> {t}[j - 1] = {DOT_TOKEN})"
    lead = f"(size({dots}) = 2 AND {t}[r.s - 1] = {DOT_TOKEN})"
    return (f"transform(transform({starts}, s -> named_struct('s', s, 'e', {ends})), "
            f"r -> named_struct('s2', CASE WHEN {lead} THEN r.s + 1 ELSE r.s END, 'e', r.e, "
            f"'d', CASE WHEN {lead} THEN try_element_at({dots}, 2) ELSE try_element_at({dots}, 1) END))")


def with_digit_places(df, tokens: str, out: str):
    """Adds ``out``: digit-place ids for the token-id array column ``tokens``.

    1 for text tokens; inside a run of digit/point tokens the integer part counts down to
    7 at the units place and the point plus fraction count up from 2; a run with two points
    that starts with one drops that leading point (it keeps 1). Runs are computed once per
    row, then each position looks its run up: pure array SQL, no Python.
    """
    t = f"`{tokens}`"
    df = df.withColumn("_runs", F.expr(digit_runs_expr(t)))
    body = (f"transform(sequence(1, size({t})), j -> CASE "
            f"WHEN size(filter(_runs, r -> r.s2 <= j AND j <= r.e)) = 0 THEN 1 "
            f"ELSE aggregate(filter(_runs, r -> r.s2 <= j AND j <= r.e), 0, (acc, r) -> "
            f"CASE WHEN r.d IS NULL THEN 7 + r.e - j WHEN j < r.d THEN {INTEGER_START} + r.d - j "
            f"ELSE j - r.d + 2 END) END)")
    return df.withColumn(out, F.when(F.col(tokens).isNull(), F.lit(None)).otherwise(F.expr(body))).drop("_runs")

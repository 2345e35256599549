"""Scalar kernels as Column expressions: all stay in whole-stage codegen, none runs Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Python's idea of white space as a Java character class (Java's own is ASCII only).
SPACE = "[\t-\r\x1c-\x20\x85\xa0{}{}-{}{}{}{}{}{}]".format(*map(chr, (0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_NOT_SPACE = SPACE.replace("[", "[^", 1)
MISSING_TOKENS = frozenset(("n/a na nan nil none null ? -").split()) | {"", " "}
FILLER = frozenset("asdf bar baz example foo n/a na nil none null placeholder qwerty sample tbd test todo xxx".split()) | {"lorem" + " ipsum"}
MOJIBAKE = "[\xc0-\xc3][\x80-\xff]|\xc3" + _NOT_SPACE + "|\xe2\x80[\x93\x94\x98\x99\x9c\x9d\xa0\xa2\xa6]"
CONTROL = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
REPLACEMENT = chr(0xFFFD)
DATE_LIKE = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_fractional(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_numeric(t: T.DataType) -> bool:
    """Numbers for statistics: booleans are none."""
    return is_fractional(t) or is_integral(t) or isinstance(t, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number: both are missing."""
    c = col(name)
    return c.isNull() | F.isnan(c) if is_fractional(kind_of(df, name)) else c.isNull()


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN as null and one zero."""
    c = col(name)
    return F.when(~F.isnan(c), c + F.lit(0.0).cast(kind_of(df, name))) if is_fractional(kind_of(df, name)) else c


def finite(df: DataFrame, name: str) -> Column:
    """A numeric column as double, without NaN and infinities."""
    c = col(name)
    if is_fractional(kind_of(df, name)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c.cast("double") + 0.0)
    return c.cast("double")


def canonical(df: DataFrame) -> DataFrame:
    """NaN as null in every floating-point column."""
    return df.select(*[value(df, n).alias(n) if is_fractional(kind_of(df, n)) else col(n) for n in df.columns])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    token = f"[!-~{_NOT_SPACE}]"  # printable ASCII is asked for first
    regular = c.rlike(f"\\A(?:{token}++(?: {token}++)*+)?+\\z")
    return F.when(regular, c).otherwise(F.regexp_replace(F.regexp_replace(c, SPACE + "+", " "), "^ | \\z", ""))


def token_count(c: Column) -> Column:
    """Every token with the white space before it becomes its first character, in one pass; printable ASCII is asked for first."""
    token = f"[!-~{_NOT_SPACE}]"
    return F.length(F.regexp_replace(c, f"{SPACE}*+({token}?){token}*+", "$1"))


def irregular_space(c: Column) -> Column:
    """White space at either end (before a final line feed too), or two in a row."""
    return c.rlike(f"\\A{SPACE}|{SPACE}(?=\\n?\\z)|{SPACE}{{2,}}")


def is_filler(c: Column) -> Column:
    return F.lower(strip(c)).isin(*sorted(FILLER)) | c.rlike(f"(?i)lorem{SPACE}+ipsum")


def has_mojibake(c: Column) -> Column:
    return c.rlike(MOJIBAKE)


def has_replacement(c: Column) -> Column:
    return F.contains(c, F.lit(REPLACEMENT))


def has_control(c: Column) -> Column:
    return c.rlike(CONTROL)


def has_garbage(c: Column) -> Column:
    return has_mojibake(c) | has_replacement(c) | has_control(c)


def is_missing_token(c: Column, extra: Iterable[str] = ()) -> Column:
    tokens = MISSING_TOKENS | {t.strip().casefold() for t in extra} | {t.strip().lower() for t in extra}
    # Only short texts can be tokens: lower case never has fewer characters.
    short = c.rlike(f"(?s)\\A{SPACE}*+.{{0,{max(map(len, tokens))}}}{SPACE}*+\\z")
    return short & F.lower(strip(c)).isin(*sorted(tokens))


def repair(c: Column) -> Column:
    """Without control and replacement characters; null where nothing is left."""
    return F.nullif(F.replace(F.regexp_replace(c, CONTROL, ""), F.lit(REPLACEMENT), F.lit("")), F.lit(""))


_BLANK = "[ \t\n\r\x0b\x0c]"


def to_number(c: Column) -> Column:
    """Text as double by the strict decimal grammar (no suffixes, separators or hexadecimal); else null."""
    t = F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+\\z", "")
    plain = t.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z") | F.lower(t).rlike("^[+-]?inf(inity)?\\z")
    return F.when(plain, t.try_cast("double"))


def match_key(df: DataFrame, names: list[str]) -> Column:
    """Normalised identity of a row: text in lower case with white space collapsed, missing as the empty text."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)  # nothing to collapse in their text

    def one(n: str) -> Column:
        text = F.lower(value(df, n).cast("string"))
        return F.coalesce(text if isinstance(kind_of(df, n), plain) else collapse(text), F.lit(""))

    return F.concat_ws("\x1f", *map(one, names))


def whole_pattern(pattern: str) -> str:
    """A pattern that must match from end to end."""
    return f"^(?:{pattern})\\z"


def dtype_name(t: T.DataType, nulls: bool = False) -> str:
    """The familiar column type name of a Spark type; text with nulls is an object column."""
    simple = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]"}
    if isinstance(t, T.StringType):
        return "object" if nulls else "string"
    if isinstance(t, T.DecimalType):
        return "float64"
    return simple.get(t.simpleString(), t.simpleString())


def semantic_type(t: T.DataType, nulls: bool = False) -> str:
    if is_integral(t):
        return "integer"
    if is_fractional(t) or isinstance(t, T.DecimalType):
        return "float"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(t, T.StringType):
        return "object" if nulls else "string"
    return "unknown"


def shapely(c: Column) -> Column:
    """Without magnitudes below 1e-35, whose cubed variance would vanish and be divided by."""
    return F.when(F.abs(c) < 1e-35, F.lit(0.0)).otherwise(c)


def skewness_of(c: Column) -> Column:
    """Bias-corrected, of a shapely column; 0 without variance, null for fewer than 3."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.coalesce(F.when(F.var_pop(c) > 0, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))), F.lit(0.0)))


def kurtosis_of(c: Column) -> Column:
    """Bias-corrected excess, of a shapely column; 0 without variance, null for fewer than 4."""
    n = F.count(c).cast("double")
    g = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n >= 4, F.coalesce(F.when(F.var_pop(c) > 0, g), F.lit(0.0)))


def corrected_skewness(c: Column) -> Column:
    return skewness_of(shapely(c))


def corrected_kurtosis(c: Column) -> Column:
    return kurtosis_of(shapely(c))

"""String functions with SQLite-flavoured semantics, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(x, UPPER, LOWER)


def ascii_upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def concat_all(*xs: Column) -> Column:
    """concat(): nulls count as empty."""
    return F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in xs))


def substr(x: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start of 0 lies before the first character, a negative one counts from the end, a negative length goes left."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.char_length(x)
    begin = F.when(start > 0, start - 1).when(start < 0, n + start).otherwise(-1)
    if length is None:
        low, high = begin, n
    else:
        length = F.lit(length) if isinstance(length, int) else length
        low = F.when(length < 0, begin + length).otherwise(begin)
        high = low + F.abs(length)
    low, high = F.greatest(low, F.lit(0)), F.least(high, n)
    return F.when(x.isNull() | start.isNull(), None).otherwise(F.substring(x, low + 1, F.greatest(high - low, F.lit(0))))


def trim(x: Column, chars: str = " ") -> Column:
    return F.btrim(x, F.lit(chars))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def instr(text: Column, part: Column) -> Column:
    """1-based place of part, 0 where there is none, 1 for an empty part."""
    return F.when(part == "", F.when(text.isNotNull(), 1)).otherwise(F.call_function("locate", part, text))


def replace(x: Column, old: Column, new: Column) -> Column:
    """An empty `old` leaves x as it is."""
    return F.when(old == "", F.when(new.isNotNull(), x)).otherwise(F.replace(x, old, new))


def hex_text(x: Column) -> Column:
    """Upper-case hexadecimal of the UTF-8 bytes; null gives the empty text."""
    return F.coalesce(F.hex(F.encode(x, "utf-8")), F.lit(""))


def unhex_text(x: Column, ignore: str = "") -> Column:
    """Bytes of hexadecimal text without the ignored characters; null where it isn't hexadecimal."""
    kept = F.translate(x, ignore, "") if ignore else x
    return F.when(kept.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(kept))


def quote(x: Column, kind: str = "string") -> Column:
    """An SQL literal of x."""
    if kind == "string":
        body = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "binary":
        body = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    else:
        body = x.cast("string")
    return F.coalesce(body, F.lit("NULL"))


def char(*codes: Column) -> Column:
    """Text of code points."""
    return F.concat(*(F.decode(F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0")), "UTF-32") for c in codes))


def unicode(x: Column) -> Column:
    """Code point of the first character; null for empty text."""
    return F.when(x != "", F.ascii(x))


def printf(pattern: str, *xs: Column) -> Column:
    """format() for %d %i %s %f %e %x %X %o %c and %%, with flags, width and precision; nulls print as 0 or empty."""
    kinds = re.findall(r"%[-+ 0#,]*\d*(?:\.\d+)?([a-zA-Z%])", pattern)
    casts = {"d": "bigint", "i": "bigint", "x": "bigint", "X": "bigint", "o": "bigint", "f": "double", "e": "double", "s": "string", "c": "string"}
    given, args = iter(xs), []
    for k in kinds:
        if k != "%":
            kind = casts[k]
            args.append(F.coalesce(next(given).try_cast(kind), F.lit("" if kind == "string" else 0).cast(kind)))
    return F.format_string(re.sub(r"(%[-+ 0#,]*\d*)i", r"\1d", pattern), *args)


def zeroblob(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE, not minding the case of A-Z; only an explicit escape escapes."""
    return x.rlike(like_regex(pattern, escape))


def like_regex(pattern: str, escape: str | None = None, fold: bool = True) -> str:
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if escape and c == escape and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        at += 1
    return f"(?s{'i' if fold else ''})^{''.join(out)}\\z"


def glob_regex(pattern: str) -> str:
    """GLOB as a Java regular expression: * ? [...] [^...] [!...], minding case."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = pattern[at + 1 : end]
            bare = inner[1:] if inner[0] in "^!" else inner
            out.append(f"[{'^' if inner[0] in '^!' else ''}{re.sub(r'([\\\[&^])', r'\\\1', bare)}]")
            at = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        at += 1
    return f"(?s)^{''.join(out)}\\z"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_regex(pattern))


def similar_regex(pattern: str, escape: str | None = None) -> str:
    """SIMILAR TO as a Java regular expression: anchored, % and _, with | * + ? {m,n} ( ) [ ]; `escape` makes the next one plain."""
    out, inside, plain = [], False, False
    for c in pattern:
        if plain or c != escape:
            if plain:
                out.append(re.escape(c))
            else:
                inside = (inside or c == "[") and c != "]"
                out.append(c if inside else {"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c))
            plain = False
        else:
            plain = True
    return f"(?s)^(?:{''.join(out)})\\z"


def similar_to(x: Column, pattern: str, escape: str | None = None) -> Column:
    return x.rlike(similar_regex(pattern, escape))


def match(text: str, *xs: Column) -> Column:
    """Whether any of the columns holds the text, not minding case."""
    return F.contains(F.lower(F.concat_ws(" ", *(x.cast("string") for x in xs))), F.lit(text.lower()))


def highlight(x: Column, term: str, before: str, after: str) -> Column:
    """x with every occurrence of the term, in any case, between two marks."""
    return F.regexp_replace(x, f"(?i)({re.escape(term)})", f"{re.escape(before)}$1{re.escape(after)}".replace("\\<", "<").replace("\\>", ">"))


def typeof(x: Column, kind: str) -> Column:
    """null, integer, real, text or blob, from the static type's name."""
    names = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "string": "text", "binary": "blob"}
    return F.when(x.isNull(), "null").otherwise(names.get(kind, "real" if kind.startswith("decimal") else "text"))


def scalar_min(*xs: Column) -> Column:
    """min(a, b, ...): null if any argument is null."""
    return _unless_null(F.least(*xs), xs)


def scalar_max(*xs: Column) -> Column:
    return _unless_null(F.greatest(*xs), xs)


def _unless_null(found: Column, xs: tuple[Column, ...]) -> Column:
    some = xs[0].isNull()
    for x in xs[1:]:
        some = some | x.isNull()
    return F.when(~some, found)


def truthy(x: Column) -> Column:
    """Whether text counts as true: t, true, or a number other than 0."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("t", "true"), True).when(t.isin("f", "false"), False).otherwise(F.coalesce(F.regexp_extract(t, r"^([+-]?\d+\.?\d*(?:e[+-]?\d+)?)", 1).try_cast("double"), F.when(t.isNotNull(), 0.0)) != 0)


def cast_integer(x: Column) -> Column:
    """CAST(text AS INTEGER): the leading number, or 0."""
    return F.when(x.isNotNull(), F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")))


def cast_real(x: Column) -> Column:
    """CAST(text AS REAL): the leading number, or 0.0."""
    return F.when(x.isNotNull(), F.coalesce(F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0)))


def cast_uuid(x: Column) -> Column:
    """A canonical UUID, or null."""
    digits = F.lower(F.regexp_replace(x, r"[{}\-\s]", ""))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))

"""Several values packed in one field.

Quoted and parenthesised spans are swapped for indexed placeholders, the rest is
split at the delimiters, each placeholder is looked up in the array of spans, and
the members are exploded with their positions. Everything is a JVM-side expression:
one projection and one generator, no shuffle.

The placeholders cannot collide with the data: a marker character that the field
itself holds is treated as a span of its own, so it is swapped out and restored too.
Parentheses nest to any depth: those inside three others are set aside first (a field
that holds the two characters which stand for them keeps them as they are). A list inside
a list gives its members.

Defined results: null, blank, ``[]``-like and missing-word fields give no row; empty
members take no position; repeated values stay; the order is that of the field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of a placeholder: quoted span <A index B>, any other span <C index D>.
_A, _B, _C, _D = "\ue000", "\ue001", "\ue002", "\ue003"
# What stands for parentheses inside three others.
_DEEP = "\ue004\ue005"
_BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}\x{feff}]"
_DELIMS = r",;|\t\r\n\f、，；｜"

_SINGLE = (
    rf"(?<![^\s{_DELIMS}/\[\]{{}}():])'(?:[^'\\]++|\\.|'(?=\p{{L}}))*+'"
    rf"(?={_BLANK}*(?:$|[{_DELIMS}/\]}}):]|['\"]))"
)
_SPAN = "|".join(
    (
        rf"[{_A}{_B}{_C}{_D}]",
        r'"(?:[^"\\]++|\\.|"")*+"',
        r"“[^”]*+”",
        r"„[^“”]*+[“”]",
        r"«[^»]*+»",
        r"「[^」]*+」",
        r"(?<!\p{L})‘[^’]*+’(?!\p{L})",
        _SINGLE,
        r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)",
    )
)
_SPLIT = (
    rf"{_BLANK}*[{_DELIMS}]{_BLANK}*|(?<={_BLANK})/(?={_BLANK})"
    rf"|(?<={_B}){_BLANK}+(?={_A})"
)
_QUOTES = "\"'“„«「‘"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def _interleave(gaps: Column, fills: Column) -> Column:
    """gap 0, fill 0, gap 1, fill 1, ... as one string."""
    joined = F.zip_with(gaps, fills, lambda g, f: F.concat(g, F.coalesce(f, F.lit(""))))
    return F.array_join(joined, "")


def _unwrap(c: Column) -> Column:
    """A list that was itself written as one quoted string, and the repr of a tuple or array."""
    inner = F.substring(c, 2, F.greatest(F.length(c) - 2, F.lit(0)))
    wrapped = c.rlike(rf'(?s)^"{_BLANK}*[\[{{(].*[\]}})]{_BLANK}*"$')
    c = _trim(
        F.when(wrapped & c.contains('\\"'), F.regexp_replace(inner, r'\\(["\\/])', "$1"))
        .when(wrapped & c.contains('""'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(wrapped & c.rlike(r'(?s)^".[^"]*"$'), inner)
        .otherwise(c)
    )
    c = F.regexp_replace(c, r"(?s)^(?:array|frozenset|set|list|tuple)\((.*?)(?:,\s*dtype=[\w'\"<>]+)?\)$", "$1")
    return _trim(F.regexp_replace(c, rf"(?s)^\({_BLANK}*(['\"“‘].*)\)$", "$1"))


def _unquote(span: Column) -> Column:
    """The content of one quoted span, its escapes and doubled quotes resolved."""
    inner = F.substring(span, 2, F.greatest(F.length(span) - 2, F.lit(0)))
    plain = F.regexp_replace(inner, r"""\\([\\"'/])""", "$1")
    plain = F.when(span.startswith('"'), F.replace(plain, F.lit('""'), F.lit('"'))).otherwise(plain)
    coded = F.get(F.from_json(F.concat(F.lit("["), span, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(span.rlike(r'^".*\\u[0-9a-fA-F]{4}'), F.coalesce(coded, plain)).otherwise(plain)


def _let(value: Column, then) -> Column:
    """Evaluate value once per row and hand it to then; a captured expression would be evaluated per element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def packed_values(field: Column, missing: tuple[str, ...] = ("none", "nan", "null")) -> Column:
    """array<string> of the members of a packed field, in order, never null."""
    whole = _trim(field)
    cut = _let(_flattened(_unwrap(whole)), lambda t: F.struct(
        F.split(t, _SPAN).alias("gaps"), F.regexp_extract_all(t, F.lit(_SPAN), F.lit(0)).alias("spans")))
    marked = _let(cut, lambda c: F.struct(
        c["spans"].alias("spans"), _interleave(c["gaps"], F.transform(c["spans"], _mark)).alias("body")))
    values = _let(marked, lambda c: F.filter(
        F.transform(F.split(_open(_trim(c["body"])), _SPLIT), lambda m: F.translate(_restore(_trim(m), c["spans"]), _DEEP, "()")), lambda v: v != ""))
    none = field.isNull() | (whole == "") | F.lower(whole).isin(*missing) | whole.rlike(rf"^[\[({{]{_BLANK}*[\])}}]$")
    return F.when(none, F.array().cast("array<string>")).otherwise(values)


def _flattened(t: Column) -> Column:
    """t with the parentheses inside three others set aside."""

    def step(s: Column, b: Column) -> Column:
        deep = F.when(b == "(", s["depth"] >= 3).otherwise(s["depth"] > 3)
        sign = F.when(deep, F.translate(b, "()", _DEEP)).otherwise(b)
        depth = F.when(b == "(", s["depth"] + 1).when(b == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.concat(s["text"], F.when(b.isin("(", ")"), sign).otherwise(b)).alias("text"))

    bits = F.regexp_extract_all(t, F.lit(r"[()]|[^()]+"), F.lit(0))
    whole = F.aggregate(bits, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step, lambda s: s["text"])
    return F.when(t.rlike(r"(?:\([^()]*){4}") & ~t.rlike(f"[{_DEEP}]"), whole).otherwise(t)


def _mark(span: Column, i: Column) -> Column:
    """The placeholder of a span: quoted ones and others differ, since only quotes may be parted by blanks."""
    at = i.cast("string")
    quoted = F.lit(_QUOTES).contains(F.substring(span, 1, 1))
    return F.when(quoted, F.concat(F.lit(_A), at, F.lit(_B))).otherwise(F.concat(F.lit(_C), at, F.lit(_D)))


def _open(body: Column) -> Column:
    """Without the brackets of a list or set, or of lists inside a list; an opening bracket that never closes goes too."""
    inner = F.regexp_replace(F.regexp_replace(body, rf"(^|[{_DELIMS}])({_BLANK}*)\[[\[\s]*", "$1$2"), rf"{_BLANK}*\][\]\s]*(?={_BLANK}*(?:$|[{_DELIMS}]))", "")
    body = F.when(body.rlike(rf"(?s)^\[.*\]$") & body.rlike(rf"[\[{_DELIMS}]{_BLANK}*\["), inner).otherwise(body)
    body = F.regexp_replace(body, r"(?s)^\[((?:[^\[\]]++|\[[^\[\]]*+\])*+)\]$", "$1")
    body = F.regexp_replace(body, r"(?s)^\{([^{}]*)\}$", "$1")
    return F.regexp_replace(body, r"^[\[{](?=[^\]}]*$)", "")


def _restore(member: Column, spans: Column) -> Column:
    """Look the placeholders of a member up; a member that is one quoted span loses its quotes."""
    at = F.regexp_extract_all(member, F.lit(f"[{_A}{_C}](\\d+)[{_B}{_D}]"), F.lit(1))
    found = F.transform(at, lambda k: F.get(spans, k.cast("int")))
    alone = member.rlike(f"^{_A}\\d+{_B}$")
    inline = _interleave(F.split(member, f"[{_A}{_C}]\\d+[{_B}{_D}]"), found)
    return _trim(F.when(alone, _unquote(F.get(found, F.lit(0)))).otherwise(inline))


def explode_packed(
    df: DataFrame, field: str, value: str, pos: str = "pos", keep: list[str] | None = None
) -> DataFrame:
    """One row per member: the columns of keep (default: all others), pos from 1, value.

    The columns keep their names except where they clash with pos or value; those are left out.
    """
    cols = [c for c in (keep if keep is not None else df.columns) if c not in (pos, value)]
    if keep is None:
        cols = [c for c in cols if c != field]
    return df.select(
        *[F.col(f"`{c}`") for c in cols], F.posexplode(packed_values(F.col(f"`{field}`"))).alias("__pos", value)
    ).select(*[F.col(f"`{c}`") for c in cols], (F.col("__pos") + 1).cast("int").alias(pos), value)


def first_delivery(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per non-null key: that of the least order (ties: the least values). Combined before the shuffle."""
    rest = [c for c in columns if c != key]
    one = F.min(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in rest])).alias("__one")
    return (
        df.filter(F.col(key).isNotNull()).groupBy(key).agg(one).select(key, *[F.col(f"__one.{c}").alias(c) for c in rest])
    )

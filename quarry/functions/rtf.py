"""Plain text of RTF files: a machine over tokens with a stack of groups, run by the built-in ``aggregate``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import tidy_newlines
from .values import EXCERPT_CAP

#: Groups that aren't text, by the beginnings of their names.
HIDDEN = "fonttbl colortbl stylesheet info pict header footer footnote object shp themedata generator listtable listoverridetable rsidtbl".split()
_OPENS_HIDDEN = rf"\{{\\(?:\*|{'|'.join(HIDDEN)})"
TOKEN = rf"(?s)({_OPENS_HIDDEN}|[{{}}]|\\u-?\d+ ?|\\'[0-9a-fA-F]{{2}}|\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]|[^\\{{}}]+)"
TEXT, OPEN, HIDE, CLOSE, UNICODE, SINGLE, BREAK, WIDTH, OTHER = range(9)


def _token(t: Column) -> Column:
    """What a token is (kind), the number in it (n) and what it shows (s)."""
    code = F.regexp_extract(t, r"^\\u(-?\d+)", 1).try_cast("long")
    unit = F.pmod(code, F.lit(65_536))
    digits = F.lpad(F.hex(unit), 4, "0")
    struct = lambda kind, n, s: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), s.alias("s"))
    none, zero = F.lit(""), F.lit(0)
    return (
        F.when(~t.startswith("\\") & ~t.startswith("{") & (t != "}"), struct(TEXT, F.length(t), t)).when(t == "{", struct(OPEN, zero, none)).when(t.startswith("{"), struct(HIDE, zero, none)).when(t == "}", struct(CLOSE, zero, none))
        .when(code.isNotNull(), struct(UNICODE, unit, F.when(unit.between(0xD800, 0xDFFF), digits).otherwise(F.decode(F.unhex(digits), "UTF-16BE"))))
        .when(t.startswith("\\'"), struct(SINGLE, F.lit(1), F.decode(F.unhex(F.substring(t, 3, 2)), "ISO-8859-1"))).when(t.isin("\\\\", "\\{", "\\}"), struct(SINGLE, F.lit(1), F.substring(t, 2, 1)))
        .when(t.rlike(r"^\\(par|line)(?![a-zA-Z])"), struct(BREAK, zero, F.lit("\n"))).when(t.rlike(r"^\\tab(?![a-zA-Z])"), struct(BREAK, zero, F.lit("\t"))).when(t == "\\~", struct(BREAK, zero, F.lit(" ")))
        .when(t.rlike(r"^\\uc\d"), struct(WIDTH, F.regexp_extract(t, r"^\\uc(\d+)", 1).try_cast("int"), none)).otherwise(struct(OTHER, zero, none))
    )


def rtf_text(latin: Column, most: int = EXCERPT_CAP) -> Column:
    """The text of an RTF file, its bytes one character each; not much over ``most`` characters of it.

    Groups nest to any depth; one that starts with a hidden name, or with a star, is left out with all in
    it. After a character in Unicode as many others are skipped as the group's ``\\uc`` says (one), and
    negative numbers count from 65,536 down. Characters in hexadecimal are those of ISO-8859-1.
    """
    cut = F.regexp_extract_all(F.regexp_replace(latin, r"[\r\n]", ""), F.lit(TOKEN), 1)
    cut = F.filter(F.transform(cut, _token), lambda t: t["kind"] != OTHER)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("hidden"), F.array(F.lit(1)).alias("uc"), F.lit(0).alias("skip"), F.lit("").alias("out"), F.lit("").alias("half"))

    def step(a: Column, t: Column) -> Column:
        kind, n, s = t["kind"], t["n"], t["s"]
        opens, closes = kind.isin(OPEN, HIDE), kind == CLOSE
        depth = a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        hidden = F.when(a["hidden"] > 0, F.when(closes & (a["depth"] == a["hidden"]), 0).otherwise(a["hidden"])).when(kind == HIDE, depth).otherwise(0)
        outer = F.slice(a["uc"], F.lit(1), F.size(a["uc"]) - 1)
        uc = F.when(opens, F.array_append(a["uc"], F.element_at(a["uc"], -1))).when(closes & (F.size(a["uc"]) > 1), outer).when(kind == WIDTH, F.concat(outer, F.array(n))).otherwise(a["uc"])
        skip = F.when(kind == UNICODE, F.element_at(a["uc"], -1)).when(kind.isin(TEXT, SINGLE), F.greatest(a["skip"] - n, F.lit(0))).when(opens | closes, 0).otherwise(a["skip"])
        half = F.when(kind == UNICODE, F.when(n.between(0xD800, 0xDBFF), s).otherwise("")).otherwise(a["half"])  # a surrogate that waits for its other
        shown = (
            F.when((kind == UNICODE) & n.between(0xD800, 0xDFFF), F.when((n >= 0xDC00) & (a["half"] != ""), F.decode(F.unhex(F.concat(a["half"], s)), "UTF-16BE")).otherwise(""))
            .when(kind == TEXT, F.when(a["skip"] > 0, F.substring(s, a["skip"] + 1, n)).otherwise(s)).when((kind == SINGLE) & (a["skip"] > 0), "").otherwise(s)
        )
        out = F.when((a["hidden"] > 0) | (F.octet_length(s) == 0) | (F.octet_length(a["out"]) > 4 * most), a["out"]).otherwise(F.concat(a["out"], shown))
        return F.struct(depth.alias("depth"), hidden.cast("int").alias("hidden"), uc.alias("uc"), skip.cast("int").alias("skip"), out.alias("out"), half.alias("half"))

    return tidy_newlines(F.aggregate(cut, start, step)["out"])

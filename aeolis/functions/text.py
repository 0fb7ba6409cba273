"""Text column functions for search: phonetic codes, stems, cleaned words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that a stem loses, one after another.
ENDINGS = ("is", "es", "s", "ing", "ity", "ian", "ly", "al", "ic", "ed", "ous")


def phonetic(word: Column) -> Column:
    """Initial and digits by sound, at least three and not cut; empty for what isn't letters."""
    upper = F.upper(word)
    coded = F.translate(F.regexp_replace(F.substring(upper, 2, 1 << 20), "[AEIOUHWY]", ""), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    digits = F.regexp_replace(coded, r"(.)\1+", "$1")
    return F.when(word.rlike("^[A-Za-z]+$"), F.concat(F.substring(upper, 1, 1), F.rpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))).otherwise("")


def stem(word: Column) -> Column:
    """A word of letters without its endings and without a doubled last letter; empty for other words."""
    out = word
    for ending in ENDINGS:
        out = F.regexp_replace(out, f"(?<=.){ending}$", "")
    return F.when(word.rlike("^[A-Za-z]+$"), F.regexp_replace(out, r"(.)\1+$", "$1")).otherwise("")


def clean_word(word: Column) -> Column:
    """Lower case without tags, outer punctuation and brackets; null if nothing is left."""
    low = F.lower(F.trim(word))
    out = F.when(F.contains(low, F.lit("<")), F.regexp_replace(low, "<[^>]*>", "")).otherwise(low)
    out = F.rtrim(F.ltrim(out, F.lit(""",:'"\\(<>""")), F.lit(""",:'"\\)+.<>"""))
    return F.nullif(out, F.lit(""))


def words(text: Column) -> Column:
    """The parts between white space, in order."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


#: Accented letters and what they are searched as.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def fold_accents(s: Column) -> Column:
    return F.translate(s, ACCENTED, PLAIN)


def ascii_lower(s: Column) -> Column:
    """A-Z only."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_class(s: Column, kind: str) -> Column:
    """alpha, alnum, digit or no_letters, of ASCII; an empty string is of each."""
    return s.rlike({"alpha": "^[A-Za-z]*$", "alnum": "^[A-Za-z0-9]*$", "digit": "^[0-9]*$", "no_letters": "^[^A-Za-z]*$"}[kind])


def holds(s: Column, needle: Column) -> Column:
    """Whether needle is in s; an empty one is not."""
    return (F.length(needle) > 0) & F.contains(s, needle)


def occurs(s: Column, needle: Column) -> Column:
    """How often, without overlaps."""
    return F.when(F.length(needle) > 0, ((F.length(s) - F.length(F.replace(s, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def token(s: Column, separator: str, n: int) -> Column:
    """The part before the (n + 1)th separator, from 0; empty if there are fewer."""
    return F.coalesce(F.split_part(s, F.lit(separator), F.lit(n + 1)), F.lit(""))


def csv_split(s: Column) -> Column:
    """Parts between commas outside double quotes; quotes stay."""
    return F.split(s, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')


def unquote(s: Column) -> Column:
    return F.regexp_replace(s, r"""^(["'])(.*)\1$""", "$2")


def with_commas(s: Column) -> Column:
    """Digits in groups of three; empty for what isn't a whole number."""
    return F.when(s.rlike("^[0-9]+$"), F.regexp_replace(s, r"(?<=\d)(?=(\d{3})+$)", ",")).otherwise("")


def to_title(s: Column) -> Column:
    """Words with capitals, small ones only at the start."""
    parts = F.split(F.lower(s), " ")
    return F.array_join(F.transform(parts, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.initcap(w))), " ")


def summary(s: Column, n: int) -> Column:
    """The first n words, with an ellipsis if there are more."""
    w = words(s)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, " ...").otherwise(""))


def clean_id(s: Column) -> Column:
    """Upper case, trimmed, with / for what isn't ASCII and XML's characters escaped."""
    out = F.regexp_replace(F.trim(s), r"[^\x00-\x7F]", "/")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.upper(out)


def size_text(n: Column, largest: str = "PB") -> Column:
    """Bytes in the largest unit, up to `largest`, that leaves at least 1, with two digits cut."""
    out, units = F.concat(n.cast("string"), F.lit(" bytes")), ("KB", "MB", "GB", "TB", "PB")
    for power, unit in enumerate(units[: units.index(largest) + 1], 1):
        out = F.when(n >= 1000**power, F.concat(F.format_string("%.2f", F.floor(n / 1000**power * 100) / 100), F.lit(f" {unit}"))).otherwise(out)
    return out


#: What a spelling check passes over, as whole words: numbers, ordinals, versions, codes, references, addresses, files.
_PASSED = (
    r"[0-9][0-9.,:]*s?", r"[A-Z0-9]+", r"[A-Z0-9.]*\.[A-Z0-9.]*", r"[0-9]*(?:1st|2nd|3rd|[04-9]th)", r"d[0-9]{6}", r"pre-[0-9]+", r"v[0-9.]+", r"[0-9]+\.x", r"[0-9]+[a-z]+",
    r"[A-Za-z][.)]", r"\([A-Za-z1-9]\)", r"\([ivx]+\)", r"[IVX]+", r"[^@\s]+@[^@\s]+\.[^@\s]+", r"\.[A-Za-z0-9]{1,10}", r"https?://\S+",
)


def checked(word: Column) -> Column:
    """Whether a spelling check looks at a word."""
    bare = F.regexp_replace(word, "^#", "")
    return (F.length(bare) > 0) & ~bare.rlike(f"^(?:{'|'.join(_PASSED)})$")


def compound_parts(word: Column) -> Column:
    """The parts of a word with - / or ; and all of them as one; an empty array for a simple word."""
    parts = F.filter(F.split(word, "[-/;]"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.concat(parts, F.array(F.array_join(parts, "")))).otherwise(F.array().cast("array<string>"))


def html_text(s: Column) -> Column:
    """Text of a fragment of markup: no tags, scripts or comments, common references decoded, single spaces."""
    out = F.regexp_replace(s, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</?(?:p|br|div|li|ul|ol|tr|td|h[1-6])\b[^>]*>", " "), "<[^>]*>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Least degrees, least kilometres and keyword of horizontal resolutions.
RESOLUTIONS = (
    (0.0, 0.0, "H : < 1 meter"),
    (0.00001, 0.001, "H : 1 meter - < 30 meters"),
    (0.0003, 0.03, "H : 30 meters - < 100 meters"),
    (0.001, 0.1, "H : 100 meters - < 250 meters"),
    (0.0025, 0.25, "H : 250 meters - < 500 meters"),
    (0.005, 0.5, "H : 500 meters - < 1 km"),
    (0.01, 1.0, "H : 1 km - < 10 km or approximately .01 degree - < .09 degree"),
    (0.09, 10.0, "H : 10 km - < 50 km or approximately .09 degree - < .5 degree"),
    (0.5, 50.0, "H : 50 km - < 100 km or approximately .5 degree - < 1 degree"),
    (1.0, 100.0, "H : 100 km - < 250 km or approximately 1 degree - < 2.5 degrees"),
    (2.5, 250.0, "H : 250 km - < 500 km or approximately 2.5 degrees - < 5.0 degrees"),
    (5.0, 500.0, "H : 500 km - < 1000 km or approximately 5 degrees - < 10 degrees"),
    (10.0, 1000.0, "H : >= 1000 km or >= 10 degrees"),
)
#: Keywords of time resolutions, of climatologies and of regular series, by unit.
CLIMATOLOGIES = {
    "hour": "T : Hourly Climatology",
    "day": "T : Daily Climatology",
    "week": "T : Weekly Climatology",
    "month": "T : Monthly Climatology",
    "season": "T : Seasonal Climatology",
    "winter": "T : Seasonal Climatology",
    "spring": "T : Seasonal Climatology",
    "summer": "T : Seasonal Climatology",
    "autumn": "T : Seasonal Climatology",
    "year": "T : Annual Climatology",
    "30-year": "T : Climate Normal (30-year climatology)",
}
REGULAR = {
    "second": "T : 1 second - < 1 minute",
    "minute": "T : 1 minute - < 1 hour",
    "hour": "T : Hourly - < Daily",
    "day": "T : Daily - < Weekly",
    "week": "T : Weekly - < Monthly",
    "month": "T : Monthly - < Annual",
    "season": "T : Monthly - < Annual",
    "year": "T : Annual",
    "winter": "T : Annual",
    "spring": "T : Annual",
    "summer": "T : Annual",
    "autumn": "T : Annual",
}


def time_resolution_name(kind: Column, number: Column, unit: Column) -> Column:
    """Of a climatology or a regular series; climatologies of 5 and 7 days have names of their own."""
    named = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), unit)
    days = F.when((unit == "day") & (number == 5), "T : Pentad Climatology").when((unit == "day") & (number == 7), "T : Weekly Climatology")
    return F.when(kind == "climatology", F.coalesce(days, named(CLIMATOLOGIES))).when(kind == "regular", named(REGULAR))


def resolution_name(value: Column, unit: str = "degrees") -> Column:
    out = F.lit(None).cast("string")
    for degrees, km, name in RESOLUTIONS:
        out = F.when(value >= (degrees if unit == "degrees" else km), name).otherwise(out)
    return out


def chop(s: Column, n: int) -> Column:
    """Without the last n characters."""
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - n, F.lit(0)))


def shift(s: Column, n: int) -> Column:
    """Each printable ASCII character n places on, around the 95 of them."""
    printable = "".join(map(chr, range(32, 127)))
    return F.translate(s, printable, printable[n % 95 :] + printable[: n % 95])


def wrap(s: Column, width: int, indent: int = 0) -> Column:
    """Lines of at most `width` characters, the indent included, broken at spaces; longer words have their own."""
    broken = lambda line: F.regexp_replace(line, f"(.{{1,{width - indent}}}|[^ ]+)(?: |$)", " " * indent + "$1\n")
    return F.array_join(F.transform(F.split(s, "\n"), lambda line: F.regexp_replace(broken(line), r"\s+$", "")), "\n")


def coordinate_digits(s: Column) -> Column:
    """A decimal coordinate as digits with four places and no point."""
    return F.concat(F.split_part(s, F.lit("."), F.lit(1)), F.rpad(F.split_part(s, F.lit("."), F.lit(2)), 4, "0"))


def subset_request(s: Column) -> Column:
    """A request such as `dsnum=1;parameters=a!b,c;nlat=50` as a struct; absent bounds are the open ones, absent lists null.

    Parameters are a map from key to format, which is empty if none is given.
    """
    given = F.str_to_map(s, F.lit(";"), F.lit("="))
    bound = lambda k, open_: F.coalesce(given[k].try_cast("double"), F.lit(open_)).alias(k)
    pairs = F.transform(F.split(given["parameters"], ","), lambda e: F.struct(F.regexp_replace(e, "^[^!]*!", "").alias("key"), F.when(e.contains("!"), F.split_part(e, F.lit("!"), F.lit(1))).otherwise("").alias("value")))
    return F.struct(
        *(given[k].alias(k) for k in ("dsnum", "startdate", "enddate", "grid_definition", "ens", "tindex", "inittime")),
        *(F.split(given[k], ",").alias(k) for k in ("level", "product")), F.map_from_entries(pairs).alias("parameters"),
        bound("nlat", 99.0), bound("slat", -99.0), bound("wlon", -999.0), bound("elon", 999.0),
    )


def time_range_kind(code: Column) -> Column:
    """average or accumulation for the codes of GRIB time ranges that are one, else null."""
    return F.when(code.isin(51, 113, 115, 117, 123), "average").when(code.isin(114, 116, 124), "accumulation")


def _xpath(path: str, tail: str) -> Column:
    """a/b@key=value@other=more/c as an XPath; a slash in a value is written \\/."""
    steps = []
    for step in re.split(r"(?<!\\)/", path):
        name, *tests = step.replace("\\/", "/").split("@")
        steps.append(name + "".join("[@{}='{}']".format(*t.split("=", 1)) for t in tests))
    return F.lit("/".join(steps) + tail)


def elements(xml: Column, path: str) -> Column:
    """Texts of the elements at a path of names and attributes that must be equal, in the document's order; null without a document."""
    return F.xpath(xml, _xpath(path, "/text()"))


def attributes(xml: Column, path: str, name: str) -> Column:
    """Values of an attribute of the elements at a path."""
    return F.xpath(xml, _xpath(path, f"/@{name}"))


def end_around_sum(words: Column, width: int) -> Column:
    """The sum of an array of whole numbers of `width` bits whose carry is added at the lower end."""
    top = 1 << width
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: F.when(a + x >= top, a + x - (top - 1)).otherwise(a + x))

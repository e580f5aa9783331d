"""Text to structure: normalisation, coordinate grammars, status words, HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import geo

# Words that mark a notice as over or in force; those for over win.
ARCHIVED_WORDS = ("utgått", "utgatt", "utgaatt", "historisk", "avsluttet", "arkiv", "expired")
CURRENT_WORDS = ("gjeldende", "gjeldande", "kommende", "current")

# Words for the hemispheres, and for degrees and minutes, in notices.
NORTH_SOUTH, EAST, WEST, EAST_NEW = ("nord", "sør", "sor"), "øst", "vest", "aust"
DEGREE_WORD, MINUTE_WORD = "grader", "minutter"

#: A text falls into white space, numbers, words and single signs.
TOKEN = r"(?s)\s+|\d+(?:[.,]\d*)?|\p{L}+|."

# Written forms are patterns over a text with a mark before every token; white space may stand between tokens, or must (a new number).
_MARK = "\u0001"
_END, _GAP, _SPACE, _ANY = f"(?![^{_MARK}])", rf"(?:{_MARK}\s++)?", rf"{_MARK}\s++", rf"{_MARK}(\d[^{_MARK}]*+)"


def _word(*words: str) -> str:
    """One of some whole words in any case, as a group."""
    either = ["".join(f"[{c}{c.upper()}]" for c in w) for w in words]
    return f"{_MARK}({'|'.join(either)}){_END}"


def _whole(figures: str) -> str:
    return rf"{_MARK}(\d{{{figures}}}){_END}"


def _sign(signs: str) -> str:
    return f"{_MARK}[{signs}]"


#: A comma or stop after a unit that is written out does not count.
_UNIT = lambda word: _word(word).replace("(", "(?:", 1) + f"(?:{_GAP}{_sign('.,')})?"
_NS, _EW, _EWV = f"{_MARK}([nNsS]){_END}", f"{_MARK}([eEøØwW])", f"{_MARK}([eEøØwWvV])"
_LONG = _SPACE + _whole("1,3") + _GAP + _UNIT(DEGREE_WORD) + _SPACE + _ANY + _GAP
#: From the most to the least exact: the pattern of a latitude and a longitude, and of each the groups of its degrees, minutes, seconds and hemisphere
#: (in the compact form one number holds degrees and minutes).
FORMS = {
    "dms": (_GAP.join([_whole("1,3"), _sign("°"), _whole("1,3"), _sign("'"), _ANY, _sign('"'), _NS]) + _SPACE + _GAP.join([_whole("1,3"), _sign("°"), _whole("1,3"), _sign("'"), _ANY, _sign('"'), _EW]), (1, 2, 3, 4), (5, 6, 7, 8)),
    "long": (_word(*NORTH_SOUTH) + _LONG + _UNIT(MINUTE_WORD) + _GAP + _word(EAST, WEST, EAST_NEW) + _LONG + _word(MINUTE_WORD), (2, 3, None, 1), (5, 6, None, 4)),
    "symbol": (_GAP.join([_whole("1,3"), _sign("°"), _ANY, _sign("'°"), _NS]) + _SPACE + _GAP.join([_whole("1,3"), _sign("°"), _ANY, _sign("'°"), _EW]), (1, 2, None, 3), (4, 5, None, 6)),
    "compact": (_GAP.join([_whole("4"), _NS, _sign("-"), _whole("4,5"), _EWV]), (1, 1, None, 2), (3, 3, None, 4)),
}
#: What a marked text has wherever a form is in it, and what any text with a form has.
_SIGNS_OF = {"dms": '(?s)°.*"', "long": _word(DEGREE_WORD), "symbol": "°", "compact": _GAP.join([_whole("4"), _NS, _sign("-")])}
_ROUGHLY = ("°", f"(?i:{DEGREE_WORD})", r"\d{4}\s*[nNsS]\s*-")
#: The words after which a notice says how it reads as a whole.
CONSOLIDATED = r"(?is)^.*?forskriften lyder etter dette\s*:"


def normalized(text: Column) -> Column:
    """Plain quotes, dashes, spaces and line ends."""
    return F.regexp_replace(F.translate(text, "‘’ʼ“”–— ", "'''\"\"-- "), "\r\n", "\n")


def _degrees(found: Column, groups: tuple) -> Column:
    text = lambda group: F.get(found, F.lit(group - 1))
    number = lambda t: F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    degrees, minutes, seconds, hemisphere = groups
    if degrees == minutes:
        figures = text(degrees)
        value = number(F.substring(figures, F.lit(1), F.length(figures) - 2)) + number(F.right(figures, F.lit(2))) / 60
    else:
        value = number(text(degrees)) + number(text(minutes)) / 60
    if seconds:
        value = value + number(text(seconds)) / 3600
    negative = F.lower(F.substring(text(hemisphere), 1, 1)).isin("s", "w", "v")
    return F.when(negative, -value).otherwise(value)


def _points(marked: Column, form: str) -> Column:
    pattern, lat, lon = FORMS[form]
    pairs = F.regexp_extract_all(marked, F.lit(pattern), F.lit(0))
    # All groups of a pair at once; none of them has a mark in it.
    groups = _MARK.join(f"${i}" for i in range(1, max(i for i in lat + lon if i) + 1))
    found = F.transform(pairs, lambda p: F.split(F.regexp_replace(p, pattern, groups), _MARK))
    points = F.transform(found, lambda g: F.struct(_degrees(g, lat).alias("lat"), _degrees(g, lon).alias("lon")))
    return F.filter(points, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))


def _marked(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN, _MARK + "$0")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def coordinates(text: Column, form: str) -> Column:
    """Points (lat, lon) of all pairs of a written form in a text, in order; what is out of bounds or no number is left out."""
    return _points(_marked(text), form)


def all_coordinates(text: Column) -> Column:
    """Points of all forms, form by form, near repeats (1e-4 degrees) left out: the first form's point stays. Texts are searched for the forms whose signs they have."""
    plain, none = normalized(text), F.array().cast("array<struct<lat:double,lon:double>>")
    points = _bound(_marked(plain), lambda m: F.concat(*[F.when(m.rlike(signs), _points(m, form)).otherwise(none) for form, signs in _SIGNS_OF.items()]))
    # Not bound once more: over a lambda's variable the repeats were seen to stay (why was not found).
    return F.when(plain.rlike("|".join(_ROUGHLY)), geo.without_near_repeats(points, none)).when(text.isNotNull(), none)


def consolidated(text: Column) -> Column:
    """What follows the consolidation mark of a notice, if anything does; else the whole text."""
    rest = F.regexp_replace(text, CONSOLIDATED, "")
    return F.when(F.trim(rest) != "", rest).otherwise(text)


def authority_coordinate(text: Column) -> Column:
    """``DD MM,mmm[NSEW]`` as degrees; 60 or more minutes are null."""
    pattern = r"^\s*(\d{1,3})\s+(\d{1,2}(?:[.,]\d+)?)\s*([NSEWnsew])\s*$"
    degrees = F.regexp_extract(text, pattern, 1).try_cast("double")
    minutes = F.regexp_replace(F.regexp_extract(text, pattern, 2), ",", ".").try_cast("double")
    sign = F.when(F.upper(F.regexp_extract(text, pattern, 3)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(minutes < 60, sign * (degrees + minutes / 60))


def status_of(text: Column, fallback: Column) -> Column:
    low = F.lower(text)
    has = lambda words: F.coalesce(low.rlike("|".join(words)), F.lit(False))
    return F.when(has(ARCHIVED_WORDS), "archived").when(has(CURRENT_WORDS), "current").otherwise(fallback)


def html_text(html: Column) -> Column:
    """Visible text: scripts and styles gone, tags as spaces, the common entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_markdown(html: Column) -> Column:
    """Headings, list items, bold text and paragraphs as Markdown; other tags go."""
    out = html
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    for tag, text in ((r"<li[^>]*>(.*?)</li>", "\n- $1"), (r"<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)>", "**$1**"), (r"<br\s*/?>|</p>|</div>|</ul>", "\n"), (r"<[^>]*>", "")):
        out = F.regexp_replace(out, "(?is)" + tag, text)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", ""))


def definition(html: Column, label: str) -> Column:
    """Value of a label in a definition list: the machine time if the cell has one, else its text; none is null."""
    cell = F.regexp_extract(html, rf"(?is)<dt[^>]*>\s*{label}\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1)
    time = F.regexp_extract(cell, r"""(?i)<time[^>]+datetime=["']([^"']+)["']""", 1)
    return F.nullif(F.when(time != "", time).otherwise(html_text(cell)), F.lit(""))


def whole_word(text: Column, word: Column) -> Column:
    """Whether a word stands in a text with no letter or figure next to an end that is itself a letter or figure."""
    quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    left = F.when(word.rlike(r"^[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}])").otherwise("")
    right = F.when(word.rlike(r"[\p{L}\p{N}]$"), r"(?![\p{L}\p{N}])").otherwise("")
    return F.rlike(text, F.concat(left, quoted, right))


def chunks(text: Column, size: int) -> Column:
    """A text in parts of ``size`` characters, numbered from 0."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("part"), F.substring(text, i * size + 1, F.lit(size)).alias("body")))


def uuid_from(text: Column) -> Column:
    """A version 8 UUID made of the SHA-256 of a text."""
    h = F.sha2(text, 256)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def base64url(text: Column) -> Column:
    """URL-safe base64 of a text's UTF-8 bytes, without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/=", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    padded = F.concat(F.translate(text, "-_", "+/"), F.substring(F.lit("=="), 1, F.pmod(-F.length(text), F.lit(4))))
    return F.decode(F.unbase64(padded), "UTF-8")


def quotes_hold(text: Column, quotes: Column) -> Column:
    """Whether every value of a map stands word for word in a text; a missing text holds none."""
    return F.coalesce(F.forall(F.map_values(quotes), lambda q: text.contains(q)), F.lit(False))

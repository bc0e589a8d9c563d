"""Text functions that stay in Catalyst: places of patterns, markup, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of markup and tokens. (?U) reads classes as Unicode, (?s) lets a dot match line ends.
URL = r"(?U)https?://\S+"
NOFORMAT_PAIR = r"(?s)\{noformat\}.*?\{noformat\}"
CODE_PAIR = r"(?s)\{code.*?\}.*?\{code.*?\}"
COLOUR_PAIR = r"(?s)\{color.*?\}.*?\{color.*?\}"
LINE_COMMENT = r"(?U)(?s)\s*//.*?[\n\r]"
TOKEN = r"(?U)(?:[a-zA-Z]\.)+|\$?\d+(?:\.\d+)*%?|\w+(?:[-'.]\w+)*|\.\.\.|[.,;\"?():-_`]"
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
NUMBER = rf"^-?{DIGIT}+\.?{DIGIT}*$"

REGIONS = "array<struct<start:int,end:int,tag:string,content:string>>"


def places(text: Column, pattern: str) -> Column:
    """start, end (0-based, half-open, in code points) and hit of each match; the pattern must not match nothing."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def _regions(text: Column, pattern: str, tag, content) -> Column:
    made = F.transform(places(text, pattern), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), tag(r["hit"]).alias("tag"), content(r["hit"]).alias("content")))
    return F.coalesce(made, F.array()).cast(REGIONS)


def _inner(hit: Column, opener: Column, closer: Column | int) -> Column:
    closer = F.lit(closer) if isinstance(closer, int) else closer
    return F.substring(hit, F.length(opener) + 1, F.greatest(F.length(hit) - F.length(opener) - closer, F.lit(0)))


def url_regions(text: Column) -> Column:
    """URLs, with whatever non-space stands at their end."""
    return _regions(text, URL, lambda h: F.lit("url"), lambda h: h)


def line_comments(text: Column) -> Column:
    """Comments from ``//`` through the line end, with the white space before them."""
    return _regions(text, LINE_COMMENT, lambda h: F.lit("singlecomment"), lambda h: h)


def colour_regions(text: Column) -> Column:
    """Pairs of colour tags; the content lacks the opener and the last seven characters, whatever the closer is."""
    opener = lambda h: F.regexp_extract(h, r"(?s)^\{color.*?\}", 0)
    return _regions(text, COLOUR_PAIR, opener, lambda h: _inner(h, opener(h), 7))


def code_regions(text: Column) -> Column:
    """T4: all noformat pairs, then all code pairs; not sorted together."""
    plain = lambda h: F.lit("{noformat}")
    code = lambda h: F.regexp_extract(h, r"(?s)^\{code.*?\}", 0)
    return F.concat(_regions(text, NOFORMAT_PAIR, plain, lambda h: _inner(h, plain(h), 10)), _regions(text, CODE_PAIR, code, lambda h: _inner(h, code(h), 6)))


def spliced(text: Column, regions: Column, instead) -> Column:
    """``text`` with each of its disjoint ascending regions replaced by ``instead(region)``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, r: Column) -> Column:
        return F.struct(r["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, r["start"] - a["at"]), instead(r)).alias("out"))

    return F.aggregate(regions, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def without_colour(text: Column) -> Column:
    """Each coloured region becomes its content between blanks."""
    return spliced(text, colour_regions(text), lambda r: F.concat(F.lit(" "), r["content"], F.lit(" ")))


def merged(regions: Column) -> Column:
    """Regions that overlap or touch as one; a contained region leaves no tag; descending by start."""
    indexed = F.array_sort(F.transform(regions, lambda r, i: F.struct(r["start"].alias("start"), i.alias("i"), r["end"].alias("end"), r["tag"].alias("tag"), r["content"].alias("content"))))

    def step(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.struct(last["start"].alias("start"), r["end"].alias("end"), F.concat(last["tag"], F.lit(","), r["tag"]).alias("tag"), F.concat(last["content"], F.substring(r["content"], last["end"] - r["start"] + 1, F.length(r["content"]))).alias("content"))
        single = F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"), r["tag"].alias("tag"), r["content"].alias("content")))
        touch = (F.size(out) > 0) & (r["start"] <= last["end"])
        return F.when(touch & (r["end"] <= last["end"]), out).when(touch, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, single))

    return F.reverse(F.aggregate(indexed, F.array().cast(REGIONS), step))


def comments_outside_urls(comments: Column, urls: Column) -> Column:
    """a comment that begins strictly inside a URL is part of it."""
    return F.filter(comments, lambda c: ~F.exists(urls, lambda u: (u["start"] < c["start"]) & (c["start"] < u["end"])))


def brace_match(text: Column, start: Column) -> Column:
    """How many characters from ``start`` on it takes to balance the braces, 0 if they never do."""
    rest = F.substring(text, start + 1, F.length(text))
    zero = F.struct(F.lit(0).alias("level"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        level = a["level"] + F.when(x["hit"] == "{", 1).otherwise(-1)
        return F.when(a["end"] > 0, a).otherwise(F.struct(level.alias("level"), F.when((x["hit"] == "}") & (level == 0), x["end"]).otherwise(0).alias("end")))

    return F.aggregate(places(rest, r"[{}]"), zero, step, lambda a: a["end"])


def tokens(text: Column) -> Column:
    """T14 for a sentence: lower-cased tokens in order; null gives none."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower), F.array().cast("array<string>"))


def token_line(text: Column) -> Column:
    """The tokens of ``tokens`` between blanks, put into small letters as one string; null stays null."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), " "))


def is_number(token: Column) -> Column:
    """An integer or a decimal that begins with a digit, with or without a minus; digits of all scripts, raised and lowered ones."""
    return token.rlike(NUMBER)


def meaningful(words: Column, stop_words: list[str]) -> Column:
    """Words that are neither stop words nor numbers, in order, with repeats."""
    stop = F.array(*map(F.lit, stop_words)).cast("array<string>")
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & ~is_number(w))


def label_names(labels: Column) -> Column:
    """The parts between semicolons and commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(labels, "[;,]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def colour_of(name: Column) -> Column:
    """A colour for a name, the same each time."""
    return F.concat(F.lit("#"), F.upper(F.substring(F.md5(name.cast("binary")), 1, 6)))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, of another length, or zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


"""Column functions on texts of blocks: character classes, separators, names, labels, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code-point ranges that count as Chinese, Japanese or Korean:
# ideographs, kana, Hangul letters, Hangul compatibility letters, Hangul syllables,
# CJK punctuation, compatibility forms, half- and full-width forms.
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3040, 0x30FF), (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF), (0x3000, 0x303F), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF))
_CJK = "^[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in CJK_RANGES) + "]"


def is_cjk(char: str | Column) -> Column:
    return F.col(char).rlike(_CJK) if isinstance(char, str) else char.rlike(_CJK)


def is_punctuation(char: str | Column) -> Column:
    """Unicode category P; currency and mathematical signs aren't."""
    return (F.col(char) if isinstance(char, str) else char).rlike(r"^\p{P}")


def separator_between(last: Column, first: Column) -> Column:
    """What stands between a text that ends in ``last`` and one that begins with ``first``: nothing within CJK, after a hyphen and before punctuation, else a space."""
    return F.when(is_cjk(last) & is_cjk(first), "").when(last == "-", "").when(is_punctuation(first), "").otherwise(" ")


def separator(text: str | Column, following: str | Column) -> Column:
    """``separator_between`` for two whole texts."""
    return separator_between(F.right(text, F.lit(1)), F.left(following, F.lit(1)))


def illegal_name(name: str | Column) -> Column:
    """Whether a file name has a character that file systems refuse."""
    return (F.col(name) if isinstance(name, str) else name).rlike(r'[\\/:*?"<>|]')


def safe_name(name: str | Column) -> Column:
    """Trimmed, refused characters as ``_``, at most 255 characters. A back-slash stays, unlike in ``illegal_name``."""
    return F.left(F.regexp_replace(F.trim(name), r'[/:*?"<>|]', "_"), F.lit(255))


def path_parts(path: str) -> dict[str, Column]:
    """Base name, folder, stem and lower-case extension of a path; back-slashes count as slashes."""
    p = F.translate(path, "\\", "/")
    base = F.element_at(F.split(p, "/"), -1)
    return {"base": base, "folder": F.regexp_replace(p, r"/?[^/]*$", ""), "stem": F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), "extension": F.lower(F.regexp_extract(base, r".(\.[^.]*)$", 1))}


def output_name(template: Column, day: Column, name: Column, first: Column, last: Column, count: Column) -> Column:
    """``%date``, ``%name`` and ``%range`` filled in; the range is empty for the whole document."""
    pages = F.when((first == 1) & (last == count), "").when(first == last, F.concat(F.lit("(p"), first.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("(p"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")")))
    return F.replace(F.replace(F.replace(template, F.lit("%date"), day), F.lit("%name"), name), F.lit("%range"), pages)


# What the letters of a time pattern stand for, as Spark's date patterns.
_TIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE"}


def formatted_time(moment: Column, pattern: str) -> Column:
    """A moment in a pattern of % letters (those of ``_TIME`` and %%); ``%unix`` is its seconds with their fraction, and is filled in first. Unknown letters stay as they are."""
    seconds = F.regexp_replace((F.unix_micros(moment) / 1_000_000).cast("decimal(20,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    parts, text, i = [], "", 0
    while i < len(pattern):
        known = "%unix" if pattern.startswith("%unix", i) else pattern[i : i + 2] if pattern[i] == "%" and pattern[i + 1 : i + 2] in (*_TIME, "%") else ""
        if known in ("", "%%"):
            text += pattern[i]
            i += max(1, len(known))
            continue
        parts += [F.lit(text), seconds if known == "%unix" else F.date_format(moment, _TIME[known[1]])]
        text, i = "", i + len(known)
    return F.concat(*parts, F.lit(text))


def status(code: Column) -> Column:
    return F.when(code == 100, "text").when(code == 101, "noText").otherwise("error")


def score_label(code: Column, score: Column) -> Column:
    return F.when(code == 100, F.concat(F.lit("√ "), F.format_string("%.2f", score))).when(code == 101, "√ ----").otherwise(F.concat(F.lit("× "), code.cast("string")))


def result_title(title: Column, seconds: Column, score: Column) -> Column:
    """A title, or in its absence how long the page took and, if above zero, how sure the result is."""
    sure = F.when(score > 0, F.concat(F.lit(" | confidence "), F.format_string("%.2f", score))).otherwise("")
    return F.coalesce(title, F.concat(F.lit("time "), F.format_string("%.2f", seconds), sure))


def state_label(state: Column, done: Column, total: Column) -> Column:
    """What a run's state (run, pause, stop) means with so many tasks done; nothing before the first of a stopped run."""
    running = F.when(done < total, "running").otherwise("saving")
    stopped = F.when(done <= 0, "").when(done < total, "stopped").otherwise("finished")
    return F.when(state == "run", running).when(state == "pause", "paused").when(state == "stop", stopped).otherwise("")


def elapsed(seconds: Column) -> Column:
    """mm:ss, blank below a tenth of a second; minutes may have more than two digits."""
    minutes, rest = F.floor(seconds / 60).cast("string"), F.floor(seconds % 60).cast("string")
    return F.when(seconds < 0.1, "").otherwise(F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad(rest, 2, "0")))


def payload_text(kind: Column, data: Column) -> Column:
    """Text payloads as they are; others with their kind, in base 64 if they aren't UTF-8."""
    text = data.cast("string")
    shown = F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("[Base64]\n"), F.base64(data)))
    return F.when(kind == "Text", text).otherwise(F.concat(F.lit("type: "), kind, F.lit("\ndata: "), shown))


def quoted_lines(text: Column) -> Column:
    """Each line as a Markdown quote with a hard break."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line, F.lit("  "))), "\n")


def whole_number(x: Column) -> Column:
    """A number as text, without the fraction if that is zero."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


_INT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
_DIGITS = r"[0-9]+(_[0-9]+)*"
_FLOAT = rf"^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))\s*$"


def literal_kind(text: Column) -> Column:
    """int, float, json or string: the first that a literal can be read as.

    Digits may have single underscores between them, and inf and nan are floats. Two equal
    keys in one object aren't JSON here.
    """
    return F.when(text.rlike(_INT), "int").when(text.rlike(_FLOAT), "float").when(F.try_parse_json(text).isNotNull(), "json").otherwise("string")


def literal_values(text: Column) -> dict[str, Column]:
    """A literal's kind, and its value in the column of its kind: int_value (up to 38 digits) and int_text (any number of them, without leading zeros), float_value, json_value (normal form), string_value."""
    kind, bare = literal_kind(text), F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "_", "")
    digits = F.regexp_replace(F.regexp_replace(bare, r"^([+-]?)0+(?=[0-9])", "$1"), r"^\+|^-(?=0$)", "")
    return {"kind": kind, "int_text": F.when(kind == "int", digits), "int_value": F.when(kind == "int", bare.try_cast("decimal(38,0)")), "float_value": F.when(kind == "float", bare.try_cast("double")), "json_value": F.when(kind == "json", F.to_json(F.try_parse_json(text))), "string_value": F.when(kind == "string", text)}

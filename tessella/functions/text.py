"""Text as column expressions. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a reference to something outside the corpus.
EXTERNAL = r"(?i)^(https?:|mailto:|www)"
#: Characters that base-93 encoding passes through.
PLAIN_93 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ '()[]{}<>`!@#$%^&*_-+=,;:|.?/"


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trim_all(texts: Column) -> Column:
    """Every element of an array trimmed."""
    return F.transform(texts, trim)


def trim_map(texts: Column) -> Column:
    """Every value of a map trimmed."""
    return F.transform_values(texts, lambda _, v: trim(v))


def collapse(text: Column) -> Column:
    """Trimmed, with one blank for each run of white space."""
    return F.regexp_replace(trim(text), r"\s+", " ")


def first_chars(text: Column, n: int) -> Column:
    """The first n characters once white space is collapsed."""
    return F.substring(collapse(text), 1, n)


def words(text: Column) -> Column:
    """Lower-cased words, all but letters, digits and underscores being blanks; a leading blank gives an empty first word."""
    blank = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " ")
    return F.split(F.regexp_replace(blank, " +$", ""), " +")


def letter_words(text: Column, longest: int = 15) -> Column:
    """Lower-cased words of a-z with at most `longest` letters."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]", " "), " +"), lambda w: (F.length(w) > 0) & (F.length(w) <= longest))


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def without_repeats(text: Column) -> Column:
    """Without words that repeat the one before."""
    parts = F.split(collapse(text), " ")
    kept = F.filter(parts, lambda w, i: (i == 0) | (w != F.get(parts, i - 1)))
    return F.array_join(kept, " ")


def external(reference: Column) -> Column:
    return reference.rlike(EXTERNAL)


def split_reference(reference: Column) -> Column:
    """(file, topic, id) of file#topic/id; what is missing is empty."""
    file, rest = F.split_part(reference, F.lit("#"), F.lit(1)), F.split_part(reference, F.lit("#"), F.lit(2))
    return F.struct(file.alias("file"), F.split_part(rest, F.lit("/"), F.lit(1)).alias("topic"), F.split_part(rest, F.lit("/"), F.lit(2)).alias("id"))


def absolute_path(base: Column, relative: Column) -> Column:
    """A path relative to a file, as an absolute one: `.` and empty parts go, `..` takes the part before away."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    whole = F.when(F.startswith(relative, F.lit("/")), relative).when(relative == "", base).otherwise(F.concat(folder, relative))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def encode_blanks(url: Column) -> Column:
    return F.replace(url, F.lit(" "), F.lit("%20"))


def decode_percent(url: Column) -> Column:
    """%xx decoded as UTF-8; a plus sign stays; null if it can't be decoded."""
    return F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def name_of_title(title: Column, longest: int = 64) -> Column:
    """A file name: letters, digits and underscores, lower case, no trailing digits."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(trim(title)), r"\s+", "_"), "[^a-z0-9_]", "")
    return F.substring(F.regexp_replace(plain, "[0-9]+$", ""), 1, longest)


def name_stem(text: Column, longest: int) -> Column:
    """What unique names are made of: word characters only, no digits at the end, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]", ""), "[0-9]+$", ""), 1, longest)


def extract_date(text: Column) -> Column:
    """The first date in a text, written as 2024-01-31, 31 January 2024 or January 31, 2024."""
    month = "January|February|March|April|May|June|July|August|September|October|November|December"
    iso = F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    day_first = F.try_to_timestamp(F.regexp_extract(text, rf"(\d{{1,2}} (?:{month}) \d{{4}})", 1), F.lit("d MMMM yyyy"))
    month_first = F.try_to_timestamp(F.regexp_extract(text, rf"((?:{month}) \d{{1,2}}, \d{{4}})", 1), F.lit("MMMM d, yyyy"))
    return F.coalesce(iso, day_first, month_first).cast("date")


def guid_of(text: Column) -> Column:
    """GUID-8-4-4-4-12 of a text's MD5."""
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "GUID-$1-$2-$3-$4-$5")


def encode_93(text: Column) -> Column:
    """Characters of PLAIN_93 as they are, others as their code point; ~ stands between code points that meet."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(F.instr(F.lit(PLAIN_93), c) > 0, c).otherwise(F.concat(code_point(c).cast("string"), F.lit("~"))))
    return F.regexp_replace(F.array_join(codes, ""), "([0-9])~([^0-9]|$)", "$1$2")


def code_point(character: Column) -> Column:
    """A character's number, read from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(character, "UTF-32")), 16, 10).cast("long")


def decode_93(text: Column) -> Column:
    """The text that encode_93 was given."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+)|([^0-9~])"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), _character(p)).otherwise(p)), "")


def _character(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.conv(number, 10, 16), 8, "0")), "UTF-32")


def encode_digits(number: Column, digits: str) -> Column:
    """A whole number that is not negative, in the base that the digits' count gives (2 or more)."""
    base, most = len(digits), 64 if len(digits) == 2 else 41
    powers = F.sequence(F.lit(0), F.lit(most))
    step = F.aggregate(
        powers,
        F.struct(number.cast("decimal(38,0)").alias("left"), F.lit("").alias("out")),
        lambda s, _: F.when(
            s["left"] > 0,
            F.struct(
                F.floor(s["left"] / F.lit(base)).cast("decimal(38,0)").alias("left"),
                F.concat(F.substring(F.lit(digits), (s["left"] % F.lit(base)).cast("int") + 1, F.lit(1)), s["out"]).alias("out"),
            ),
        ).otherwise(s),
    )["out"]
    return F.when(step == "", F.lit(digits[0])).otherwise(step)


def decode_digits(text: Column, digits: str) -> Column:
    """The number that a text of the digits stands for; null if it holds anything else."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("decimal(38,0)"),
        lambda n, c: (n * F.lit(len(digits)) + F.nullif(F.instr(F.lit(digits), c), F.lit(0)) - F.lit(1)).cast("decimal(38,0)"),
    )


def hex_as_words(digits: Column, words: Column) -> Column:
    """Hex digits as words joined by underscores, 16 bits a word.

    The low 11 bits choose one of the 2,048 words (an array); the five high bits, the highest
    first, say which of its first five letters are upper case. A last block is filled up with 0.
    """
    padded = F.rpad(digits, (F.ceil(F.length(digits) / 4) * 4).cast("int"), F.lit("0"))
    blocks = F.transform(F.regexp_extract_all(padded, F.lit("([0-9a-fA-F]{4})"), F.lit(1)), lambda b: F.conv(b, 16, 10).cast("int"))

    def word(number: Column) -> Column:
        letter = lambda w, k: F.when(F.shiftright(number, 15 - k) % 2 == 1, F.upper(F.substring(w, k + 1, 1))).otherwise(F.substring(w, k + 1, 1))
        plain = F.get(words, number % 2048)
        return F.concat(*(letter(plain, k) for k in range(5)), F.substring(plain, 6, 2**31 - 1))

    return F.array_join(F.transform(blocks, word), "_")


def escape_xml(text: Column) -> Column:
    """text as the content of an element or of an attribute in double quotes."""
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def blob_sha(text: Column) -> Column:
    """The SHA-1 by which a version store names a file of this content."""
    return F.sha1(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit("\0"), text))

"""Regular expressions, word lists and the find-all function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import empty, let, row

#: Fixed patterns of the structured labels, in the order in which they are scanned.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+62|\b62|\b0)[\s.\-]?8\d{1,3}(?:[\s.\-]?\d{2,4}){2,3}\b"
SSN = r"\b\d{4}[\s.]?\d{4}[\s.]?\d{4}[\s.]?\d{4}\b"
PATTERNS = {"EMAIL": EMAIL, "PHONE": PHONE, "SSN": SSN}
#: Fixed word lists of the rule classifier.
MONTHS = "januari februari maret april mei juni juli agustus september oktober november desember".split()
PLACES = "jakarta surakarta bandung surabaya medan yogyakarta bali semarang makassar palembang depok tangerang bekasi".split()
GENDERS = "pria wanita laki-laki perempuan male female".split()
STOPWORDS = "nik hp wa ktp npwp no tlp telp email id kk jl rt rw bpjs sim".split()
#: Fixed word list of the browser profile, in the order in which it is tried.
BROWSER_GENDERS = "pria wanita perempuan laki-laki lakilaki male female".split()
#: What a text with a match of a pattern holds, in either profile: cheaper to look for than to try the pattern at each place.
NEEDED = {"EMAIL": "@", "PHONE": r"(?U)(?:62|0)[\s.\-]?8", "SSN": r"(?U)\d{4}[\s.]?\d{4}", "DATE_TIME": r"(?U)\d(?:\s|[/-]\d)"}
#: Fixed patterns of the rule classifier.
DATE = rf"\b\d{{1,2}}\s+(?:{'|'.join(MONTHS)})(?:\s+\d{{4}})?\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b"
WORD = r"\b[\w.\-]+\b"
#: The same words, but only those that begin with a capital or are of the lists. A word is what lies between the first and
#: the last letter, digit or underscore of a run of these, dots and dashes; the run's first signs are the first group.
MARKED_WORD = rf"(?<![\w.\-])([.\-]*+)((?:\p{{Lu}}[\w.\-]*|(?i:{'|'.join(PLACES + GENDERS)})(?=[.\-]*+(?![\w.\-])))\b)"
#: Fixed: characters cut from both ends of a span.
TRIM = " \t\n\r.,;:!?()[]{}\"'"
#: White space, with the four separators that Java's class leaves out.
SPACE = r"[\s\x1c-\x1f]"
MARK = "￿"


def unicode_pattern(pattern: str, ignore_case: bool = False, profile: str = "server") -> str:
    """The server profile's classes are Unicode; the browser's digits and word boundaries are ASCII."""
    return f"(?{'i' if ignore_case else ''}{'U' if profile == 'server' else ''})" * (ignore_case or profile == "server") + pattern


MATCH = "struct<start:int,end:int,text:string>"
#: Parts that one fold gathers; what a fold appends to is copied, so long texts are folded piece by piece.
FOLD = 128


def parts(text: Column, pattern: str, fence: str = f"{MARK}$0{MARK}", needed: str | None = None) -> Column:
    """array<string>: the text cut at both ends of each match, so that every second part is one. needed: a pattern that any
    text with a match has too."""
    plain = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "�")).otherwise(text)
    fenced = F.regexp_replace(plain, pattern, fence)
    return F.split(F.when(text.rlike(needed), fenced).otherwise(plain) if needed else fenced, MARK, -1)


def find_all(text: Column, pattern: str, keep=None, fence: str = f"{MARK}$0{MARK}", needed: str | None = None) -> Column:
    """array<struct<start, end, text>> of the matches from left to right; offsets count code points.

    Matches are fenced by a mark and split off, so every second part is a match and offsets are sums of lengths.
    `keep(text, start)` leaves matches out before they are gathered; `fence` puts the marks around a part of the match."""

    def gathered(some: Column, begin: Column) -> Column:
        """The matches among some parts, of which the first is none and lies at `begin`."""

        def add(a: Column, part: Column) -> Column:
            end = a["at"] + F.length(part)
            found = F.concat(a["out"], F.array(row(start=a["at"], end=end, text=part)))
            wanted = a["odd"] if keep is None else a["odd"] & keep(part, a["at"])
            return row(at=end, odd=~a["odd"], out=F.when(wanted, found).otherwise(a["out"]))

        return F.aggregate(some, row(at=begin, odd=F.lit(False), out=empty(MATCH)), add, lambda a: a["out"])

    def blocks(p: Column) -> Column:
        """Array of the parts, FOLD at a time."""
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / FOLD).cast("int")), lambda i: F.slice(p, i * FOLD + 1, FOLD))

    def starts(lengths: Column) -> Column:
        """Where each block begins: sums of the blocks before, within groups of FOLD blocks and over groups."""
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / FOLD).cast("int")), lambda i: F.slice(lengths, i * FOLD + 1, FOLD))
        return F.aggregate(groups, row(at=F.lit(0), out=empty("array<int>")), lambda a, g: let(sums(g, a["at"]), lambda r: row(
            at=F.element_at(r, -1), out=F.concat(a["out"], F.array(F.slice(r, 1, F.size(r) - 1))))), lambda a: F.flatten(a["out"]))

    def sums(lengths: Column, begin: Column) -> Column:
        return F.aggregate(lengths, F.array(begin), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def long(p: Column) -> Column:
        lengths = lambda b: F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda n, part: n + F.length(part)))
        return let(blocks(p), lambda b: F.flatten(F.zip_with(b, starts(lengths(b)), gathered)))

    whole = lambda p: F.when(F.size(p) < 2, empty(MATCH)).when(F.size(p) <= 2 * FOLD, gathered(p, F.lit(0))).otherwise(long(p))
    return let(parts(text, pattern, fence, needed), whole)


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def all_space(text: Column) -> Column:
    """Whether a string is white space only (an empty one is)."""
    return ~not_blank(text)

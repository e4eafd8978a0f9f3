"""Line-first quality rules, in SQL functions only.

Every line of a text is judged by itself; lines that fail are removed, and a document that loses too much of its text,
or that fails the document's base rule, is rejected.  Lines without a word never fail.

Line rules, for a line with w words:
- symbols: at least ``LINE_SHARE`` * w symbols ``#*$%&|<>``, or at least ``LINE_SHARE`` * w runs of ``!!`` or ``??``;
- stutter: of eight words or more, at least ``LINE_SHARE`` * w equal the word before them;
- navigation: at most 25 words, and at least two separators ``»``, ``›``, ``•`` or ``·``;
- boilerplate: at most 25 words, and one of ``BOILERPLATE`` in it.

A line that passes these, has at most 25 words and doesn't end in a sentence mark (closing quotes and brackets may follow)
is open; lines with letters of scripts that don't end sentences with marks never are.  Open lines fail by their company:
- punctuation: the text has at least ``OPEN_LINES`` open lines, and they are half or more of its lines with a word, so
  that headings and single lines survive;
- navigation: the line is one of at least ``MENU_RUN`` open lines in succession of at most ``MENU_WORDS`` words each.

Null text counts as empty: no words, base rule failed.  Nothing is shuffled; rows are independent, so repeated rows
get equal results and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import unused

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_WHITE = r"\x20\x09-\x0D"
SYMBOLS, SEPARATORS = "#*$%&|<>", "»›•·"
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
LINE_SHARE, MOST_LOST, SHORT_LINE = 0.3, 0.3, 25
OPEN_LINES, MENU_RUN, MENU_WORDS = 5, 4, 3
#: Ends of a sentence, what may close after them, and scripts without such marks (Thai to Burmese, Khmer).
ENDS, CLOSERS, UNMARKED = ".!?…:;。！？：；।؟۔", "\"'”’»)\\]）」』", r"\x{0E00}-\x{109F}\x{1780}-\x{17FF}"
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept all cookies", "we use cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "click here to", "sign up for our newsletter", "subscribe to our newsletter",
    "skip to content", "back to top", "share on facebook", "share on twitter", "powered by wordpress",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often and however deep ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of ``window`` words (a power of two) that occur at least twice.  Windows are
    compared by 64-bit hash, made by doubling: hashes of 1, 2, 4, ... words.  With the sort of (hash, place) the cost is
    near-linear in the text, whatever its length and whatever repeats in it."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])))
        return let(twice, lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - v, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    def windows(hashes: Column, width: int) -> Column:
        if width == window:
            return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
        later = lambda h: F.slice(h, width + 1, F.size(h) - width)
        return let(hashes, lambda h: windows(F.zip_with(F.slice(h, 1, F.size(h) - width), later(h), lambda x, y: F.xxhash64(x, y)), 2 * width))

    return F.when(F.size(tokens) <= window, 0).otherwise(windows(F.transform(tokens, lambda w: F.xxhash64(w)), 1))


def stutters(text: Column) -> Column:
    """How many words equal the word after them."""
    return F.regexp_count(text, F.lit(rf"(?<![^{_WHITE}])([^{_WHITE}]++)(?=[{_WHITE}]++\1(?![^{_WHITE}]))"))


def line_kind(line: Column) -> Column:
    """Of a line by itself: 0 without a word, 1 failed, 2 passed, 3 open, 4 open and of at most ``MENU_WORDS`` words."""
    marks = F.greatest(symbols(line), F.regexp_count(line, F.lit(r"!!+|\?\?+")))
    signs = line.rlike(rf"[{SYMBOLS}]|!!|\?\?")
    separators = F.regexp_count(line, F.lit(f"[{SEPARATORS}]"))
    furniture = let(F.lower(line), lambda low: reduce(or_, (F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE)))
    closed = line.rlike(rf"[{ENDS}][{CLOSERS}]*+[{_WHITE}]*+\z|[{UNMARKED}]")
    fails = lambda n: (signs & (marks >= LINE_SHARE * n)) | ((n <= SHORT_LINE) & ((separators >= 2) | furniture)) | ((n >= 8) & (stutters(line) >= LINE_SHARE * n))
    return let(F.regexp_count(line, F.lit(WORD)), lambda n: F.when(n == 0, 0).when(fails(n), 1).when((n > SHORT_LINE) | closed, 2).when(n > MENU_WORDS, 3).otherwise(4))


def passed_lines(lines: Column) -> Column:
    """The lines that pass, in order."""

    def outside_menus(marked: Column) -> Column:
        menu = lambda k: F.coalesce(F.get(marked, k)["kind"] == 4, F.lit(False))
        starts = F.transform(marked, lambda x, i: reduce(and_, (menu(i + k) for k in range(MENU_RUN))))
        inside = lambda run, i: reduce(or_, (F.coalesce(F.get(run, i - k), F.lit(False)) for k in range(MENU_RUN)))
        return let(starts, lambda run: F.filter(marked, lambda x, i: (x["kind"] != 1) & ~inside(run, i)))

    def by_company(marked: Column) -> Column:
        count = lambda least: F.size(F.filter(marked, lambda x: x["kind"] >= least))
        crowd = lambda opened: (opened >= OPEN_LINES) & (2 * opened >= count(1))
        alone = F.filter(marked, lambda x: x["kind"] != 1)
        return let(count(3), lambda opened: F.when(opened < MENU_RUN, alone).when(crowd(opened), F.filter(marked, lambda x: ~x["kind"].isin(1, 3, 4))).when(count(4) < MENU_RUN, alone).otherwise(outside_menus(marked)))

    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), line_kind(x).alias("kind")))
    return F.transform(let(marked, by_company), lambda x: x["line"])


def judge(df: DataFrame, text_col: str = "text", cleaned_col: str = "cleaned") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, lost_share (double:
    removed code points of all of them, 0 for an empty text), kept, and ``cleaned_col``: the text without its failed
    lines.  Columns of ``df`` with these names are replaced; all others stay, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: x.rlike(WORD))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).cast("long").alias("repeated")))
    parted = let(passed_lines(lines), lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.greatest(F.size(k) - 1, F.lit(0)).alias("breaks")))
    lost = let(parted, lambda k: F.struct(k["text"].alias("text"), (F.length(text) - F.size(lines) + 1 - F.length(k["text"]) + k["breaks"]).alias("lost")))
    facts = F.struct(
        counted.alias("counted"), symbols(text).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.length(text).alias("length"),
        lost.alias("lines"),
    )
    facts_col, new = unused(df, "facts"), {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept", cleaned_col}
    f = F.col(facts_col)
    failed = (f["counted"]["n"] < LEAST_WORDS) | (100 * f["counted"]["repeated"] > MOST_REPEATED * f["counted"]["n"])
    share = F.when(f["length"] == 0, 0.0).otherwise(f["lines"]["lost"] / f["length"])
    # generated, so that a filter on the verdict doesn't compute the facts a second time
    return df.select("*", F.explode_outer(F.array(facts)).alias(facts_col)).select(
        *(F.col(f"`{c}`") for c in df.columns if c not in new), f["counted"]["n"].alias("n_words"), f["counted"]["chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"), f["n_dup_lines"].alias("n_dup_lines"),
        f["counted"]["repeated"].alias("n_repeat_words"), share.alias("lost_share"), f["lines"]["text"].alias(cleaned_col), failed.alias("base_failed"), (~failed & (share <= MOST_LOST)).alias("kept"),
    )

"""Text functions of recognised lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

LATIN = "A-Za-z0-9"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _escaped(chars: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in chars)


def is_latin_alnum(c: Column | str) -> Column:
    return col(c).rlike(f"^[{LATIN}]$")


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike(f"[{C.CJK_CLASS}]")


def cjk_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), f"[^{C.CJK_CLASS}]", ""))


def no_spaces(c: Column | str) -> Column:
    """Without U+0020 only."""
    return F.replace(col(c), F.lit(" "), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def pangu_spacing(c: Column | str, cjk: str = C.CJK_CLASS, latin: str = LATIN) -> Column:
    """One space between a CJK and a latin character on either side; runs of spaces become one."""
    there = F.regexp_replace(col(c), f"([{cjk}])([{latin}])", "$1 $2")
    back = F.regexp_replace(there, f"([{latin}])([{cjk}])", "$1 $2")
    return F.regexp_replace(back, " {2,}", " ")


def fix_trailing_degree(c: Column | str, mark: str = "°", full_stop: str = "。") -> Column:
    """A final mark that follows no digit is a full stop."""
    x = col(c)
    body = F.regexp_replace(F.left(x, F.length(x) - 1), r"(?U)\s+$", "")
    wrong = x.endswith(mark) & (F.length(x) >= 2) & ~F.substring(F.left(x, F.length(x) - 1), -1, 1).rlike(r"(?U)\d")
    return F.when(wrong, F.concat(body, F.lit(full_stop))).otherwise(x)


def fix_confusions(c: Column | str, pairs=C.CONFUSIONS) -> Column:
    out = col(c)
    for wrong, right in pairs:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def normalize_bullet(c: Column | str, bullets: str = C.BULLETS) -> Column:
    x = col(c)
    dotted = F.regexp_replace(x, rf"(?U)^[{_escaped(bullets)}]\s?", "• ")
    return F.when(x.rlike(f"^[{_escaped(bullets)}]"), dotted).otherwise(F.regexp_replace(x, "^•(?=[^ ])", "• "))


def fold_punct(c: Column | str) -> Column:
    return F.translate(col(c), C.FOLD_FROM, C.FOLD_TO)


def is_pure_latin(c: Column | str) -> Column:
    return ~col(c).rlike(f"[{C.WIDE_CLASS}]")


def text_width_em(c: Column | str) -> Column:
    """Width in em: wide characters 1, spaces 0.33, others 0.52."""
    x = col(c)
    wide = F.length(F.regexp_replace(x, f"[^{C.WIDE_CLASS}]", ""))
    space = F.length(F.regexp_replace(x, "[^ ]", ""))
    return wide * F.lit(C.EM_WIDE) + space * F.lit(C.EM_SPACE) + (F.length(x) - wide - space) * F.lit(C.EM_LATIN)


def latin_ink_ratio(c: Column | str) -> Column:
    """Ink height over em of the letters that appear."""
    x = col(c)
    tall = x.rlike(rf"[\p{{Lu}}\p{{Nd}}{_escaped(C.ASCENDERS)}]")
    deep = x.rlike(f"[{_escaped(C.DESCENDERS)}]")
    zero = F.lit(0.0)
    return F.lit(C.LATIN_BASE) + F.when(tall, C.LATIN_ASC).otherwise(zero) + F.when(deep, C.LATIN_DESC).otherwise(zero)


def renderable_text(c: Column | str) -> Column:
    """Only the characters that a template face can draw, stripped."""
    return F.trim(F.regexp_replace(col(c), r"[^\x20-\x7E\x{2E80}-\x{9FFF}\x{3000}-\x{30FF}\x{FF00}-\x{FFEF}]", ""))


def latin_font(pt: Column | str, regular: str = "Arial", narrow: str = "Arial Narrow") -> Column:
    return F.when(col(pt) >= C.NARROW_PT, narrow).otherwise(regular)


def has_superscript_mark(c: Column | str) -> Column:
    return col(c).rlike(r"\[\^?\d+\]$")


def is_word_char(c: Column | str) -> Column:
    return col(c).rlike(rf"^(?U)[\p{{L}}\p{{N}}{C.WIDE_CLASS}]$")


def ngrams(c: Column | str, sizes: tuple[int, ...] = (2, 3, 4), run_class: str = C.VOCAB_CLASS) -> Column:
    """All n-grams of the maximal runs of one character class, as an array."""
    runs = F.regexp_extract_all(col(c), F.lit(f"([{run_class}]+)"), F.lit(1))

    def grams(run: Column) -> Column:
        return F.concat(*[F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in sizes])

    return F.flatten(F.transform(runs, grams))


def split_text_runs(text: Column | str, runs: Column | str) -> Column:
    """Pieces (text, rgb) of a line for runs (n, rgb) that count its characters without spaces.

    Spaces go to the piece that is open, characters beyond the counts to the last one; null where
    the text has fewer characters than the runs count.
    """
    x, r = col(text), col(runs)
    total = F.aggregate(r, F.lit(0), lambda a, b: a + b["n"])
    before = F.transform(r, lambda e, i: F.aggregate(F.slice(r, F.lit(1), i), F.lit(0), lambda a, b: a + b["n"]))

    def start(words: Column, n: Column) -> Column:
        """Where the character after n that are no spaces stands, word by word."""
        state = lambda left, at: F.struct(left.cast("int").alias("left"), at.cast("int").alias("at"))
        whole = lambda s, w: state(s["left"] - F.length(w), s["at"] + F.length(w) + 1)
        step = lambda s, w: F.when(s["left"] < 0, s).when(s["left"] >= F.length(w), whole(s, w)).otherwise(state(F.lit(-1), s["at"] + s["left"]))
        return F.aggregate(words, state(n, F.lit(1)), step, lambda s: F.when(s["left"] < 0, s["at"]).otherwise(F.length(x) + 1))

    starts = _let(F.split(x, " "), lambda words: F.transform(before, lambda n, i: F.when(i == 0, 1).otherwise(start(words, n))))
    piece = lambda at: F.transform(r, lambda e, i: F.struct(F.substr(x, F.get(at, i), F.coalesce(F.get(at, i + 1), F.length(x) + 1) - F.get(at, i)).alias("text"), e["rgb"].alias("rgb")))
    return F.when(F.length(no_spaces(x)) >= total, F.filter(_let(starts, piece), lambda p: p["text"] != ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def mark_superscript(pieces: Column | str, n_tail: Column | int) -> Column:
    """Pieces (text, rgb) with the last ``n_tail`` characters raised: (text, rgb, raised)."""
    n = F.lit(n_tail) if isinstance(n_tail, int) else n_tail
    return _let(col(pieces), lambda p: _raise_tail(p, n))


def _raise_tail(p: Column, n: Column) -> Column:
    total = F.aggregate(p, F.lit(0), lambda a, b: a + F.length(b["text"]))
    start = lambda i: F.aggregate(F.slice(p, F.lit(1), i), F.lit(0), lambda a, b: a + F.length(b["text"]))
    keep = lambda e, i: F.greatest(F.lit(0), F.least(F.length(e["text"]), total - n - start(i)))
    both = F.transform(
        p,
        lambda e, i: F.array(
            F.struct(F.left(e["text"], keep(e, i)).alias("text"), e["rgb"].alias("rgb"), F.lit(False).alias("raised")),
            F.struct(F.substr(e["text"], keep(e, i) + 1).alias("text"), e["rgb"].alias("rgb"), F.lit(True).alias("raised")),
        ),
    )
    return F.filter(F.flatten(both), lambda e: e["text"] != "")

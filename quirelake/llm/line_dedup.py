"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near when their words differ by at most one edit: a word inserted, deleted or
replaced. A line goes when an equal or a near line stands earlier (smaller document id, or
the same document and an earlier line); lines are judged on the input.

1. Lines are hashed and reduced to distinct lines with their earliest place.
2. An edit leaves one half of the words as they are. Lines that share no half with another
   line can't be near one, so only the others, a small part, go on. This loses nothing.
3. Deletion neighbourhood: a line of n words emits n variants, each without one word, as
   hashed keys. Equal variants of the same place and length are a replaced word; a variant
   that equals a whole line is an inserted or deleted one.
4. Each line meets the earliest line of its key alone, never all pairs; the edit distance is
   verified on the words, and the earliest line stays.

Minima are aggregated before every shuffle, so a line of any frequency is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage

MIN_WORDS = 5
_BLANKS = r"[\t\x0B\f\r ]{2,}|[\t\x0B\f\r]"


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, _BLANKS, " "))


def _half_keys(text: Column, n: Column, base: Column) -> list[Column]:
    """Keys of the first and second half of ``base`` words; text has base or base + 1 words."""
    half = F.floor(base / 2).cast("int")
    return [
        F.xxhash64(F.lit(0), base, F.call_function("substring_index", text, F.lit(" "), half)),
        F.xxhash64(F.lit(1), base, F.call_function("substring_index", text, F.lit(" "), -(base - half))),
    ]


def _without(words: Column, i: Column) -> Column:
    return F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, text and rk, rq: a key of 128 bits of id and text, so that null ids join too."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_keys(id_col, text_col))


def _keys(id_col: str, text_col: str) -> list[Column]:
    known = F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col)
    return [F.xxhash64(*known).alias("rk"), F.xxhash64(F.lit(3), *known).alias("rq")]


def _later_lines(stage: Stage, base: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """Hashes (h1, h2) of the distinct lines that have an earlier near line."""
    long = distinct.where(F.col("n") >= min_words)
    keys = F.array("kp", "ks", *[F.when(F.col("n") > min_words, F.col(c)) for c in ("lp", "ls")])
    keyed = long.select("h1", "h2", F.explode(F.array_compact(keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    near = stage.cut(keyed.join(shared, "key", "left_semi").select("h1", "h2").distinct(), "half-shared")
    first = long.join(near, ["h1", "h2"]).select("h1", "h2", "n", F.col("first.id").alias("id"), F.col("first.rk").alias("rk"), F.col("first.rq").alias("rq"), F.col("first.pos").alias("pos"))
    # the words of these lines, from the texts of their earliest places
    lines = F.transform(F.col("at"), lambda a: F.struct(a["h1"].alias("h1"), a["h2"].alias("h2"), a["n"].alias("n"), a["pos"].alias("pos"), F.get(F.col("lines"), a["pos"]).alias("line")))
    at = first.groupBy("rk", "rq").agg(F.collect_list(F.struct("h1", "h2", "n", "pos")).alias("at"))
    texts = base.join(at, ["rk", "rq"]).select("id", "rk", "rq", "at", F.split("text", "\n").alias("lines"))
    found = texts.select("id", "rk", "rq", F.inline(lines)).dropDuplicates(["h1", "h2"])
    found = stage.cut(found.select("h1", "h2", "n", F.struct("id", "rk", "rq", "pos").alias("first"), F.split(_plain(F.col("line")), " ").alias("words")), "near-lines")

    # one line is one row until its words are exploded where its window is
    word = found.select("h1", "h2", "n", "words").repartition("h1", "h2").select("h1", "h2", "n", F.posexplode("words").alias("i", "w"))
    here, left = F.xxhash64("w", "i"), F.xxhash64("w", F.col("i") - 1)
    line = Window.partitionBy("h1", "h2")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    # the hash of a line is the xor of its words' hashes with their places; a variant takes the
    # words before the deleted one as they stand and those after it one place to the left
    word = word.withColumn("whole", F.bit_xor(here).over(line)).withColumn("moved", F.bit_xor(left).over(line))
    gap = F.coalesce(F.bit_xor(here.bitwiseXOR(left)).over(before), F.lit(0))
    word = word.withColumn("v", F.col("moved").bitwiseXOR(gap).bitwiseXOR(left))
    word = word.select("h1", "h2", "i", F.xxhash64("v", "i", "n").alias("k"), F.xxhash64("v", F.col("n") - 1).alias("d"), F.when(F.col("i") == 0, F.xxhash64("whole", "n")).alias("f"))
    variants = stage.cut(word, "variants")

    places = found.select("h1", "h2", "first")
    same = variants.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    same = stage.cut(variants.select("k", "h1", "h2", "i").join(same, "k", "left_semi").join(places, ["h1", "h2"]), "same")
    earliest = same.groupBy("k").agg(F.min(F.struct("first", "h1", "h2")).alias("e"))
    replaced = same.join(earliest, "k").where(F.col("first") > F.col("e.first"))
    replaced = replaced.select("h1", "h2", F.col("e.h1").alias("g1"), F.col("e.h2").alias("g2"), F.col("i").alias("ix"), F.col("i").alias("iy"))
    whole = variants.where("f IS NOT NULL").select(F.col("f").alias("d"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    edits = variants.select("d", "h1", "h2", "i").join(whole, "d").join(places, ["h1", "h2"])
    edits = stage.cut(edits.join(places.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("first").alias("wf")), ["w1", "w2"]), "edits")
    none = F.lit(None).cast("int")
    inserted = edits.where(F.col("wf") < F.col("first")).select("h1", "h2", F.col("w1").alias("g1"), F.col("w2").alias("g2"), F.col("i").alias("ix"), none.alias("iy"))
    deleted = edits.where(F.col("first") < F.col("wf")).groupBy("w1", "w2").agg(F.min(F.struct("first", "h1", "h2", "i")).alias("e"))
    deleted = deleted.select(F.col("w1").alias("h1"), F.col("w2").alias("h2"), F.col("e.h1").alias("g1"), F.col("e.h2").alias("g2"), none.alias("ix"), F.col("e.i").alias("iy"))
    pairs = replaced.unionByName(inserted).unionByName(deleted)
    x = found.select("h1", "h2", F.col("words").alias("x"))
    y = found.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("y"))
    both = pairs.join(x, ["h1", "h2"]).join(y, ["g1", "g2"])
    part = lambda w, i: F.when(F.col(i).isNull(), F.col(w)).otherwise(_without(F.col(w), F.col(i)))
    return stage.cut(both.where(part("x", "ix") == part("y", "iy")).select("h1", "h2").distinct(), "later")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """Documents with ``text_col`` reduced to the lines that stay, and with ``counts`` the columns
    n_lines and n_removed added.

    Lines end at \\n; words are runs without ASCII blanks. Near lines count from ``min_words``
    words in both; shorter lines go only when an equal line stands earlier. Defined cases: blank
    lines are kept and never compared; a null text stays null and has no lines; a null id comes
    first; rows with equal ids are ordered by a hash of their text, and rows equal in both get
    the same result; other columns are kept, but with ``counts`` n_lines and n_removed are replaced.
    """
    stage = Stage(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed") if counts else docs
    base = _rows(docs, id_col, text_col)
    # most texts hold single spaces only, and a search for anything else is cheaper than a pattern
    odd = F.lit(False)
    for blank in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains("text", F.lit(blank))
    even = base.withColumn("text", F.when(odd, F.regexp_replace("text", _BLANKS, " ")).otherwise(F.col("text")))
    lines = even.select("id", "rk", "rq", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("p", F.trim("line")).where("p <> ''")
    n = (F.octet_length("p") - F.octet_length(F.replace(F.col("p"), F.lit(" "), F.lit(""))) + 1).cast("int")
    lines = lines.withColumn("n", n)
    kp, ks = _half_keys(F.col("p"), F.col("n"), F.col("n"))
    lp, ls = _half_keys(F.col("p"), F.col("n"), F.col("n") - 1)
    hashed = lines.select("id", "rk", "rq", "pos", "n", F.xxhash64("p").alias("h1"), F.xxhash64(F.lit(7), "p").alias("h2"), kp.alias("kp"), ks.alias("ks"), lp.alias("lp"), ls.alias("ls"))
    distinct = stage.cut(hashed.groupBy("h1", "h2", "n", "kp", "ks", "lp", "ls").agg(F.min(F.struct("id", "rk", "rq", "pos")).alias("first")), "distinct")
    later = _later_lines(stage, base, distinct, min_words)

    stay = distinct.select("h1", "h2", "first").join(later, ["h1", "h2"], "left_anti").select("first.rk", "first.rq", "first.pos")
    at = F.array_sort(F.collect_list("pos"))
    stay = stay.groupBy("rk", "rq").agg(at.alias("__at"))
    # one character a line, up to the last that stays
    gaps = F.transform("__at", lambda p, k: F.concat(F.repeat(F.lit("0"), (p - F.coalesce(F.get(F.col("__at"), k - 1), F.lit(-1)) - 1).cast("int")), F.lit("1")))
    stay = stay.select(F.col("rk").alias("__rk"), F.col("rq").alias("__rq"), F.array_join(gaps, "").alias("__bits"))
    rk, rq = _keys(id_col, text_col)
    held = docs.withColumns({"__rk": rk, "__rq": rq}).join(stay, ["__rk", "__rq"], "left")
    blank = lambda s: F.trim(F.translate(s, "\t\x0b\f\r", "    ")) == ""
    split = F.split(text_col, "\n")
    kept = F.zip_with(split, F.split(F.coalesce("__bits", F.lit("")), ""), lambda s, b: F.when(s.isNotNull() & ((b == "1") | blank(s)), s))
    held = held.withColumn("__kept", F.array_compact(kept))
    n_of = lambda n, name: F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long").alias(name)
    added = [n_of(F.size(split), "n_lines"), n_of(F.size(split) - F.size("__kept"), "n_removed")] if counts else []
    return held.select(*[(F.array_join("__kept", "\n") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns], *added)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the lines that stay, joined by \\n."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

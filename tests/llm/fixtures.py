"""Small tables with the awkward cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, or add.
CLASH = {"id": "1", "found": "2", "rep": "3", "comp": "4", "key": "5", "n": "6", "h1": "7", "score": "8", "mix_slot": "9", "component_id": "10", "chunk": "11", "th": "12"}


def words(rng: random.Random, n: int, vocab: int = 300) -> list[str]:
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [" ".join(words(rng, rng.randrange(3, 30))) for _ in range(rng.randrange(1, 6))]
        rows.append([i, "\n".join(lines)])
    for i in range(n, n + 20):  # copies with an edit or none
        w = rows[rng.randrange(n)][1].split(" ")
        if i % 3:
            w[rng.randrange(len(w))] = "edited"
        rows.append([i, " ".join(w)])
    rows += [[200, None], [201, ""], [202, "  \n\t "], [203, "one"], [204, "one"], [205, "Ünïcode ß wörds 漢字"], [206, "a b c d"], [207, "A b  c\td"]]
    rows.append([208, " ".join(words(rng, 30000, 5000))])  # very long, one line
    rows.append([209, rows[3][1] + "\n" + rows[3][1]])  # repeats itself
    rows.append([rows[5][0], rows[5][1]])  # a repeated row
    rows.append([None, "a row without an id but with words in it"])
    return [(i, t, "en", f"s{k % 3}" if k % 7 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df

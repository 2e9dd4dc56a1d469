"""Small document tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, __row string, `key` string"


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    words = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(40)]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = line(70)
    rows = []
    for i in range(n):
        text = line(rnd.randint(0, 90))
        if i % 6 == 0:
            text += f" {passage} {line(3)}"
        if i % 9 == 0 and rows:
            text = rows[rnd.randrange(len(rows))][1] or ""
        if i % 14 == 0:
            text = text.upper()
        if i % 15 == 7:
            text = (text + " tail").replace("w1 ", "w2 ", 1)
        rows.append((i, text, "en", f"s{i % 3}" if i % 4 else "s0", len(text), i, "x", None))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", None, None, 0, 1, "a", "b"), (n + 2, " \n\t ", "en", "s1", 4, 0, "", "")]
    rows += [(n + 3, line(20000), "en", "s2", 1, 1, "", ""), (n + 4, line(20000).replace(" ", "") , "en", "s2", 1, 1, "", "")]
    rows += [rows[3], rows[3], (None, "no id here at all", "en", "s1", 3, 3, "", "")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)

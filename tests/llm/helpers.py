"""Documents with every awkward case, for all operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: The same with extra columns whose names the operators use themselves.
CLASHING = SCHEMA + ", kept boolean, size bigint, n_words string, fp string, root int, m_ string, c0_ string, c1_ int, rid_ string, value int, bucket int"


def awkward(n: int = 60, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "an", "Übung", "çela", "ion", "ther", "a", "edly", "token", "x1", "naïve", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) + r.choice(["", "", ".", "\n"]) for _ in range(r.randrange(1, 200)))
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(text)))
    rows += [(1000, None, "en", "a", None), (1001, "", None, None, 0), (1002, " \t\n ", "en", "b", 4), (None, "no id here at all", "en", "a", 17)]
    rows += [rows[3], rows[3], (2000, rows[3][1], "en", "a", rows[3][4]), (None, None, None, None, None)]
    rows.append((3000, "lorem ipsum " * 6000, "en", "a", 72000))
    for i, text in enumerate(["alpha one\r\nbeta two\r\nalpha one\r\n", " alpha\nbeta\n alpha", "alpha \nbeta\nalpha \n", "\talpha\n\talpha", "b a\x0bc\x0c\n a"]):
        rows.append((3100 + i, text, "en", "b", len(text)))
    rows.append((3001, "x" * 50000, "en", "a", 50000))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clashing(spark, rows):
    return spark.createDataFrame([(*r, True, 1, "w", "f", 2, "m", "c", 3, "r", 4, 5) for r in rows], CLASHING).repartition(2)


def registered(spark, tmp_path, rows, table="documents"):
    """A folder that a query can read its table from."""
    frame(spark, rows).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)

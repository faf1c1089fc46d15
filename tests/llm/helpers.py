"""Small tables for the text operators: nulls, empty, long and repeated texts, clashing columns."""
import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, rank int, run string, node long, place double"


def table(spark, rows, parts=3):
    """rows: (doc_id, text[, lang[, source]]); the further columns clash with internal names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
             None if r[1] is None else len(r[1]), 1, None, 7, None) for r in rows]
    return spark.createDataFrame(full, DDL).repartition(parts)


def prose(seed, words, vocabulary=300):
    r = random.Random(seed)
    return " ".join("w%dx" % r.randrange(vocabulary) for _ in range(words))


EDGES = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "a"), (None, "no id " * 30), (9005, "é" * 50),
         (9006, "😀 中文 ñandú"), (9007, "x" * 30000), (9008, "same text here"), (9008, "same text here")]

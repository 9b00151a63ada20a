"""Small fixtures shared by the tests of tallywright.llm."""

import random
import re

from tallywright.llm import textbatch

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, rows):
    """rows of (doc_id, text) or longer, with an extra column that clashes with result names."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
    from pyspark.sql import functions as F

    return spark.createDataFrame(full, SCHEMA).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(7)).withColumn("node", F.lit("x"))


def odd_rows(start: int = 10_000, long_words: int = 200_000):
    """Null and empty texts, white space, a null id, a text longer than a chunk (1 MB) and repeated rows."""
    long = " ".join(words(99, long_words, 5_000))
    assert long_words < 200_000 or len(long) > textbatch.CHUNK
    return [(start, None), (start + 1, ""), (start + 2, " \n\t "), (None, "some text without an id " * 12), (start + 3, long), (start + 4, "same row twice here"), (start + 4, "same row twice here"), (start + 5, "É!? ¿ñ— 中文 字")]

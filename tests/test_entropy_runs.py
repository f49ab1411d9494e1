import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wirelore.functions import text


def plain_entropy(s):
    return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values())


def test_entropy_equals_counted_characters(spark):
    rng = random.Random(5)
    alphabet = "aAbB01 .\n\r\t\\$\0éé中\U0001f600\U0001f601\U00010000￿"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(200)]
    texts += ["a", "\n\n", "\U0001f600" * 2, "\U0001f600\U0001f601" * 3, "a" * 300_000 + "b" * 100_000, "é" * 9]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", text.string_entropy(F.col("s")).alias("e"))
    for i, entropy in rows.collect():
        assert entropy == pytest.approx(plain_entropy(texts[i]), abs=1e-9), texts[i][:80]


def test_payload_entropy_over_all_bytes(spark):
    rng = random.Random(6)
    payloads = [bytes(range(256)), b"\x00" * 50, *(rng.randbytes(rng.randint(1, 3000)) for _ in range(30))]
    rows = spark.createDataFrame([(i, p.hex()) for i, p in enumerate(payloads)], "i int, h string").select("i", text.payload_entropy(F.col("h")).alias("e"))
    for i, entropy in rows.collect():
        assert entropy == pytest.approx(plain_entropy(payloads[i]), abs=1e-4)

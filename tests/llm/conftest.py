import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text[, lang, source]) rows as a documents table with clashing extra columns."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("node", "bucket", "key", "kept", "size", "row", "score", "class_id", "line", "pid", "lid"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


def prose(rng, n, words=None):
    """n words of invented prose."""
    parts = "an be ro ti ka lu mes vor qui zan der pol ith ost ung el".split()
    vocabulary = words or ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))

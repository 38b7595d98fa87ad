import random

import pytest

SYLLABLES = "the of and to in a is that er on an re nd ou ea ti es or te ed".split()


def words(rnd, n):
    return ["".join(rnd.choices(SYLLABLES, k=rnd.choice([1, 1, 2, 3]))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): plain texts, copies, near copies, shared passages, and odd rows."""
    rnd = random.Random(11)
    texts = [" ".join(words(rnd, rnd.choice([0, 1, 2, 5, 30, 80, 200]))) for _ in range(60)]
    passage = " ".join(words(rnd, 45))
    for i in range(8):
        texts.append(" ".join(words(rnd, 20)) + "\n" + passage + "\t" + " ".join(words(rnd, i)))
    base = words(rnd, 300)
    for i in range(12):
        near = list(base)
        near[rnd.randrange(300)] = "changed"
        texts.append(" ".join(near))
    texts += [texts[3]] * 6 + ["", "   ", None, None, "x", "A b  c", "one\n\ntwo\n", "loop the loop " * 40, "Größe ñandú 日本語 😀 \x00 ﬁ", " ".join(words(rnd, 5000)), "#$% & <a|b>" * 30, "y" * 3000]
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append((7, texts[7], "en", "s2", 1))  # a repeated row id
    rows.append((None, texts[9], None, None, None))  # no id
    rnd.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that operators use inside; a table may have columns of the same names.
CLASH = ["id", "text_", "fp", "n", "t", "key", "word", "rules", "_w", "size", "pattern", "held", "passes", "tokens_", "_t", "_n", "_len", "uid", "row", "digest", "z", "whole", "starts", "target", "pass", "n_words", "tokens", "decoded", "pos", "h", "component", "rep", "links"]


@pytest.fixture(scope="session")
def crowded(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(-1) for c in CLASH})

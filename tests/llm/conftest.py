import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with copies, near copies, shared passages and lines, nulls, odd white space and a long text."""
    rng = random.Random(5)
    word = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8)))
    text = lambda n, alphabet="abcdefgh": " ".join(word(alphabet) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    line = "A line that many documents share, word for word."
    passage = text(70, "ijklmnop")
    rows = []
    for i in range(60):
        body = text(rng.randint(0, 120))
        if i % 4 == 0:
            body = f"{text(20)}\n  {line.upper() if i % 8 else line}\t\n{body}"
        if i % 5 == 0:
            body += f" {passage} {text(10)}"
        if i % 9 == 8:
            body = rows[i - 1][1]
        if i % 9 == 7 and rows[i - 2][1]:
            words = rows[i - 2][1].split(" ")
            if len(words) > 40:
                words[3] = "changed"
            body = " ".join(words)
        rows.append((i * 3, body, rng.choice(["en", "fr"]), "s", len(body)))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, " \n\t ", "en", "s", 4), (503, "one", "en", "s", 3)]
    rows += [(504, "Ünïcode éé ß\n" * 30 + "日本語 " * 80, "en", "s", 0), (505, "ab" * 3000, "en", "s", 6000), (506, text(6000), "en", "s", 0)]
    rows += [(507, rows[0][1], "en", "s", 0), (508, rows[0][1], "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def plain(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def odd(docs):
    """Repeated rows, null ids and extra columns whose names clash with operator columns."""
    import pyspark.sql.functions as F

    out = docs.unionByName(docs.where("doc_id in (0, 3, 500)")).unionByName(docs.where("doc_id = 15").withColumn("doc_id", F.lit(None).cast("long")))
    names = "n_lines n_removed start h pos hot score held_out component_id rep n t1 _gone_id grp ids range head kept".split()
    return out.withColumns({n: F.lit("clash") for n in names})

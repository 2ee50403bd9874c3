import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, personal data and control strings."""
    r = random.Random(11)
    vocab = ["w" + "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(400)]
    base = [r.choice(vocab) for _ in range(120)]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (None, "no id here at all", "en", None, 17), (4, "one", "en", "s", 3), (5, "ONE", "en", "s", 3)]
    for i in range(10, 22):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(len(own))] = r.choice(vocab)
        rows.append((i, " ".join(own), "en", "hot", 1))
    rows += [(i, " ".join(base), "en", "hot", 1) for i in range(30, 60)]
    rows += [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 300))), "de", f"s{i % 3}", 9) for i in range(100, 160)]
    rows += [(200, "x" * 300_000, "en", "s", 1), (201, " ".join(r.choice(vocab) for _ in range(40_000)), "en", "s", 1), (202, "1" * 60_000 + " " + "1 " * 30_000, "en", "s", 1)]
    rows += [(300, "mail a.b%x@d-e.example.org now, ip 10.0.0.255 and 1.2.3.400, card 4111 1111 1111 1111, call +1 (017) 555-7713.", "en", "s", 1), (301, "a@b.c%x@d.e 1.2.3.4.5.6.7.8 +12 4111-1111-1111-1112", "en", "s", 1)]
    rows += [(310, "same", "en", "s", 4)] * 3
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_docs):
    return spark.createDataFrame(odd_docs, DOCS).cache()


@pytest.fixture(scope="session")
def crowded(odd):
    """With columns that are named like what operators make."""
    from pyspark.sql import functions as F

    names = ["n", "h", "row", "key", "rank", "size", "found", "spans", "host", "line", "sid", "rep", "root", "class", "kind", "start", "end", "words", "source_size"]
    return odd.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

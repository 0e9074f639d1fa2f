import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that share names with what operators use inside, and with what they return.
CLASHING = ("digest", "salt", "norm", "size", "shard", "fp", "tag", "doc", "own", "key", "copies", "kept", "score", "upper", "spans", "ids", "codec", "rank", "__drop", "count", "row", "k_id", "k_doc_id", "part", "first", "stat_upper", "n", "signature", "source_size")


def make_texts(seed=5):
    """Odd texts: null, empty, white space, long, near copies, repeats, personal data, licences, several scripts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ日") for _ in range(r.randint(1, 8)))
    long = " ".join(word() for _ in range(20_000))
    prose = " ".join(word() for _ in range(300))
    near = prose.split()
    near[150] = "changed"
    passage = "This passage of more than one hundred bytes stands in several documents, word for word and byte for byte, as it happens."
    return [
        None, "", "", " ", "\t\n  \x0b\x0c\r", "a", "A", "one two", "one  two", "one two three", "ONE two three", prose, prose, prose.replace(" ", "  "), " ".join(near), long, long + " end",
        "aaaa" * 60, "ab" * 300, passage, word() + " " + passage + " " + word(), word() * 3 + passage[10:] + word(), "x" * 99, "x" * 100, "x" * 101,
        "mail a.b@c-d.example.org, or x@y; 10.0.0.255 and 300.1.1.1 or 1.2.3.4.5; 4111 1111 1111 1111 but 4111 1111 1111 1112; +1 (555) 123-4567, +12", "password=hunter2hunter2hunter22hunter2 token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"",
        "Released under the MIT License. apache license, GENERAL PUBLIC LICENSE", "licensed under the GNU General Public License, version 3 mit\nlicense", "▁ literal ▁▁ marks", "tabs\tand\nlines\n\n\nand   runs   of   spaces ", "zero \x00 byte", "😀 emoji 👍🏽 and é combining",
    ]


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): odd texts, a repeated row, a repeated id, a missing id, missing sources."""
    texts = make_texts()
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[11], (11, "another text of the same id", "en", "src1", 5), (None, "a text without an id", "en", "src2", 5), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def agree(odd, clashing, empty):
    """An operator gives one row per row, the same with clashing columns, on a rerun and in other partitions, and nothing for nothing."""

    def check(operator, per_row=True):
        got = sorted(map(str, (tuple(r) for r in operator(odd).collect())))
        if per_row:
            assert len(got) == odd.count()
        assert sorted(map(str, (tuple(r) for r in operator(clashing.repartition(5)).collect()))) == got
        assert operator(empty).count() == 0

    return check

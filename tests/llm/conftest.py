import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """(doc_id, text, source) rows with nulls, empty and long texts, exact and near copies, shared passages and repeated rows."""
    rng = random.Random(7)
    passage = sentence(rng, 70)
    base = [sentence(rng, n) for n in (60, 120, 200, 300)]
    rows = []

    def add(text, source=None):
        rows.append((len(rows), text, source if source is not None else f"s{len(rows) % 4}"))

    for text in (None, "", " \n\t ", "one", "one two", "One two", "one two three", "one  two\nthree", "é ü x\x0by", "a\x1cb c"):
        add(text)
    for b in base:
        for _ in range(3):
            add(b)
        words = b.split(" ")
        for k in range(12):
            w = list(words)
            for _ in range(1 + k // 3):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            add(" ".join(w))
    for _ in range(5):
        add(sentence(rng, rng.randrange(0, 90)) + "\n" + passage + " " + sentence(rng, rng.randrange(30)))
    add(passage)
    add(" ".join(passage.split(" ")[:49]))
    add(" ".join(passage.split(" ")[:50]).replace(" ", "\n"))
    add("same same same " * 300)
    add("\n".join(["a line that repeats itself"] * 8 + [sentence(rng, 40)]))
    add(sentence(rng, 6000))
    add("plain # text | with & symbols " * 6 + sentence(rng, 30))
    add("<|endoftext|> a special   <|endoftext|>\n\n  word", "hot")
    for _ in range(40):
        add(sentence(rng, rng.randrange(20, 60)), "hot")
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [rows[i] for i in order]


SCHEMA = "doc_id long, text string, source string, rid string, `size` int, `rank` string, kept string, n long, ord int, component_id string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The corpus as Parquet, with extra columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame = spark.createDataFrame([(i, t, s, "x", 1, "y", "z", 2, 3, "c") for i, t, s in rows], SCHEMA)
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, rows repeated whole, and one id with two texts; not a file scan."""
    long_text = " ".join(f"w{i}" for i in range(80))
    data = [(None, long_text, None), (None, None, None), (1, long_text, "a"), (1, long_text, "a"), (1, long_text + " x", "a"), (2, long_text, None), (3, None, "b"), (3, None, "b")]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")

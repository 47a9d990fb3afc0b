import random

import pytest

WORDS = "the and of river stone cloud winter garden letter window music paper morning silver engine forest market signal copper meadow".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, mark string, rank int, rep long, part int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows():
    """Texts with exact and near copies, a shared passage, nulls, empties, a very long text, repeated rows and odd letters."""
    passage = prose(999, 40)
    texts = [(i, prose(i, 30 + i)) for i in range(20)]
    base = prose(500, 120).split()
    for i in range(20, 32):  # near copies of one text
        w = list(base)
        w[(i * 7) % 120] = f"new{i}"
        texts.append((i, " ".join(w)))
    texts += [(i, prose(501, 60)) for i in range(32, 38)]  # copies
    texts += [(i, f"{prose(i, 25)} {passage} {prose(i + 50, 25)}") for i in range(38, 44)]
    texts += [(44, None), (45, ""), (46, "   \n\t "), (47, "one two"), (48, "One TWO"), (49, "a" * 3000), (50, "a" * 3000 + "b"), (51, prose(77, 20_000)), (52, "é ü ñ 日本   x"), (None, "no id here at all, and more words"), (53, prose(3, 33)), (53, prose(3, 33))]
    out = []
    for k, (i, t) in enumerate(texts):
        source = None if k % 11 == 5 else "hot" if k % 3 else f"s{k % 4}"
        out.append((i, t, "en", source, len(t or ""), k, "m", k % 2, k, k % 3))
    return out


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Written and read again, with columns whose names the operators use inside."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

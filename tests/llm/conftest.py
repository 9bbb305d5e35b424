import random

import pytest

VOCABULARY = "byte_bpe_50k.json"
#: Extra columns whose names clash with those that operators use inside.
EXTRA = ["row", "id", "_digest", "size", "copies", "node", "sig", "at", "doc", "tag", "n", "rank", "shard", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "théta", "iota's", "kappa"]
    texts = [(0, "Hello World"), (1, None), (2, ""), (3, " \t\n "), (4, "hello world"), (5, "HELLO WORLD"), (5, "HELLO WORLD"), (6, "HÉllo"), (7, "hÉllo"), (8, "hello world ")]
    texts += [(None, "no id at all"), (None, None), (None, "no id at all"), (9, "12345 !!"), (10, "x"), (11, " ".join(rng.choice(words) for _ in range(30_000)))]
    line = "This line occurs in many of the documents"
    texts += [(20 + i, f"{line}\nown {i} {rng.choice(words)}\n{line}  \n  {line.upper()}") for i in range(6)]
    base = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(120)]
    for i in range(25):
        changed = list(base)
        for _ in range(i % 5):
            changed[rng.randrange(120)] = f"new{rng.randint(0, 999)}"
        texts.append((100 + i, " ".join(changed)))
    texts += [(200 + i, " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    sources = ["a", "b", None, "c"]
    return [(i, t, ["en", "de", None][k % 3], sources[k % 4], None if t is None else len(t), *[f"x{k}"] * len(EXTRA)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

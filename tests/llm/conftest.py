import random

import pytest

WORDS = ["river", "stone", "of", "the", "and", "lamp", "green", "walks", "quietly", "under", "bridge", "seven", "birds", "Über", "straße", "niño"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, `set` int, batch string, "
          "`__text` string, label int, region string")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in base.split(" ")) for _ in range(6)]
    passage = prose(rng, 60)
    out = {1: None, 2: "", 3: " \t\n ", 4: "one", 5: "One two THREE four", 6: "one two three four five", 7: base, 8: base, 9: base.upper()}
    out |= {20 + k: t for k, t in enumerate(near)}
    out |= {40 + k: prose(rng, 30) + "\n" + passage + " " + prose(rng, 20) for k in range(5)}
    out |= {60 + k: prose(rng, rng.randrange(1, 80)) for k in range(25)}
    out |= {100: "Cillmi " * 300, 101: "a" * 5000, 102: prose(rng, 30_000), 103: "!!! ... 123", 104: "日本語のテキスト 🙂 <|endoftext|> it's", 105: "é" * 150}
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], 1, 7, "x", 3, "y", "z", k % 2, "r") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Every text once, three rows repeated in full, and two without id."""
    rows = [*texts.items(), (7, texts[7]), (60, texts[60]), (60, texts[60]), (None, texts[61]), (None, "loose words here")]
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [(1, "x")]).where("doc_id is null")

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stems=("the", "ing", "er", "tion", "an", "re", "ou", "st", "és", "ü")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with every oddity: nulls, empty and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(20, 300)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = [None, "", "  \n\t ", "one", "a b c d", "a b c d", "Ünïcode ⅷ 😀 " * 3, "ab" * 400, "!!! ### $$$ " * 40, "same line\n" * 50]
    texts += base + base[:5]
    for t in base[5:10]:
        w = t.split(" ")
        w[len(w) // 2] = "CHANGED"
        texts.append(" ".join(w))
    texts += [base[i][:500] + " " + passage + " " + base[i + 1][:300] for i in range(10, 16)]
    texts += [base[20].upper(), base[20].replace(" ", "\t\n"), prose(rng, 30000), 'token = "0123456789abcdef0123456789abcdef" x', "AKIA" + "Z9" * 9 + " api_key:abc é secret=abcdefg"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[12])  # a wholly repeated row
    rows.append((None, base[0], None, None, None))
    rows.append((3, "another text under a used id " * 4, None, None, 1))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

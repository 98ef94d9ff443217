import random

import pytest

#: Names of columns that operators use inside, as extra columns of their inputs.
CLASHING = ("bucket", "home", "rep", "task", "hood", "shard", "_id", "_home", "part", "_rank", "kind", "size")


def rows_of(spark, texts, **more):
    """documents of the given texts, with clashing extra columns."""
    data = [(i, t, (more.get("lang") or ["en"] * len(texts))[i], (more.get("source") or ["a"] * len(texts))[i], None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(data, schema)


@pytest.fixture
def texts():
    """Copies, near copies, shared passages, null, empty, blank and a very long text."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = line(120), line(40)
    out = [None, "", " \n\t ", "one two", "one two", base, base, base.replace("w", "W", 1), base + " tail", line(30) + " " + passage + " " + line(20), passage, line(5) + "\n" + passage + "\t" + line(9), "x y z  q", line(6000)]
    out += [line(rng.randrange(1, 80)) for _ in range(25)]
    noisy = base.split()
    for k in range(6):
        w = list(noisy)
        w[7 * k + 3] = "changed"
        out.append("  ".join(w))
    return out

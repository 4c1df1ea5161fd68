"""Seeds and their extensions against the SQL, on texts of few different lines, which repeat within a text as well."""

import random

import duckdb
from lakeaudit.llm import linedup

from .test_operators import docs, words


def test_seeds_against_sql(spark):
    r = random.Random(8)
    pool = [words(i, r.choice([1, 3, 20])) for i in range(25)] + ["", "end"]
    block = [words(100 + i, 8) for i in range(14)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 40))) for _ in range(40)]
    texts += ["\n".join([words(200 + i, 5), *block[i % 3 :], words(300 + i, 5)]) for i in range(6)]
    texts += ["\n".join(block + block), "\n".join(["a b"] * 30), "\n".join(["a b"] * 31), None, "", texts[3]]
    frame = docs(spark, texts).select("doc_id", "text")
    columns = ["doc_id", *linedup.RESULTS, "text"]
    got = sorted(tuple(x) for x in linedup.dedup_lines(frame).select(columns).collect())
    with duckdb.connect() as c:
        documents = frame.toArrow()  # noqa: F841
        want = sorted(c.execute(f"select {', '.join(columns)} from ({linedup.ORACLE})").fetchall())
    assert got == want and sum(x[3] for x in got) > 50
    alone = {x["doc_id"]: x for x in linedup.dedup_lines(frame, spans=False).collect()}
    assert all(alone[x[0]]["n_seed_lines"] == x[3] and alone[x[0]]["n_span_lines"] == 0 for x in got)
